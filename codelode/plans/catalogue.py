"""Catalogue queries over the whole index."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import catalogue as C
from codelode.plans.views import sql
from codelode.sources.tables import Index

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _micros(df, *names):
    """Times as microseconds, so that both engines give the same value whatever their session's zone."""
    return df.withColumns({n: F.unix_micros(n) for n in names})


query("q_list_repositories", sql("""
SELECT a.repo, total_files, total_lines, coalesce(total_chunks, 0) AS total_chunks, coalesce(total_symbols, 0) AS total_symbols
FROM (SELECT repo, count(*) AS total_files, coalesce(sum(line_count), 0) AS total_lines FROM f GROUP BY repo) a
LEFT JOIN (SELECT repo, count(*) AS total_chunks FROM c JOIN f ON c.file_id = f.id GROUP BY repo) b ON a.repo = b.repo
LEFT JOIN (SELECT repo, count(*) AS total_symbols FROM s JOIN f ON s.file_id = f.id GROUP BY repo) e ON a.repo = e.repo"""))(C.list_repositories)
query("q_repo_exists", sql("SELECT repo, count(*) > 0 AS present FROM f GROUP BY repo"))(lambda ix: ix.files("id", "repo").select("repo", F.lit(True).alias("present")).distinct())
query("q_codebase_stats_summary", ORACLE["q_list_repositories"])(C.list_repositories)
query("q_codebase_stats_languages", sql("SELECT repo, coalesce(language, 'unknown') AS label, count(*) AS n FROM f GROUP BY ALL"))(lambda ix: C.histogram(ix, "languages"))
query("q_codebase_stats_intents", sql("SELECT repo, coalesce(intent, 'unclassified') AS label, count(*) AS n FROM c JOIN f ON c.file_id = f.id GROUP BY ALL"))(lambda ix: C.histogram(ix, "intents"))
query("q_codebase_stats_kinds", sql("SELECT repo, kind AS label, count(*) AS n FROM s JOIN f ON s.file_id = f.id GROUP BY ALL"))(lambda ix: C.histogram(ix, "kinds"))

_HIST = "(SELECT repo, string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) AS {name} FROM (SELECT repo, {col} AS label, count(*) AS n FROM {t} WHERE {col} IS NOT NULL GROUP BY ALL) GROUP BY repo)"
query("v_codebase_stats", sql(f""",
fan AS (SELECT f.repo, f.id, f.line_count, c.id AS cid, s.id AS sid, d.id AS did FROM f LEFT JOIN c ON c.file_id = f.id LEFT JOIN s ON s.file_id = f.id LEFT JOIN d ON d.source_file_id = f.id),
t AS (SELECT repo, count(DISTINCT id) AS total_files, sum(line_count) AS fanned_lines, count(DISTINCT cid) AS total_chunks, count(DISTINCT sid) AS total_symbols, count(DISTINCT did) AS total_dependencies FROM fan GROUP BY repo),
l AS (SELECT repo, sum(line_count) AS total_lines FROM f GROUP BY repo)
SELECT t.*, l.total_lines, a.languages, b.intents, k.symbol_kinds FROM t JOIN l USING (repo)
LEFT JOIN {_HIST.format(name="languages", col="language", t="f")} a USING (repo)
LEFT JOIN {_HIST.format(name="intents", col="intent", t="(SELECT repo, intent FROM c JOIN f ON c.file_id = f.id)")} b USING (repo)
LEFT JOIN {_HIST.format(name="symbol_kinds", col="kind", t="(SELECT repo, kind FROM s JOIN f ON s.file_id = f.id)")} k USING (repo)"""))(C.stats_view)

query("q_index_size", sql("""
SELECT a.repo, file_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(content_bytes, 0) AS content_bytes, coalesce(symbol_count, 0) AS symbol_count, coalesce(ref_count, 0) AS ref_count,
  coalesce(chunk_count, 0) * (64 * 4 + 8) AS estimated_embedding_bytes, coalesce(content_bytes, 0) + coalesce(chunk_count, 0) * (64 * 4 + 8) AS estimated_total_bytes
FROM (SELECT repo, count(*) AS file_count FROM f GROUP BY repo) a
LEFT JOIN (SELECT repo, count(*) AS chunk_count, sum(length(content)) AS content_bytes FROM c JOIN f ON c.file_id = f.id GROUP BY repo) b USING (repo)
LEFT JOIN (SELECT repo, count(*) AS symbol_count FROM s JOIN f ON s.file_id = f.id GROUP BY repo) e USING (repo)
LEFT JOIN (SELECT repo, count(*) AS ref_count FROM r JOIN f ON r.source_file_id = f.id GROUP BY repo) g USING (repo)"""))(C.index_size)
query("q_index_size_human", sql("""
SELECT repo, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS content
FROM (SELECT repo, sum(length(content))::BIGINT AS b FROM c JOIN f ON c.file_id = f.id GROUP BY repo)"""))(
    lambda ix: C.index_size(ix).where("chunk_count > 0").select("repo", C.human_bytes(F.col("content_bytes")).alias("content")))
query("q_file_map", sql("""
SELECT f.repo, f.path, f.language, f.line_count, f.role, f.summary, x.symbols
FROM f LEFT JOIN (SELECT file_id, string_agg(DISTINCT name || ' (' || kind || ')', ',' ORDER BY name || ' (' || kind || ')') AS symbols FROM s WHERE is_exported GROUP BY file_id) x ON x.file_id = f.id"""))(C.file_map)
query("q_get_intent", sql(""",
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, id) AS n FROM f WHERE path LIKE '%src/%') WHERE n = 1)
SELECT first.repo, first.path, first.role, first.summary, c.chunk_index, c.symbol_name, c.symbol_type, c.intent, c.intent_detail, c.start_line, c.end_line FROM first JOIN c ON c.file_id = first.id"""))(
    lambda ix: C.get_intent(ix, "src/"))
query("q_run_history", sql("""
SELECT * FROM (SELECT id, repo, started_at, completed_at, files_processed, chunks_created, symbols_found, status, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id DESC) AS place FROM runs) WHERE place <= 100""".replace("started_at, completed_at, files", "epoch_us(started_at) AS started_at, epoch_us(completed_at) AS completed_at, files")))(
    lambda ix: _micros(C.run_history(ix), "started_at", "completed_at"))
query("q_last_run", sql("SELECT repo, epoch_us(started_at) AS started_at, id, status, files_processed FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id DESC) AS n FROM runs) WHERE n = 1"))(lambda ix: _micros(C.last_runs(ix), "started_at"))
query("q_tool_calls", "SELECT event_type AS name, count(*) AS calls FROM events WHERE event_type <> '' GROUP BY ALL")(lambda ix: C.tool_calls(ix.raw("events")))
query("q_summarize_args", sql("""
SELECT id, 'repo="' || repo || '", path="' || CASE WHEN length(path) > 120 THEN path[:117] || '...' ELSE path END || '", line_count=' || coalesce(line_count::VARCHAR, 'null') AS args FROM f"""))(
    lambda ix: C.summarize_args(ix.files("id", "repo", "path", "line_count"), "repo", "path", "line_count").select("id", "args"))
query("q_desktop_stats", sql("""
SELECT f.repo, count(DISTINCT f.id) AS file_count, count(DISTINCT c.id) AS chunk_count, count(DISTINCT s.id) AS symbol_count
FROM f LEFT JOIN c ON c.file_id = f.id LEFT JOIN s ON s.file_id = f.id GROUP BY f.repo"""))(
    lambda ix: C.list_repositories(ix).selectExpr("repo", "total_files AS file_count", "total_chunks AS chunk_count", "total_symbols AS symbol_count"))

_DIRS = """,
fd AS (SELECT *, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS module_path FROM f),
roll AS (
  SELECT a.repo, a.module_path, a.file_count, coalesce(b.chunk_count, 0) AS chunk_count, coalesce(b.intent_details, '') AS intent_details
  FROM (SELECT repo, module_path, count(*) AS file_count FROM fd GROUP BY ALL) a
  LEFT JOIN (SELECT repo, module_path, count(*) AS chunk_count, string_agg(DISTINCT intent_detail, ' | ' ORDER BY intent_detail) AS intent_details FROM fd JOIN c ON c.file_id = fd.id GROUP BY ALL) b
  ON a.repo = b.repo AND a.module_path = b.module_path WHERE a.file_count >= 3)
"""
_DOMINANT = """,
dom AS (SELECT repo, module_path, intent AS dominant_intent FROM (
  SELECT repo, module_path, intent, row_number() OVER (PARTITION BY repo, module_path ORDER BY count(*) DESC, intent) AS n FROM fd JOIN c ON c.file_id = fd.id WHERE intent IS NOT NULL GROUP BY repo, module_path, intent) WHERE n = 1)
"""
_MODULES = "SELECT roll.repo, roll.module_path, 'directory' AS kind, split_part(roll.module_path, '/', -1) AS module_name, dom.dominant_intent, file_count, chunk_count FROM roll LEFT JOIN dom ON roll.repo = dom.repo AND roll.module_path = dom.module_path"
query("s_dir_rollup", sql(_DIRS + "SELECT * FROM roll"))(C.directory_rollup)
query("s_dir_modules", sql(_DIRS + _DOMINANT + _MODULES))(C.module_map)
query("q_module_map", sql(_DIRS + _DOMINANT + _MODULES + " WHERE roll.module_path LIKE 'src%'"))(lambda ix: C.module_map(ix, path_prefix="src"))
query("q_desktop_modules", sql(_DIRS + _DOMINANT + _MODULES))(C.module_map)
