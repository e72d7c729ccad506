"""Maintenance, streaming and synthesis queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import maintenance as M
from codelode.operators import synthesis as Y
from codelode.operators.catalogue import module_map
from codelode.plans.graph import _NAMED
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


_PATH = r"regexp_replace(replace(path, '\', '/'), '^(\./+)+', '')"
_HASH = r"lower(nullif(regexp_replace(hash, '^\s+|\s+$', '', 'g'), ''))"
_NOW = f""",
sc AS (SELECT repo, {_PATH} AS path, {_HASH} AS hash, scanned_at, scan_id FROM file_scans WHERE {_HASH} IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL AND scanned_at IS NOT NULL),
now AS (SELECT repo, path, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC, scan_id DESC) AS n FROM (SELECT DISTINCT * FROM sc)) WHERE n = 1),
old AS (SELECT id, repo, {_PATH} AS path, {_HASH} AS old_hash FROM f)
"""


def _now(ix: Index) -> DataFrame:
    return M.latest_scans(ix.raw("file_scans"))


query("dml_skip_unchanged", sql(_NOW + "SELECT now.repo, now.path, now.hash, CASE WHEN old_hash = hash THEN 'skipped' ELSE 'indexed' END AS status FROM now LEFT JOIN old ON now.repo = old.repo AND now.path = old.path"))(
    lambda ix: M.skip_unchanged(ix.files("id", "repo", "path", "hash"), _now(ix).select("repo", "path", "hash")))
query("dml_upsert_file", sql(_NOW + """,
u AS (SELECT old.id, coalesce(old.repo, now.repo) AS repo, coalesce(old.path, now.path) AS path, coalesce(hash, old_hash) AS hash,
  CASE WHEN old.id IS NULL THEN 'insert' WHEN hash IS NULL OR hash = old_hash THEN 'keep' ELSE 'update' END AS operation FROM old FULL JOIN now ON now.repo = old.repo AND now.path = old.path)
SELECT coalesce(id, (SELECT max(id) FROM f) + row_number() OVER (PARTITION BY id IS NULL ORDER BY repo, path)) AS id, repo, path, hash, operation FROM u"""))(
    lambda ix: M.upsert_files(ix.files("id", "repo", "path", "hash"), _now(ix)))
query("dml_prune", sql(_NOW + "SELECT id, repo, path FROM old WHERE repo IN (SELECT repo FROM now) AND (repo, path) NOT IN (SELECT (repo, path) FROM now)"))(
    lambda ix: M.prune(ix.files("id", "repo", "path"), _now(ix)))
query("dml_delete_prefix", sql("SELECT id, repo, path FROM f WHERE NOT (starts_with(path, 'src/') OR path = 'src')"))(lambda ix: M.delete_prefix(ix.files("id", "repo", "path"), "src"))
query("dml_delete_repo", sql("SELECT id, repo FROM f WHERE repo <> (SELECT max(repo) FROM f)"))(
    lambda ix: M.delete_repository(ix.files("id", "repo"), ix.raw("files").agg(F.max("repo")).first()[0], confirm=True)[0])


def _cascade(ix: Index) -> DataFrame:
    kept = M.delete_prefix(ix.files("id", "repo", "path"), "src")
    tables = {"code_chunks": ix.chunks("id", "file_id"), "symbols": ix.symbols("id", "file_id", "chunk_id")}
    tables |= {"symbol_references": ix.references("id", "source_file_id", "source_chunk_id"), "dependencies": ix.dependencies("id", "source_file_id", "target_file_id", "source_symbol_id", "target_symbol_id")}
    out = None
    for name, df in M.cascade(tables, kept).items():
        part = df.select(F.lit(name).alias("table_name"), "id")
        out = part if out is None else out.unionByName(part)
    return out


query("dml_cascade", sql(""",
k AS (SELECT id FROM f WHERE NOT (starts_with(path, 'src/') OR path = 'src')), ks AS (SELECT id FROM s WHERE file_id IN (SELECT id FROM k))
SELECT 'code_chunks' AS table_name, id FROM c WHERE file_id IN (SELECT id FROM k) UNION ALL SELECT 'symbols', id FROM ks UNION ALL SELECT 'symbol_references', id FROM r WHERE source_file_id IN (SELECT id FROM k) AND (source_chunk_id IS NULL OR source_chunk_id IN (SELECT id FROM c WHERE file_id IN (SELECT id FROM k)))
UNION ALL SELECT 'dependencies', id FROM d WHERE source_file_id IN (SELECT id FROM k) AND (target_file_id IS NULL OR target_file_id IN (SELECT id FROM k)) AND (source_symbol_id IS NULL OR source_symbol_id IN (SELECT id FROM ks)) AND (target_symbol_id IS NULL OR target_symbol_id IN (SELECT id FROM ks))"""))(_cascade)
query("dml_replace_children", sql("SELECT id, file_id, CASE WHEN f.language = 'go' THEN 'fresh' ELSE 'kept' END AS origin FROM (SELECT id, file_id FROM c) x LEFT JOIN (SELECT id AS fid, language FROM f) f ON f.fid = x.file_id"))(
    lambda ix: M.replace_children(
        ix.chunks("id", "file_id").withColumn("origin", F.lit("kept")),
        ix.chunks("id", "file_id").join(ix.files("id", "language").where("language = 'go'").select(F.col("id").alias("file_id")), "file_id", "left_semi").withColumn("origin", F.lit("fresh"))))


def _modules(ix: Index) -> DataFrame:
    fresh = module_map(ix).select("repo", "module_path", "kind", "module_name", "file_count", F.lit("2025-01-02").cast("date").alias("updated_at"))
    stored = fresh.withColumns({"module_name": F.lit("stale"), "updated_at": F.lit("2025-01-01").cast("date")})
    stored = stored.unionByName(stored.withColumns({"kind": F.lit("logical"), "module_path": F.concat(F.lit("_logical/"), "module_path")}))
    return M.upsert_modules(stored, fresh, "directory").select("repo", "module_path", "kind", "module_name")


query("dml_upsert_module", sql(""",
m AS (SELECT repo, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS module_path FROM f), n AS (SELECT repo, module_path FROM m GROUP BY ALL HAVING count(*) >= 3)
SELECT repo, module_path, 'directory' AS kind, split_part(module_path, '/', -1) AS module_name FROM n UNION ALL SELECT repo, '_logical/' || module_path, 'logical', 'stale' FROM n"""))(_modules)


def _closed(ix: Index) -> DataFrame:
    statuses = ix.raw("file_scans").dropDuplicates(["scan_id"]).select("run_id", F.when(F.col("hash").isNull(), "errors").otherwise("indexed").alias("status"))
    return M.close_runs(ix.runs("id", "repo", "started_at"), statuses.where("run_id is not null")).drop("started_at")


query("dml_run_close", sql(""",
x AS (SELECT run_id, count(*) FILTER (hash IS NOT NULL) AS indexed, count(*) FILTER (hash IS NULL) AS errors FROM (SELECT DISTINCT ON (scan_id) * FROM file_scans) WHERE run_id IS NOT NULL GROUP BY run_id)
SELECT runs.id, runs.repo, indexed, 0 AS skipped, 0 AS deleted, errors, indexed + errors AS files_processed, 'completed' AS status FROM runs JOIN x ON x.run_id = runs.id"""))(_closed)

query("dml_run_open", sql("SELECT id, repo FROM runs WHERE completed_at IS NULL AND status = 'running'"))(
    lambda ix: ix.runs("id", "repo", "completed_at", "status").where("completed_at is null and status = 'running'").select("id", "repo"))

_FEED = """
WITH feed AS (SELECT DISTINCT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS op FROM events),
x AS (SELECT event_id, ts, op, user_id AS path FROM feed WHERE op <> 'moved' UNION ALL SELECT event_id, ts, 'deleted', user_id FROM feed WHERE op = 'moved' UNION ALL SELECT event_id, ts, 'modified', user_id + 1 FROM feed WHERE op = 'moved')
"""


def _feed(ix: Index) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    feed = ix.raw("events").dropDuplicates(["event_id"]).select("event_id", "ts", op.alias("op"), F.col("user_id").alias("path"), (F.col("user_id") + 1).alias("to_path"))
    return M.split_moves(feed)


query("st_created", _FEED + "SELECT path, min(event_id) AS first_event FROM x WHERE op = 'created' GROUP BY path")(
    lambda ix: _feed(ix).where("op = 'created'").groupBy("path").agg(F.min("event_id").alias("first_event")))
query("st_latest_state", _FEED + "SELECT path, event_id, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC, op DESC) AS n FROM x) WHERE n = 1")(
    lambda ix: M.latest_events(_feed(ix), ["path"], ["ts", "event_id"]).select("path", "event_id", "op"))
query("st_moved", _FEED + "SELECT event_id, op, path FROM x")(lambda ix: _feed(ix).select("event_id", "op", "path"))
query("st_deleted", _FEED + "SELECT DISTINCT path FROM x WHERE op = 'deleted'")(lambda ix: _feed(ix).where("op = 'deleted'").select("path").distinct())
query("st_modified", _FEED + "SELECT path, count(*) AS changes FROM x WHERE op IN ('created', 'modified') GROUP BY path")(
    lambda ix: _feed(ix).where("op in ('created', 'modified')").groupBy("path").agg(F.count("*").alias("changes")))
query("st_status", """
SELECT user_id % 20 AS shard, count(*) FILTER (event_type = 'click') AS indexed, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'signup') AS deleted, count(*) FILTER (event_type NOT IN ('click', 'view', 'signup')) AS errors
FROM events GROUP BY ALL""")(
    lambda ix: M.fold_statuses(ix.raw("events").select((F.col("user_id") % 20).alias("shard"), F.when(F.col("event_type") == "click", "indexed").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "signup", "deleted").otherwise("failed").alias("status")), ["shard"]))

_CLASSES = """,
nd AS (SELECT f.repo, s.id, s.name, s.name_lc, s.kind, f.path FROM s JOIN f ON s.file_id = f.id WHERE s.kind IN ('class', 'struct', 'interface', 'protocol', 'enum') AND s.parent_id IS NULL QUALIFY count(*) OVER (PARTITION BY f.repo) >= 5),
ed AS (
  SELECT source_symbol_id AS src, target_symbol_id AS tgt FROM d WHERE source_symbol_id IS NOT NULL AND target_symbol_id IS NOT NULL
  UNION ALL SELECT DISTINCT coalesce(ss.parent_id, ss.id), ts.id FROM r JOIN s ss ON ss.name = r.source_symbol_name AND ss.file_id = r.source_file_id JOIN s ts ON ts.name_lc = r.name_lc),
cg AS (SELECT a.repo, least(src, tgt) AS a, greatest(src, tgt) AS b, count(*) AS weight FROM ed JOIN nd a ON a.id = src JOIN nd b ON b.id = tgt AND b.repo = a.repo WHERE src <> tgt GROUP BY ALL)
"""
query("s_class_graph", sql(_CLASSES + "SELECT * FROM cg"))(Y.class_graph)
_FILES = f""",
fg AS (SELECT repo, least(src, tgt) AS a, greatest(src, tgt) AS b, count(*) AS weight FROM (
  SELECT sf.repo, sf.path AS src, tf.path AS tgt FROM {_NAMED} WHERE sf.id <> tf.id
  UNION ALL SELECT sf.repo, sf.path, tf.path FROM d JOIN f sf ON sf.id = d.source_file_id JOIN f tf ON tf.id = d.target_file_id AND tf.repo = sf.repo WHERE sf.id <> tf.id) WHERE src <> tgt GROUP BY ALL)
"""
query("s_file_graph", sql(_FILES + "SELECT * FROM fg"))(Y.file_graph)
query("s_hub_dampen", sql(_FILES + """,
dg AS (SELECT repo, node, count(*) AS degree FROM (SELECT repo, a AS node FROM fg UNION ALL SELECT repo, b FROM fg) GROUP BY ALL),
li AS (SELECT repo, count(*) AS n, list_sort(list(degree)) AS ds FROM dg GROUP BY repo),
lm AS (SELECT repo, n, ds[least(floor(n * 90 / 100.0)::INT, n - 1) + 1] AS threshold, ds[n // 2 + 1] AS median FROM li),
sc AS (SELECT dg.repo, node, median::DOUBLE / degree AS scale FROM dg JOIN lm USING (repo) WHERE n >= 3 AND threshold > median AND degree > threshold)
SELECT fg.repo, fg.a, fg.b, round(weight * coalesce(x.scale, 1) * coalesce(y.scale, 1), 6) AS weight FROM fg LEFT JOIN sc x ON x.repo = fg.repo AND x.node = fg.a LEFT JOIN sc y ON y.repo = fg.repo AND y.node = fg.b"""))(
    lambda ix: Y.dampen_hubs(Y.file_graph(ix)).withColumn("weight", F.round("weight", 6)))
query("s_louvain")(lambda ix: Y.communities(Y.dampen_hubs(Y.file_graph(ix)), split=False))
query("s_split")(lambda ix: Y.communities(Y.dampen_hubs(Y.file_graph(ix))))
query("s_logical_modules")(Y.logical_modules)
