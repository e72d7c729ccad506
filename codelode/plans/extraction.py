"""Extraction and enrichment queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import chunking, enrichment, extraction
from codelode.plans.views import sql
from codelode.sources import repository
from codelode.sources.tables import Index

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def texts(ix: Index):
    """Whole source texts with their file's path, repository and language."""
    files = ix.files("id", "repo", "path", "language").withColumnRenamed("id", "file_id")
    return ix.raw("source_texts").where("file_id is not null").dropDuplicates(["file_id"]).join(files, "file_id")


_T = """,
t AS (SELECT DISTINCT ON (x.file_id) x.file_id, x.content, f.repo, f.path, f.language FROM source_texts x JOIN f ON f.id = x.file_id)
"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in repository.EXTENSIONS.items())
query("src_language", sql(f"SELECT id, CASE WHEN contains(name, '.') THEN CASE split_part(name, '.', -1) {_CASES} END END AS detected FROM (SELECT id, split_part(path, '/', -1) AS name FROM f)"))(
    lambda ix: ix.files("id", "path").select("id", repository.language_of(F.col("path")).alias("detected")))
_PARTS = ", ".join(f"'{p}'" for p in repository.EXCLUDED if not p.startswith("*"))
_ENDS = " OR ".join(f"ends_with(path, '{p[1:]}')" for p in repository.EXCLUDED if p.startswith("*"))
query("src_exclude", sql(f"SELECT id, path FROM f WHERE NOT (list_has_any(string_split(path, '/'), [{_PARTS}]) OR {_ENDS})"))(
    lambda ix: ix.files("id", "path").where(~repository.excluded(F.col("path"))))
query("src_walk", sql(_T + f"SELECT repo, path FROM t WHERE language IS NOT NULL AND NOT (list_has_any(string_split(path, '/'), [{_PARTS}]) OR {_ENDS})"))(
    lambda ix: texts(ix).where(F.col("language").isNotNull() & ~repository.excluded(F.col("path"))).select("repo", "path"))
query("src_gitignore", sql("SELECT id, path FROM f WHERE path NOT IN (SELECT path FROM f WHERE path LIKE 'tests/%')"))(
    lambda ix: repository.without_ignored(ix.files("id", "path"), ix.files("path").where(F.col("path").startswith("tests/"))).select("id", "path"))
query("src_hash", sql(_T + "SELECT file_id, sha256(content) AS hash FROM t"))(lambda ix: texts(ix).select("file_id", F.sha2("content", 256).alias("hash")))
query("src_read_text", sql(_T + "SELECT file_id, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, strlen(content) AS bytes FROM t"))(
    lambda ix: texts(ix).select("file_id", repository.line_count(F.col("content")).cast("long").alias("lines"), F.octet_length("content").cast("long").alias("bytes")))
query("x_strip_separators", sql(_T + r"""SELECT file_id, sha256(regexp_replace(regexp_replace(content, '(?m)^[ \t]*/\*[\* \t]*\*/[ \t]*\n?', '', 'g'), '(?m)^[ \t]*//[ \t]*[-=+\*]{3,}[ \t]*\n?', '', 'g')) AS hash FROM t"""))(
    lambda ix: texts(ix).select("file_id", F.sha2(extraction.strip_separators(F.col("content")), 256).alias("hash")))


def _first(patterns: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(raw, '{p}', 1), '')" for p in quoted) + ")"


_IMPORT = "CASE language " + " ".join(f"WHEN '{k}' THEN {_first(v)}" for k, v in extraction.IMPORTS.items()) + " END"
query("x_imports", sql(_T + r""", l AS (SELECT file_id, language, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM t),
i AS (SELECT file_id, language, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS raw FROM l)""" + f"""
SELECT file_id, line_no, module, 'import' AS kind, raw FROM (SELECT file_id, line_no, raw, {_IMPORT} AS module FROM i) WHERE module IS NOT NULL"""))(lambda ix: extraction.imports(texts(ix)))


def _refs(ix: Index):
    return extraction.references(ix.chunks("id", "content", "start_line", "symbol_name", "parent_symbol"))


_NO = ", ".join(f"'{w}'" for w in extraction.NO_NAMES)
_LINES = """,
l AS (SELECT id AS chunk_id, coalesce(nullif(symbol_name, ''), parent_symbol) AS source_symbol_name, start_line, unnest(string_split(content, chr(10))) AS line, unnest(range(0, len(string_split(content, chr(10))))) AS off FROM c)
"""
_KEEP = f"target_name NOT IN ({_NO}) AND (source_symbol_name IS NULL OR target_name <> source_symbol_name)"
query("x_references_members", sql(_LINES + rf"""
SELECT DISTINCT * FROM (SELECT chunk_id, source_symbol_name, unnest(regexp_extract_all(line, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS target_name, start_line + off AS line_no FROM l) WHERE {_KEEP}"""))(
    lambda ix: _refs(ix).where("reference_kind = 'member_call'").drop("reference_kind"))
query("x_references_types", sql(_LINES + rf""",
w AS (SELECT chunk_id, source_symbol_name, unnest(regexp_extract_all(line, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS target_name, start_line + off AS line_no FROM l)
SELECT DISTINCT * FROM w WHERE regexp_full_match(target_name, '[A-Z][A-Za-z0-9_]*') AND {_KEEP}"""))(
    lambda ix: _refs(ix).where("reference_kind = 'type_reference'").drop("reference_kind"))

# a space behind each bracket leaves every call a character of its own to stand behind
_CALLS = rf"""SELECT DISTINCT chunk_id, source_symbol_name, target_name, 'call' AS reference_kind, line_no FROM (
  SELECT chunk_id, source_symbol_name, unnest(regexp_extract_all(replace(line, '(', '( '), '(?:^|[^.\p{{L}}\p{{M}}\p{{N}}_])([a-z_][A-Za-z0-9_]*)\s*\(', 1)) AS target_name, start_line + off AS line_no FROM l) WHERE {_KEEP}"""
query("x_references", sql(_LINES + rf""",
w AS (SELECT chunk_id, source_symbol_name, unnest(regexp_extract_all(line, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS target_name, start_line + off AS line_no FROM l)
SELECT DISTINCT chunk_id, source_symbol_name, target_name, 'type_reference' AS reference_kind, line_no FROM w WHERE regexp_full_match(target_name, '[A-Z][A-Za-z0-9_]*') AND {_KEEP}
UNION ALL SELECT DISTINCT chunk_id, source_symbol_name, target_name, 'member_call', line_no FROM (SELECT chunk_id, source_symbol_name, unnest(regexp_extract_all(line, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) AS target_name, start_line + off AS line_no FROM l) WHERE {_KEEP}
UNION ALL {_CALLS}"""))(_refs)


def _enclosing(ix: Index):
    refs = ix.references("id", "source_file_id", "line_no").withColumnRenamed("source_file_id", "file_id")
    return extraction.enclosing_chunks(refs, ix.chunks("id", "file_id", "start_line", "end_line"), ["id"])


query("x_enclosing_chunk", sql("""
SELECT r.id, r.source_file_id AS file_id, r.line_no, b.cid AS enclosing_chunk_id FROM r LEFT JOIN (
  SELECT r.id, arg_min(c.id, struct_pack(size := c.end_line - c.start_line, id := c.id)) AS cid FROM r JOIN c ON c.file_id = r.source_file_id AND r.line_no BETWEEN c.start_line AND c.end_line GROUP BY r.id) b ON b.id = r.id"""))(_enclosing)
query("x_clean_type", sql(r"""SELECT DISTINCT target_name, split_part(regexp_replace(regexp_replace(trim('Core.' || target_name || '<Row>?'), '[?!]+$', ''), '<.*?>', '', 'g'), '.', -1) AS bare FROM r WHERE target_name IS NOT NULL"""))(
    lambda ix: ix.references("id", "target_name").where("target_name is not null").select("target_name", extraction.clean_type(F.concat(F.lit("Core."), "target_name", F.lit("<Row>?"))).alias("bare")).distinct())
query("x_swift_edges")(lambda ix: extraction.service_edges(texts(ix).where("language = 'swift'"), ix.chunks("id", "file_id", "start_line", "end_line", "symbol_name", "symbol_type", "parent_symbol")))
query("x_symbol_rows", sql("""
SELECT s.id, s.file_id, s.name, s.qualified_name, s.container_symbol, s.start_line, s.parent_id, x.pid AS resolved_parent_id FROM s LEFT JOIN (
  SELECT m.id, p.id AS pid FROM s m JOIN s p ON p.file_id = m.file_id AND p.qualified_name = split_part(m.qualified_name, ':', 1) || ':' || m.container_symbol AND p.start_line <= m.start_line
  QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY p.start_line DESC, p.id DESC) = 1) x ON x.id = s.id"""))(lambda ix: extraction.symbol_rows(ix.symbols("id", "file_id", "name", "qualified_name", "container_symbol", "start_line", "parent_id")))


def _chunks(ix: Index):
    return chunking.chunk_files(texts(ix))


query("x_chunk_ast")(lambda ix: _chunks(ix).drop("members"))
query("x_chunk_fallback")(lambda ix: chunking.chunk_files(texts(ix).withColumn("language", F.lit(None).cast("string"))).select("file_id", "chunk_index", "content", "start_line", "end_line"))
query("x_subchunk")(lambda ix: _chunks(ix).where("parent_symbol is not null").drop("members"))
query("x_top_level")(lambda ix: _chunks(ix).where("symbol_name is not null and parent_symbol is null").select("file_id", "symbol_name", "symbol_type", "start_line", "end_line"))
query("x_members")(lambda ix: _chunks(ix).select("file_id", F.explode("members").alias("m")).select("file_id", "m.*"))
query("x_symbols")(lambda ix: chunking.chunk_symbols(_chunks(ix)))
query("x_docstring")(lambda ix: chunking.chunk_symbols(_chunks(ix)).where("docstring is not null").select("file_id", "name", "start_line", "docstring"))
query("x_signature")(lambda ix: chunking.chunk_symbols(_chunks(ix)).select("file_id", "name", "start_line", "signature"))
query("x_name")(lambda ix: chunking.chunk_symbols(_chunks(ix)).select("file_id", "name", "qualified_name", "start_line"))
query("x_symbol_type")(lambda ix: chunking.chunk_symbols(_chunks(ix)).groupBy("kind", "is_primary_declaration").agg(F.count("*").alias("n")))
query("x_exported")(lambda ix: chunking.chunk_symbols(_chunks(ix)).where("is_exported").select("file_id", "name", "start_line"))
query("x_visibility")(lambda ix: chunking.chunk_symbols(_chunks(ix)).groupBy("visibility", "is_exported").agg(F.count("*").alias("n")))

query("e_embed_text", sql("SELECT f.id, f.path || chr(10) || coalesce(f.summary, '') AS text FROM f"))(lambda ix: ix.files("id", "path", "summary").select("id", enrichment.file_text(F.col("path"), F.col("summary")).alias("text")))
query("e_embed_text_chunks", sql("SELECT c.id, '# ' || f.path || chr(10) || c.content AS text FROM c JOIN f ON f.id = c.file_id"))(
    lambda ix: ix.chunks("id", "file_id", "content").join(ix.files("id", "path").withColumnRenamed("id", "file_id"), "file_id").select("id", enrichment.chunk_input(F.col("path"), F.col("content")).alias("text")))
query("e_embed_text_symbols", sql("SELECT id, kind || ' ' || name || ': ' || coalesce(docstring, '') AS text FROM s"))(
    lambda ix: ix.symbols("id", "kind", "name", "docstring").select("id", enrichment.symbol_text(F.col("kind"), F.col("name"), F.col("docstring")).alias("text")))
query("e_embed")(lambda ix: enrichment.embed(ix.symbols("id", "name"), "name"))
query("e_classify")(lambda ix: enrichment.classify(ix.chunks("id", "content")).select("id", "intent", "intent_detail"))
query("e_analyze_file")(lambda ix: enrichment.analyze_files(texts(ix).select("file_id", "path", "content")).select("file_id", "summary", "role", "warning"))
query("e_no_classify", sql("SELECT id, '' AS summary, 'unknown' AS role, 'utility' AS intent, '' AS intent_detail FROM c"))(lambda ix: enrichment.unclassified(ix.chunks("id", "intent").select("id")))
query("e_parse_json", """
SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")(
    lambda ix: ix.raw("events").select("event_id", F.from_json(enrichment.unfenced(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k bigint")["k"].alias("k")))
