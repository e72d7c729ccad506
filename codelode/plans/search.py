"""Search queries over all repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions.columns import KEYWORD_STOPWORDS, keyword_terms_of
from codelode.operators import search as S
from codelode.plans.views import sql
from codelode.sources.tables import Index

QUERIES, ORACLE = {}, {}
TEXT, NAME = "rotate the shared token buffer for orders", "drain"
_TERMS = ("rotate", "shared", "token", "buffer", "orders")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def _vector(ix: Index) -> list[float]:
    """The query vector: the embedding of the chunk with the least id that has one of the usual length."""
    return ix.raw("code_chunks").where("size(embedding) = 64").orderBy("id").select("embedding").first()[0]


_COLS = "chunk_id, repo, file_path, language, content, symbol_name, symbol_type, intent, intent_detail, start_line, end_line"
_ROWS = "c.id AS chunk_id, f.repo, f.path AS file_path, f.language, c.content, c.symbol_name, c.symbol_type, c.intent, c.intent_detail, c.start_line, c.end_line"
_SEM = f"""
sem AS (SELECT * FROM (
  SELECT {_ROWS}, round(list_cosine_similarity(c.embedding::DOUBLE[], (SELECT embedding FROM code_chunks WHERE len(embedding) = 64 ORDER BY id LIMIT 1)::DOUBLE[]), 9) AS similarity
  FROM c JOIN f ON c.file_id = f.id WHERE len(c.embedding) = 64 AND len(list_filter(c.embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(c.embedding, lambda x: x <> 0)) > 0)
  WHERE similarity > 0.3 ORDER BY similarity DESC, chunk_id LIMIT {{n}})
"""
_POINTS = " + ".join(
    f"(CASE WHEN c.content ILIKE '%{t}%' THEN 1 ELSE 0 END + CASE WHEN coalesce(c.symbol_name, '') ILIKE '%{t}%' THEN 3 ELSE 0 END + CASE WHEN f.path ILIKE '%{t}%' THEN 2 ELSE 0 END)" for t in _TERMS
)
_KEY = f"""
key AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY keyword_score DESC, file_path, start_line, chunk_id) AS place FROM (
  SELECT {_ROWS}, {_POINTS} AS keyword_score FROM c JOIN f ON c.file_id = f.id) WHERE keyword_score > 0) WHERE place <= 30)
"""
_ROUND = "similarity"


def _rounded(df):
    return df.withColumn(_ROUND, F.round(_ROUND, 6))


_STOP = ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS)
query("q_keyword_terms", f"""
WITH w AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3 AND NOT list_contains([{_STOP}], x)) AS t FROM eval_items),
o AS (SELECT item_id, word, min(pos) AS pos FROM (SELECT item_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM w) GROUP BY ALL)
SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM o) WHERE n <= 6 GROUP BY item_id""")(
    lambda ix: ix.raw("eval_items").distinct().select("item_id", F.array_join(keyword_terms_of(F.col("text")), " ").alias("terms")).where("terms <> ''"))
query("q_search_code", sql("," + _SEM.format(n=20) + f"SELECT {_COLS}, round(similarity, 6) AS similarity FROM sem"))(lambda ix: _rounded(S.search_code(ix, _vector(ix))))
query("q_keyword_search", sql("," + _KEY + f"SELECT {_COLS}, keyword_score, place FROM key"))(lambda ix: S.keyword_search(ix, TEXT))
query("q_semantic_search", sql("," + _SEM.format(n=10) + "," + _KEY + f""",
both_ AS (SELECT coalesce(sem.chunk_id, key.chunk_id) AS chunk_id, {", ".join(f"coalesce(sem.{x}, key.{x}) AS {x}" for x in _COLS.split(", ")[1:])}, sem.similarity, key.keyword_score,
  CASE WHEN sem.chunk_id IS NOT NULL AND key.chunk_id IS NOT NULL THEN 'hybrid' WHEN sem.chunk_id IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS match
  FROM sem FULL JOIN key ON sem.chunk_id = key.chunk_id)
SELECT * EXCLUDE (similarity), round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY coalesce(similarity, -1) DESC, coalesce(keyword_score, 0) DESC, file_path, start_line, chunk_id) AS place FROM both_) WHERE place <= 10"""))(
    lambda ix: _rounded(S.semantic_search(ix, TEXT, _vector(ix))))

_SYM = "s.id AS symbol_id, s.file_id, s.name, s.qualified_name, s.kind, s.signature, s.docstring, s.start_line, s.end_line, s.is_exported, s.container_symbol, s.declared_in_extension, s.is_primary_declaration, f.repo, f.path AS file_path"
_DECL = "CASE WHEN is_primary_declaration THEN 0 ELSE 1 END, CASE WHEN declared_in_extension THEN 1 ELSE 0 END"
query("q_find_symbol", sql(f""",
x AS (SELECT {_SYM}, CASE WHEN name = '{NAME}' THEN 0 WHEN lower(name) = '{NAME}' THEN 1 WHEN coalesce(qualified_name, '') = '{NAME}' THEN 2 WHEN coalesce(qualified_name, '') ILIKE '%:{NAME}' THEN 3
  WHEN coalesce(signature, '') ILIKE '{NAME}%' THEN 4 WHEN name ILIKE '{NAME}%' THEN 5 WHEN coalesce(qualified_name, '') ILIKE '%{NAME}%' THEN 6 WHEN coalesce(signature, '') ILIKE '%{NAME}%' THEN 7 ELSE 8 END AS rank
  FROM s JOIN f ON s.file_id = f.id WHERE name ILIKE '%{NAME}%' OR coalesce(qualified_name, '') ILIKE '%{NAME}%' OR coalesce(signature, '') ILIKE '%{NAME}%')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, {_DECL}, CASE WHEN kind IN ('class', 'struct', 'protocol', 'interface', 'enum', 'extension') THEN 0 ELSE 1 END, is_exported DESC, file_path, start_line, symbol_id) AS place FROM x) WHERE place <= 25"""))(
    lambda ix: S.find_symbol(ix, NAME))
query("q_exact_symbol", sql(f""",
x AS (SELECT {_SYM} FROM s JOIN f ON s.file_id = f.id WHERE lower(name) = 'drainledger' OR coalesce(qualified_name, '') ILIKE '%ledger' OR coalesce(signature, '') ILIKE 'def drain%')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN lower(name) = 'ledger' THEN 0 ELSE 1 END, {_DECL}, is_exported DESC, file_path, start_line, symbol_id) AS place FROM x WHERE coalesce(qualified_name, '') ILIKE '%ledger' OR lower(name) = 'ledger' OR coalesce(signature, '') ILIKE 'ledger%') WHERE place <= 25"""))(
    lambda ix: S.exact_symbol(ix, "ledger"))
query("q_find_symbol_fn", sql(f"SELECT {_SYM}, CASE WHEN name = '{NAME}' THEN 0 WHEN name ILIKE '{NAME}' THEN 1 ELSE 2 END AS rank FROM s JOIN f ON s.file_id = f.id WHERE name ILIKE '%{NAME}%'"))(
    lambda ix: S.find_symbol_everywhere(ix, NAME))
_REFS = """,
decl AS (SELECT f.repo, s.name_lc, string_agg(DISTINCT f.path, ',' ORDER BY f.path) AS target_paths FROM s JOIN f ON s.file_id = f.id GROUP BY ALL),
site AS (SELECT DISTINCT f.repo, r.name_lc, f.path AS source_path, r.line_no, r.reference_kind, r.source_symbol_name FROM r JOIN f ON r.source_file_id = f.id WHERE r.name_lc IS NOT NULL)
SELECT site.*, coalesce(target_paths, '') AS target_paths FROM site LEFT JOIN decl ON site.repo = decl.repo AND site.name_lc = decl.name_lc
"""
query("q_find_references", sql(_REFS))(S.find_references)
query("x_resolve_symbol", sql(f"""
SELECT name_lc, id AS symbol_id, file_id, name FROM (SELECT *, row_number() OVER (PARTITION BY name_lc ORDER BY {_DECL}, CASE WHEN is_exported THEN 0 ELSE 1 END, coalesce(start_line, 2147483647), id) AS n FROM s WHERE name_lc IS NOT NULL) WHERE n = 1"""))(S.resolve_symbols)
query("x_resolve_symbol_in_repo", sql(f"""
SELECT repo, name_lc, id AS symbol_id, file_id, name FROM (SELECT s.*, f.repo, row_number() OVER (PARTITION BY f.repo, name_lc ORDER BY {_DECL}, CASE WHEN is_exported THEN 0 ELSE 1 END, coalesce(start_line, 2147483647), s.id) AS n FROM s JOIN f ON s.file_id = f.id WHERE name_lc IS NOT NULL) WHERE n = 1"""))(
    lambda ix: S.resolve_symbols(ix, True))
