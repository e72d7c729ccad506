"""The training-data queries pN_... and the SQL oracles of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.docpairs import source_pairs, symbol_pairs
from codelode.llm.leaks import leaks
from codelode.llm.neighbours import copies, nearest, similar_pairs, topk
from codelode.llm.packing import pack_documents
from codelode.llm.provenance import conventions, not_hand_written
from codelode.llm.secrets import find_secrets, redact
from codelode.llm.spans import shared_chars, shared_spans
from codelode.llm.splitting import split_oversized
from codelode.llm.syntax import parse_files, parse_rates
from codelode.sources.tables import stored_files, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that come out of the splitter in more than one piece."""
    pieces = split_oversized(table(spark, root, "code_chunks"))
    return pieces.where("piece_index = 0").select("id").distinct()


@query
def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every oversized chunk."""
    return split_oversized(table(spark, root, "code_chunks")).dropDuplicates(["id", "piece_index"])


@query
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Functions and methods whose documentation describes them."""
    return symbol_pairs(table(spark, root, "symbols"), _texts(spark, root)).select("id")


@query
def p2_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of code and description."""
    return symbol_pairs(table(spark, root, "symbols"), _texts(spark, root))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    files = stored_files(table(spark, root, "files"), "id", "repo", "path", "language", "size_bytes", "line_count")
    return table(spark, root, "source_texts").join(files, F.col("file_id") == F.col("id")).drop("id")


@query
def p2_source_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Documented functions found in the source texts themselves."""
    return source_pairs(_texts(spark, root))


def _scored(spark: SparkSession, root: str) -> DataFrame:
    files = stored_files(table(spark, root, "files"), "id", "path", "size_bytes", "line_count")
    return not_hand_written(files, table(spark, root, "source_texts"))


@query
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that nobody wrote by hand in their repository."""
    return _scored(spark, root).where(~F.col("hand_written")).select("id")


@query
def p3_conventions(spark: SparkSession, root: str) -> DataFrame:
    """The convention every file follows, by path and size alone; null for none."""
    return conventions(stored_files(table(spark, root, "files"), "id", "path", "size_bytes", "line_count"))


@query
def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    """Per repository and language, how many files there are and how many of them are written by hand."""
    files = stored_files(table(spark, root, "files"), "id", "repo", "language")
    both = files.join(_scored(spark, root), "id")
    return both.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.col("hand_written").cast("long")).alias("hand_written"))


@query
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Files whose text is no valid file of their language."""
    return parse_files(_texts(spark, root)).where(~F.col("valid")).select("file_id")


@query
def p5_failures(spark: SparkSession, root: str) -> DataFrame:
    """Where and why they fail."""
    return parse_files(_texts(spark, root)).where(~F.col("valid"))


@query
def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """The rates per repository and language."""
    return parse_rates(parse_files(_texts(spark, root)), stored_files(table(spark, root, "files"), "id", "repo"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    owned = [table(spark, root, t).select(F.lit(t).alias("owner"), "id", "embedding") for t in ("code_chunks", "files", "symbols")]
    return owned[0].unionByName(owned[1]).unionByName(owned[2])


@query
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of rows of one table with a similarity of at least 0.95, each among the other's five most similar."""
    return similar_pairs(_vectors(spark, root)).where("mutual").select("owner", "id_a", "id_b")


@query
def p6_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar rows of every row whose id is divisible by 100, against all rows of its table."""
    vectors = _vectors(spark, root)
    return nearest(vectors.where("id % 100 = 0"), vectors).withColumn("similarity", F.round("similarity", 5))


@query
def p6_topk(spark: SparkSession, root: str) -> DataFrame:
    """The same rows through the index: approximate where it brings k rows, exact where it does not."""
    vectors = _vectors(spark, root)
    return topk(vectors.where("id % 100 = 0"), vectors).withColumn("similarity", F.round("similarity", 5))


@query
def p6_copies(spark: SparkSession, root: str) -> DataFrame:
    """The group of equal vectors that every row belongs to, where there is more than one."""
    return copies(_vectors(spark, root)).where("size > 1")


@query
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The lines of chunks where a credential starts."""
    found = find_secrets(table(spark, root, "code_chunks").select("id", "content"))
    return found.select(F.col("id").alias("chunk_id"), F.col("line").cast("long").alias("line_in_chunk")).distinct()


@query
def p7_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that hold credentials, with the values blanked."""
    return redact(table(spark, root, "code_chunks").select("id", "content")).where("n_secrets > 0").dropDuplicates(["id"])


@query
def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    """The container of every document or piece of one."""
    return pack_documents(table(spark, root, "documents"))


@query
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a passage of twelve consecutive words of an evaluation item without an edit."""
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).where("passage_edits = 0").select("doc_id", "item_id")


@query
def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """Per evaluation item in how many documents it leaked, word for word or within its error budgets, the longest exact run and the closest copy."""
    found = leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))
    exact = F.sum((F.coalesce("passage_edits", F.lit(1)) == 0).cast("long")).alias("exact_documents")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), exact, F.max("run").alias("longest_run"), F.min("distance").alias("least_edits"))


@query
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a stretch of 300 characters that another document holds too, and how much of them is shared."""
    return shared_chars(table(spark, root, "documents")).select("doc_id", "shared_chars")


@query
def p10_spans(spark: SparkSession, root: str) -> DataFrame:
    """The shared stretches themselves."""
    return shared_spans(table(spark, root, "documents"))


ORACLE["p1_found"] = """
SELECT DISTINCT id FROM code_chunks
WHERE length(content) > 4000 OR len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) > 512
"""

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
ORACLE["p9_found"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
"""

_USABLE = " UNION ALL ".join(
    f"SELECT DISTINCT ON (id) '{t}' AS owner, id, embedding::DOUBLE[] AS e FROM {t} WHERE id IS NOT NULL AND len(embedding) = 64 "
    "AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    for t in ("code_chunks", "files", "symbols")
)
_SIMILAR = f"""
WITH v AS ({_USABLE}), u AS (SELECT owner, id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
"""
# all pairs: the brute force that the index is measured against
ORACLE["p6_found"] = _SIMILAR + """,
p AS (SELECT a.owner, a.id AS me, b.id AS you, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.owner = b.owner AND a.id <> b.id),
t AS (SELECT owner, me, you, s FROM p QUALIFY row_number() OVER (PARTITION BY owner, me ORDER BY s DESC, you) <= 5)
SELECT x.owner, x.me AS id_a, x.you AS id_b FROM t x JOIN t y ON x.owner = y.owner AND x.me = y.you AND x.you = y.me WHERE x.me < x.you AND x.s >= 0.95
"""
ORACLE["p6_nearest"] = _SIMILAR + """,
p AS (SELECT a.owner, a.id, b.id AS neighbour, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.owner = b.owner AND a.id <> b.id WHERE a.id % 100 = 0)
SELECT owner, id, neighbour, round(s, 5) AS similarity, row_number() OVER (PARTITION BY owner, id ORDER BY s DESC, neighbour) AS place FROM p QUALIFY place <= 5
"""
_SPANS = """
WITH x AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, unnest(range(1, length(text) - 298)) AS pos, text FROM x),
h AS (SELECT doc_id, pos, md5_number(text[pos:pos + 299]) AS k FROM w),
q AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, pos FROM h WHERE k IN (SELECT k FROM q)),
g AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 300 THEN 0 ELSE 1 END AS new FROM c)),
s AS (SELECT doc_id, min(pos) - 1 AS begin_, max(pos) + 299 AS "end" FROM g GROUP BY doc_id, island)
"""
ORACLE["p10_spans"] = _SPANS + 'SELECT doc_id, begin_ AS "start", "end" FROM s'
ORACLE["p10_found"] = _SPANS + 'SELECT doc_id, sum("end" - begin_)::BIGINT AS shared_chars FROM s GROUP BY doc_id'
