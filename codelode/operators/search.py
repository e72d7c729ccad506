"""Vector, keyword, hybrid and symbol search.

With ``repo=None`` a search covers all repositories and ranks within each: a top-k per repository instead of one overall.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.columns import CONTAINER_KINDS, contains, cosine, joined, keyword_terms, literal_pattern, under
from codelode.sources.tables import Index

_CHUNK = ["file_path", "language", "content", "symbol_name", "symbol_type", "intent", "intent_detail", "start_line", "end_line"]


_TEXT = ["content", "symbol_name", "symbol_type", "intent", "intent_detail", "start_line", "end_line"]


def _files(ix: Index, repo: str | None, language: str | None, path_prefix: str | None) -> DataFrame:
    files = ix.files("id", "repo", "path", "language").select(F.col("id").alias("file_id"), "repo", F.col("path").alias("file_path"), "language")
    files = files.where(F.col("repo") == repo) if repo else files
    files = files.where(F.col("language") == language) if language else files
    return files.where(under(F.col("file_path"), path_prefix)) if path_prefix else files


def _with_text(ix: Index, found: DataFrame) -> DataFrame:
    """The few rows that were found with the columns of their chunks; texts and vectors of all others are never moved."""
    rows = ix.raw("code_chunks").select(F.col("id").alias("chunk_id"), *_TEXT).join(found, "chunk_id")
    return rows.dropDuplicates(["chunk_id"])


def search_code(
    ix: Index, query: list[float], limit: int = 20, threshold: float = 0.3, repo: str | None = None, intent: str | None = None, language: str | None = None,
    path_prefix: str | None = None, symbol_type: str | None = None,
) -> DataFrame:
    """The chunks most similar to a vector, similarity strictly above the threshold.

    An exact scan: similarities are computed in the scan, only ids above the threshold are shuffled to drop repeats, and the
    texts of the top rows are fetched last.
    """
    rows = ix.raw("code_chunks").where("id is not null")
    rows = rows.where(F.col("intent") == intent) if intent else rows
    rows = rows.where(F.col("symbol_type") == symbol_type) if symbol_type else rows
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col("id").alias("chunk_id"), "file_id", cosine(F.col("embedding"), vector).alias("similarity")).where(F.col("similarity") > threshold)
    top = scored.dropDuplicates(["chunk_id"]).join(_files(ix, repo, language, path_prefix), "file_id").orderBy(F.desc("similarity"), "chunk_id").limit(limit)
    return _with_text(ix, top).select("chunk_id", "repo", *_CHUNK, "similarity").orderBy(F.desc("similarity"), "chunk_id")


def _best(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each repository; Spark limits within the tasks before it shuffles."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= limit)


def keyword_search(
    ix: Index, text: str, limit: int = 10, repo: str | None = None, intent: str | None = None, language: str | None = None, path_prefix: str | None = None
) -> DataFrame:
    """Chunks whose content, symbol or path holds a term: 1, 3 and 2 points a term; max(3 x limit, 20) per repository."""
    terms = keyword_terms(text)

    def points(*weighted: tuple[Column, int]) -> Column:
        hits = [F.when(F.ilike(c, F.lit(literal_pattern(t))), n).otherwise(0) for t in terms for c, n in weighted]
        return reduce(Column.__add__, hits) if hits else F.lit(0)

    rows = ix.raw("code_chunks").where("id is not null")
    rows = rows.where(F.col("intent") == intent) if intent else rows
    own = points((F.col("content"), 1), (F.coalesce("symbol_name", F.lit("")), 3))
    rows = rows.select(F.col("id").alias("chunk_id"), "file_id", F.col("start_line").alias("line"), own.alias("own")).dropDuplicates(["chunk_id"])
    both = rows.join(_files(ix, repo, language, path_prefix), "file_id").withColumn("keyword_score", F.col("own") + points((F.col("file_path"), 2))).where("keyword_score > 0")
    best = _best(both.drop("own"), max(3 * limit, 20), F.desc("keyword_score"), F.col("file_path"), F.col("line"), F.col("chunk_id"))
    return _with_text(ix, best).select("chunk_id", "repo", *_CHUNK, "keyword_score", "place")


def semantic_search(ix: Index, text: str, query: list[float], limit: int = 10, threshold: float = 0.3, **filters: str | None) -> DataFrame:
    """Vector and keyword search merged by chunk: most similar first, then keyword matches; ``match`` says which found it."""
    semantic = search_code(ix, query, limit, threshold, **filters)
    keyword = keyword_search(ix, text, limit, **filters).drop("place")
    both = semantic.withColumnRenamed("repo", "repo_s").alias("s").join(keyword.alias("k"), "chunk_id", "full_outer")
    rows = both.select(
        "chunk_id", F.coalesce("s.repo_s", "k.repo").alias("repo"), *[F.coalesce(f"s.{c}", f"k.{c}").alias(c) for c in _CHUNK], "similarity", "keyword_score",
        F.when(F.col("similarity").isNotNull() & F.col("keyword_score").isNotNull(), "hybrid").when(F.col("similarity").isNotNull(), "semantic").otherwise("keyword").alias("match"),
    )
    order = [F.desc(F.coalesce("similarity", F.lit(-1.0))), F.desc(F.coalesce("keyword_score", F.lit(0))), F.col("file_path"), F.col("start_line"), F.col("chunk_id")]
    return _best(rows, limit, *order)


_SYMBOL = "name qualified_name kind signature docstring start_line end_line is_exported container_symbol declared_in_extension is_primary_declaration".split()


def _symbols(ix: Index, repo: str | None, kind: str | None, file: str | None) -> DataFrame:
    files = ix.files("id", "repo", "path").select(F.col("id").alias("file_id"), "repo", F.col("path").alias("file_path"))
    files = files.where(F.col("repo") == repo) if repo else files
    files = files.where(contains(F.col("file_path"), file)) if file else files
    symbols = ix.symbols("id", "file_id", *_SYMBOL).withColumnRenamed("id", "symbol_id")
    symbols = symbols.where(F.col("kind") == kind) if kind else symbols
    return symbols.join(files, "file_id")


def _declared_first() -> list[Column]:
    """Primary declarations before others, extensions last."""
    return [F.when(F.col("is_primary_declaration"), 0).otherwise(1), F.when(F.col("declared_in_extension"), 1).otherwise(0)]


def find_symbol(ix: Index, name: str, kind: str | None = None, file: str | None = None, repo: str | None = None, limit: int = 25) -> DataFrame:
    """Symbols whose name, qualified name or signature contains ``name``, in nine ranks from equal to mentioned."""
    n, q, s = F.col("name"), F.coalesce("qualified_name", F.lit("")), F.coalesce("signature", F.lit(""))
    like = lambda c, p: F.ilike(c, F.lit(p))
    rank = (
        F.when(n == name, 0).when(F.lower(n) == name.lower(), 1).when(q == name, 2).when(like(q, f"%:{name}"), 3).when(like(s, f"{name}%"), 4)
        .when(like(n, f"{name}%"), 5).when(like(q, f"%{name}%"), 6).when(like(s, f"%{name}%"), 7).otherwise(8)
    )
    found = _symbols(ix, repo, kind, file).where(like(n, f"%{name}%") | like(q, f"%{name}%") | like(s, f"%{name}%")).withColumn("rank", rank)
    container = F.when(F.col("kind").isin(*CONTAINER_KINDS), 0).otherwise(1)
    return _best(found, limit, F.col("rank"), *_declared_first(), container, F.desc("is_exported"), F.col("file_path"), F.col("start_line"), F.col("symbol_id"))


def exact_symbol(ix: Index, name: str, kind: str | None = None, file: str | None = None, repo: str | None = None, limit: int = 25) -> DataFrame:
    """Symbols of that name ignoring case, or whose qualified name ends or signature begins with it."""
    same = F.lower("name") == name.lower()
    found = _symbols(ix, repo, kind, file).where(
        same | F.ilike(F.coalesce("qualified_name", F.lit("")), F.lit(f"%{name}")) | F.ilike(F.coalesce("signature", F.lit("")), F.lit(f"{name}%"))
    )
    return _best(found, limit, F.when(same, 0).otherwise(1), *_declared_first(), F.desc("is_exported"), F.col("file_path"), F.col("start_line"), F.col("symbol_id"))


def find_symbol_everywhere(ix: Index, name: str, kind: str | None = None, file: str | None = None) -> DataFrame:
    """The unscoped variant: names that contain ``name``, in three ranks, without limit."""
    rank = F.when(F.col("name") == name, 0).when(F.ilike("name", F.lit(name)), 1).otherwise(2)
    return _symbols(ix, None, kind, file).where(F.ilike("name", F.lit(f"%{name}%"))).withColumn("rank", rank)


def find_references(ix: Index, name: str | None = None, file: str | None = None, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """Places that refer to a name, ignoring case, with the paths in the same repository that declare it; all names if None.

    Declarations are gathered to one row per repository and name before the join, so popular names don't multiply.
    """
    files = ix.files("id", "repo", "path")
    files = files.where(F.col("repo") == repo) if repo else files
    declared = ix.symbols("id", "file_id", "name").withColumn("name_lc", F.lower("name")).where("name_lc is not null").select("file_id", "name_lc").distinct()
    declared = declared.join(files.withColumnRenamed("id", "file_id"), "file_id").groupBy("repo", "name_lc").agg(joined(F.collect_set("path")).alias("target_paths"), F.collect_set("path").alias("paths"))
    refs = ix.references("id", "source_file_id", "source_symbol_name", "target_name", "reference_kind", "line_no").withColumn("name_lc", F.lower("target_name"))
    refs = refs.where(F.col("name_lc") == name.lower()) if name else refs.where("name_lc is not null")
    sites = refs.join(files.select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("source_path")), "source_file_id")
    sites = sites.select("repo", "name_lc", "source_path", "line_no", "reference_kind", "source_symbol_name").distinct()
    found = sites.join(declared, ["repo", "name_lc"], "left")
    found = found.where(F.exists("paths", lambda p: contains(p, file))) if file else found
    found = found.select("repo", "name_lc", "source_path", "line_no", "reference_kind", "source_symbol_name", F.coalesce("target_paths", F.lit("")).alias("target_paths"))
    return found if limit is None else _best(found, limit, F.col("source_path"), F.col("line_no"), F.col("reference_kind"), F.col("source_symbol_name")).drop("place")


def resolve_symbols(ix: Index, by_repo: bool = False) -> DataFrame:
    """(name_lc, symbol_id, file_id[, repo]): the declaration each name resolves to: primary, not in an extension, exported, first line."""
    symbols = ix.symbols("id", "file_id", "name", "is_primary_declaration", "declared_in_extension", "is_exported", "start_line").withColumn("name_lc", F.lower("name")).where("name_lc is not null")
    keys = ["name_lc"]
    if by_repo:
        symbols, keys = symbols.join(ix.files("id", "repo").withColumnRenamed("id", "file_id"), "file_id"), ["repo", "name_lc"]
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*_declared_first(), F.when(F.col("is_exported"), 0).otherwise(1), F.coalesce("start_line", F.lit(2**31 - 1))])], F.col("id").alias("symbol_id"), "file_id", "name"))
    return symbols.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.symbol_id", "b.file_id", "b.name")
