"""Catalogue and statistics queries.

Children are counted per file first and then rolled up, so no join ever fans out; every query covers all repositories at
once, one repository is a filter on the result's ``repo``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.columns import contains, directory, joined, under
from codelode.sources.tables import Index, distinct_ids


def _per_repo(ix: Index, children: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Aggregates of children per repository: partial sums per file, then one small join with the files."""
    files = ix.files("id", "repo").withColumnRenamed("id", "_file")
    return children.join(files, F.col(key) == F.col("_file")).groupBy("repo").agg(*aggs)


def list_repositories(ix: Index) -> DataFrame:
    """Totals of files, lines, chunks and symbols per repository."""
    files = ix.files("id", "repo", "line_count").groupBy("repo").agg(F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    chunks = _per_repo(ix, ix.chunks("id", "file_id"), "file_id", F.count("*").alias("total_chunks"))
    symbols = _per_repo(ix, ix.symbols("id", "file_id"), "file_id", F.count("*").alias("total_symbols"))
    return files.join(chunks, "repo", "left").join(symbols, "repo", "left").fillna(0, ["total_chunks", "total_symbols"])


def repository_exists(ix: Index, repo: str) -> bool:
    """Whether any file of the repository is stored; stops at the first."""
    return not ix.raw("files").where(F.col("repo") == repo).select("id").limit(1).isEmpty()


def histogram(ix: Index, what: str) -> DataFrame:
    """(repo, label, n) of ``languages``, ``intents`` or ``kinds``; what has no value counts as unknown or unclassified."""
    if what == "languages":
        labelled = ix.files("id", "repo", "language").select("repo", F.coalesce("language", F.lit("unknown")).alias("label"))
        return labelled.groupBy("repo", "label").agg(F.count("*").alias("n"))
    child, column, missing = {"intents": ("chunks", "intent", "unclassified"), "kinds": ("symbols", "kind", None)}[what]
    rows = getattr(ix, child)("id", "file_id", column)
    counted = rows.groupBy("file_id", F.coalesce(column, F.lit(missing)).alias("label")).agg(F.count("*").alias("c"))
    files = ix.files("id", "repo").withColumnRenamed("id", "file_id")
    return counted.join(files, "file_id").groupBy("repo", "label").agg(F.sum("c").alias("n"))


def stats_view(ix: Index) -> DataFrame:
    """One row per repository with totals and three histograms as ``label=n`` lists.

    ``fanned_lines`` is the total that joining files with chunks, symbols and dependencies would give, computed without that join.
    """
    per = [
        ix.chunks("id", "file_id").groupBy("file_id").agg(F.count("*").alias("c")),
        ix.symbols("id", "file_id").groupBy("file_id").agg(F.count("*").alias("s")),
        ix.dependencies("id", "source_file_id").groupBy(F.col("source_file_id").alias("file_id")).agg(F.count("*").alias("d")),
    ]
    files = ix.files("id", "repo", "line_count").withColumnRenamed("id", "file_id")
    for p in per:
        files = files.join(p, "file_id", "left")
    files = files.fillna(0, ["c", "s", "d"])
    fan = F.greatest(F.col("c"), F.lit(1)) * F.greatest(F.col("s"), F.lit(1)) * F.greatest(F.col("d"), F.lit(1))
    totals = files.groupBy("repo").agg(
        F.count("*").alias("total_files"), F.sum("line_count").alias("total_lines"), F.sum(F.col("line_count") * fan).alias("fanned_lines"),
        F.sum("c").alias("total_chunks"), F.sum("s").alias("total_symbols"), F.sum("d").alias("total_dependencies"),
    )
    for what, name in (("languages", "languages"), ("intents", "intents"), ("kinds", "symbol_kinds")):
        h = histogram(ix, what).where(~F.col("label").isin("unknown", "unclassified"))
        entry = F.concat_ws("=", "label", F.col("n").cast("string"))
        totals = totals.join(h.groupBy("repo").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias(name)), "repo", "left")
    return totals


def index_size(ix: Index, dimensions: int = 64) -> DataFrame:
    """Row counts and estimated bytes per repository; an embedding takes 4 bytes a number and 8 for itself."""
    files = ix.files("id", "repo").groupBy("repo").agg(F.count("*").alias("file_count"))
    measured = distinct_ids(ix.raw("code_chunks").select("id", "file_id", F.length("content").alias("chars")))  # lengths are shuffled, not texts
    chunks = _per_repo(ix, measured, "file_id", F.count("*").alias("chunk_count"), F.sum("chars").alias("content_bytes"))
    symbols = _per_repo(ix, ix.symbols("id", "file_id"), "file_id", F.count("*").alias("symbol_count"))
    refs = _per_repo(ix, ix.references("id", "source_file_id"), "source_file_id", F.count("*").alias("ref_count"))
    out = files.join(chunks, "repo", "left").join(symbols, "repo", "left").join(refs, "repo", "left")
    out = out.fillna(0, ["chunk_count", "content_bytes", "symbol_count", "ref_count"])
    embedded = F.col("chunk_count") * (dimensions * 4 + 8)
    return out.withColumn("estimated_embedding_bytes", embedded).withColumn("estimated_total_bytes", F.col("content_bytes") + embedded)


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit below 1024, one decimal."""
    out = F.format_string("%.1f GB", n / F.lit(1024.0**3))
    for limit, unit, div in ((3, "MB", 2), (2, "KB", 1)):
        out = F.when(n < 1024.0**limit, F.format_string(f"%.1f {unit}", n / F.lit(1024.0**div))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def file_map(ix: Index, path_prefix: str = "") -> DataFrame:
    """Files under a prefix with their exported symbols as ``name (kind)``; null where there are none."""
    files = ix.files("id", "repo", "path", "language", "line_count", "role", "summary").where(under(F.col("path"), path_prefix))
    exported = ix.symbols("id", "file_id", "name", "kind", "is_exported").where("is_exported and name is not null")
    exported = exported.groupBy("file_id").agg(joined(F.collect_set(F.concat("name", F.lit(" ("), "kind", F.lit(")")))).alias("symbols"))
    return files.join(exported, F.col("id") == F.col("file_id"), "left").select("repo", "path", "language", "line_count", "role", "summary", "symbols")


def get_intent(ix: Index, path: str, repo: str | None = None) -> DataFrame:
    """The sections of the first file (by path) of each repository whose path contains ``path``."""
    files = ix.files("id", "repo", "path", "summary", "role").where(contains(F.col("path"), path))
    files = files.where(F.col("repo") == repo) if repo else files
    first = files.groupBy("repo").agg(F.min(F.struct("path", "id", "summary", "role")).alias("f")).select("repo", "f.*")
    chunks = ix.chunks("id", "file_id", "chunk_index", "symbol_name", "symbol_type", "intent", "intent_detail", "start_line", "end_line").withColumnRenamed("id", "chunk_id")
    return first.join(chunks, F.col("id") == F.col("file_id")).select(
        "repo", "path", "role", "summary", "chunk_index", "symbol_name", "symbol_type", "intent", "intent_detail", "start_line", "end_line"
    )


def run_history(ix: Index, limit: int = 100, repo: str | None = None) -> DataFrame:
    """The latest runs of each repository, newest first by ``place``."""
    runs = ix.runs("id", "repo", "started_at", "completed_at", "files_processed", "chunks_created", "symbols_found", "status")
    runs = runs.where(F.col("repo") == repo) if repo else runs
    order = Window.partitionBy("repo").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def last_runs(ix: Index) -> DataFrame:
    """Each repository's latest run; a plain aggregate."""
    runs = ix.runs("id", "repo", "started_at", "status", "files_processed")
    return runs.groupBy("repo").agg(F.max(F.struct("started_at", "id", "status", "files_processed")).alias("r")).select("repo", "r.*")


def tool_calls(events: DataFrame, name: str = "event_type") -> DataFrame:
    """Calls by tool, empty names left out."""
    return events.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("calls"))


def summarize_args(df: DataFrame, *names: str) -> DataFrame:
    """``args``: the named columns as ``name=json`` joined by commas; strings over 120 characters keep 117 and three dots."""

    def one(name: str) -> Column:
        c = F.col(name)
        if dict(df.dtypes)[name] == "string":
            short = F.when(F.length(c) > 120, F.concat(F.substring(c, 1, 117), F.lit("..."))).otherwise(c)
            quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(short, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
            return F.concat(F.lit(f"{name}="), F.coalesce(quoted, F.lit("null")))
        return F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit("null")))

    return df.withColumn("args", F.concat_ws(", ", *[one(n) for n in names]))


def directory_rollup(ix: Index, min_files: int = 3) -> DataFrame:
    """Folders with at least ``min_files`` files: files, chunks and the distinct intent details of their chunks."""
    files = ix.files("id", "repo", "path").select(F.col("id").alias("file_id"), "repo", directory(F.col("path")).alias("module_path"))
    chunks = ix.chunks("id", "file_id", "intent_detail")
    per_file = chunks.groupBy("file_id").agg(F.count("*").alias("c"))
    keys = ["repo", "module_path"]
    out = files.join(per_file, "file_id", "left").groupBy(*keys).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunk_count"))
    # details are made distinct before they are gathered, so a hot folder gathers no repeats
    details = chunks.where("intent_detail is not null").select("file_id", "intent_detail").distinct().join(files, "file_id").select(*keys, "intent_detail").distinct()
    told = details.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("intent_detail")), " | ").alias("intent_details"))
    kept = out.where(F.col("file_count") >= min_files).join(told, keys, "left")
    return kept.withColumn("intent_details", F.coalesce("intent_details", F.lit("")))


def dominant_intent(ix: Index) -> DataFrame:
    """(repo, module_path, dominant_intent): the most frequent intent of each folder's chunks, ties by name."""
    files = ix.files("id", "repo", "path").select(F.col("id").alias("file_id"), "repo", directory(F.col("path")).alias("module_path"))
    counts = ix.chunks("id", "file_id", "intent").where("intent is not null").groupBy("file_id", "intent").agg(F.count("*").alias("c"))
    n = counts.join(files, "file_id").groupBy("repo", "module_path", "intent").agg(F.sum("c").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("intent").alias("intent")))
    return n.groupBy("repo", "module_path").agg(best.alias("b")).select("repo", "module_path", F.col("b.intent").alias("dominant_intent"))


def module_map(ix: Index, min_files: int = 3, path_prefix: str = "") -> DataFrame:
    """Module rows of kind ``directory`` as the offline synthesis writes them."""
    out = directory_rollup(ix, min_files).where(under(F.col("module_path"), path_prefix)).join(dominant_intent(ix), ["repo", "module_path"], "left")
    name = F.element_at(F.split("module_path", "/"), -1)
    return out.select("repo", "module_path", F.lit("directory").alias("kind"), name.alias("module_name"), "dominant_intent", "file_count", "chunk_count")
