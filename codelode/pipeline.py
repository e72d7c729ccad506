"""Ingestion and synthesis over a versioned index: what the command line runs.

One ingestion of a repository: walk, leave out what did not change, split into chunks, name symbols, references and edges,
enrich, and commit all tables at once. Rows of other repositories are carried over untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.operators import enrichment, extraction, maintenance, synthesis
from codelode.operators.catalogue import dominant_intent, directory_rollup
from codelode.operators.chunking import chunk_files, chunk_symbols
from codelode.operators.search import resolve_symbols
from codelode.sources.repository import Settings, git_ignored, walk, without_ignored
from codelode.sources.tables import Index
from codelode.workspace import settled, ship

SCHEMAS = {
    "files": "id long, repo string, path string, language string, size_bytes int, line_count int, hash string, summary string, role string, embedding array<float>, indexed_at timestamp",
    "code_chunks": "id long, file_id long, chunk_index int, content string, start_line int, end_line int, symbol_name string, symbol_type string, parent_symbol string, intent string, intent_detail string, embedding array<float>, created_at timestamp",
    "symbols": (
        "id long, file_id long, chunk_id long, name string, qualified_name string, kind string, signature string, docstring string, start_line int, end_line int, parent_id long, container_symbol string, visibility string, "
        "is_exported boolean, declared_in_extension boolean, is_primary_declaration boolean, embedding array<float>, created_at timestamp"
    ),
    "symbol_references": "id long, source_file_id long, source_chunk_id long, source_symbol_name string, target_name string, reference_kind string, line_no int, created_at timestamp",
    "dependencies": "id long, source_file_id long, target_file_id long, source_symbol_id long, target_symbol_id long, kind string, external_module string, created_at timestamp",
    "ingestion_runs": "id long, repo string, started_at timestamp, completed_at timestamp, files_processed int, chunks_created int, symbols_found int, status string",
    "module_intents": "repo string, module_path string, kind string, module_name string, summary string, role string, dominant_intent string, file_count long, chunk_count long, member_symbols string, updated_at timestamp",
}


class StoredIndex(Index):
    """The current snapshot of a versioned index under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.snapshots = maintenance.Snapshots(spark, root)

    def raw(self, name: str) -> DataFrame:
        if name not in self.snapshots.versions():
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.snapshots.read(name)


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of a table, missing ones null."""
    fields = T._parse_datatype_string(SCHEMAS[name]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _with_ids(df: DataFrame, before: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ids above those in ``before``, in the order given."""
    top = before.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return maintenance.numbered(df, order).crossJoin(F.broadcast(top)).withColumn("id", F.col("n") + F.col("_top")).drop("n", "_top")  # one row


def ingest(
    spark: SparkSession, source: str, root: str, repo: str | None = None, settings: Settings | None = None, force: bool = False, classify: bool = True, provider: Callable[[], object] = enrichment.Offline,
    ignored: list[str] | None = None, gitignore: bool = True,
) -> dict[str, int]:
    """Bring the index at ``root`` up to date with the folder ``source``; counters by status.

    Left out are the paths in ``ignored`` and, in a work tree of git on the driver's disk, those that git ignores.
    """
    ship(spark)
    settings, repo = settings or Settings(), repo or source.rstrip("/").rsplit("/", 1)[-1]
    ix = StoredIndex(spark, root)
    run_id = (ix.raw("ingestion_runs").agg(F.max("id")).first()[0] or 0) + 1
    started = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    _write_run(ix, (run_id, repo, started, None, None, None, None, "running"))
    now = settled(walk(spark, source, settings).withColumn("repo", F.lit(repo)), "walk")
    left_out = [*(ignored or []), *(git_ignored(now, source) if gitignore else ())]
    if left_out:
        now = without_ignored(now, spark.createDataFrame([(p,) for p in left_out], "path string"))
    stored = ix.files()
    own = stored.where(F.col("repo") == repo)
    state = settled(maintenance.skip_unchanged(own.select("repo", "path", "hash"), now.select("repo", "path", "hash"), force), "status")
    gone = maintenance.prune(own.select("id", "repo", "path"), now.select("repo", "path"))
    fresh = now.join(state.where("status = 'indexed'").select("path"), "path", "left_semi")
    known = fresh.join(own.select("path", "id"), "path", "left")
    fresh = known.where("id is not null").unionByName(_with_ids(known.where("id is null").drop("id"), stored.select("id"), ["repo", "path"]).select(*known.columns))
    fresh = enrichment.analyze_files(fresh, provider).drop("warning") if classify else fresh.withColumns({"summary": F.lit(""), "role": F.lit("unknown")})
    fresh = settled(enrichment.embed(fresh.withColumn("_text", enrichment.file_text(F.col("path"), F.col("summary"))), "_text", provider).drop("_text").withColumn("indexed_at", F.current_timestamp()), "files")
    files = stored.join(gone.select("id"), "id", "left_anti").join(fresh.select("id"), "id", "left_anti").unionByName(_shaped(fresh, "files"))

    texts = fresh.select(F.col("id").alias("file_id"), "path", "language", "content")
    parts = settled(chunk_files(texts, settings.chunk_size, settings.overlap), "chunks")
    chunks = _with_ids(parts, ix.raw("code_chunks"), ["file_id", "chunk_index"])
    chunks = enrichment.classify(chunks, provider=provider) if classify else chunks.withColumns({"intent": F.lit("utility"), "intent_detail": F.lit("")})
    chunks = chunks.join(texts.select("file_id", "path"), "file_id").withColumn("_text", enrichment.chunk_input(F.col("path"), F.col("content")))
    chunks = settled(enrichment.embed(chunks, "_text", provider).drop("_text").withColumn("created_at", F.current_timestamp()), "chunks")
    symbols = chunk_symbols(parts).join(chunks.select("file_id", "chunk_index", F.col("id").alias("chunk_id")), ["file_id", "chunk_index"])
    symbols = _with_ids(symbols, ix.raw("symbols"), ["file_id", "start_line", "name", "end_line"])
    symbols = extraction.symbol_rows(symbols).withColumnRenamed("resolved_parent_id", "parent_id")
    symbols = enrichment.embed(symbols.withColumn("_text", enrichment.symbol_text(F.col("kind"), F.col("name"), F.col("docstring"))), "_text", provider).drop("_text")
    symbols = settled(symbols.withColumn("created_at", F.current_timestamp()), "symbols")
    refs = extraction.references(chunks).join(chunks.select(F.col("id").alias("chunk_id"), F.col("file_id").alias("source_file_id")), "chunk_id").withColumnRenamed("chunk_id", "source_chunk_id")
    refs = _with_ids(refs, ix.raw("symbol_references"), ["source_file_id", "line_no", "target_name", "reference_kind", "source_chunk_id"]).withColumn("created_at", F.current_timestamp())

    tables = {"code_chunks": ix.raw("code_chunks"), "symbols": ix.raw("symbols"), "symbol_references": ix.raw("symbol_references"), "dependencies": ix.raw("dependencies")}
    changed = fresh.select(F.col("id").alias("file_id"))
    kept = maintenance.cascade(tables, files, changed)
    all_symbols = kept["symbols"].unionByName(_shaped(symbols, "symbols"))
    moved = _relinked(tables["dependencies"], tables["symbols"], changed, files, all_symbols)
    deps = _with_ids(_dependencies(texts, chunks, symbols, all_symbols), ix.raw("dependencies"), ["source_file_id", "kind", "external_module", "target_symbol_id", "source_symbol_id"]).withColumn("created_at", F.current_timestamp())
    ix.snapshots.commit({
        "files": files, "code_chunks": kept["code_chunks"].unionByName(_shaped(chunks, "code_chunks")), "symbols": all_symbols, "symbol_references": kept["symbol_references"].unionByName(_shaped(refs, "symbol_references")),
        "dependencies": kept["dependencies"].unionByName(_shaped(moved, "dependencies")).unionByName(_shaped(deps, "dependencies")),
    })
    counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
    out = {"indexed": counts.get("indexed", 0), "skipped": counts.get("skipped", 0), "deleted": gone.count(), "errors": 0, "chunks": chunks.count(), "symbols": symbols.count()}
    _write_run(ix, (run_id, repo, started, spark.sql("SELECT current_timestamp() AS t").first()["t"], out["indexed"] + out["skipped"], out["chunks"], out["symbols"], "completed"))
    return out


def _dependencies(texts: DataFrame, chunks: DataFrame, symbols: DataFrame, all_symbols: DataFrame) -> DataFrame:
    """Imports (external, resolved late by name) and service edges with their symbols."""
    found = extraction.imports(texts).select(F.col("file_id").alias("source_file_id"), F.col("module").alias("external_module"), "kind").distinct()
    imports = found.withColumns({c: F.lit(None).cast("long") for c in ("target_file_id", "source_symbol_id", "target_symbol_id")})
    edges = extraction.service_edges(texts.where("language = 'swift'"), chunks.select("id", "file_id", "start_line", "end_line", "symbol_name", "symbol_type", "parent_symbol"))
    names = symbols.groupBy("file_id", F.col("name").alias("source_symbol_name")).agg(F.min("id").alias("source_symbol_id"))
    view = _Symbols(all_symbols)
    target = resolve_symbols(view).select("name_lc", F.col("symbol_id").alias("target_symbol_id"), F.col("file_id").alias("target_file_id"))
    edges = edges.join(names, ["file_id", "source_symbol_name"], "left").withColumn("name_lc", F.lower("target_name")).join(target, "name_lc", "left")
    external = F.when(F.col("target_symbol_id").isNull(), F.col("target_name"))
    edges = edges.select(F.col("file_id").alias("source_file_id"), external.alias("external_module"), "kind", "target_file_id", "source_symbol_id", "target_symbol_id").distinct()
    return imports.unionByName(edges)


def _relinked(deps: DataFrame, old: DataFrame, changed: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of unchanged files to symbols of re-indexed ones, resolved again: those symbols have new ids now.

    Where the name is declared no more it becomes an external one, so the edge can be resolved late.
    """
    renewed = changed.distinct()
    names = old.join(renewed, "file_id", "left_semi").select(F.col("id").alias("target_symbol_id"), F.col("name").alias("_name")).dropDuplicates(["target_symbol_id"])
    source = files.select(F.col("id").alias("source_file_id")).join(renewed.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti")
    lost = deps.join(source, "source_file_id", "left_semi").join(names, "target_symbol_id").drop("target_symbol_id", "target_file_id")
    target = resolve_symbols(_Symbols(symbols)).select("name_lc", F.col("symbol_id").alias("target_symbol_id"), F.col("file_id").alias("target_file_id"))
    found = lost.withColumn("name_lc", F.lower("_name")).join(target, "name_lc", "left")
    return found.withColumn("external_module", F.when(F.col("target_symbol_id").isNull(), F.col("_name")).otherwise(F.col("external_module")))


class _Symbols:
    """Symbols that are not stored yet, as a view for the resolver."""

    def __init__(self, df: DataFrame):
        self.df = df

    def symbols(self, *columns: str) -> DataFrame:
        return self.df.select(*columns)


def _write_run(ix: StoredIndex, row: tuple) -> None:
    fresh = ix.spark.createDataFrame([row], SCHEMAS["ingestion_runs"])
    ix.snapshots.commit({"ingestion_runs": settled(ix.raw("ingestion_runs").where(F.col("id") != row[0]).unionByName(fresh), "runs")})


def synthesize(spark: SparkSession, root: str, mode: str = "all", min_files: int = 3, resolution: float = 1.5, most: int = 20, percentile: float = 90.0) -> int:
    """Write module rows of kind directory, logical or both for every repository; how many there are."""
    if mode not in ("directory", "logical", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    ix = StoredIndex(spark, root)
    modules, repos = ix.raw("module_intents"), ix.files("repo")
    stamp = F.current_timestamp().alias("updated_at")
    if mode in ("directory", "all"):
        d = directory_rollup(ix, min_files).join(dominant_intent(ix), ["repo", "module_path"], "left")
        d = d.select("repo", "module_path", F.lit("directory").alias("kind"), F.element_at(F.split("module_path", "/"), -1).alias("module_name"), F.lit("Directory module").alias("summary"), F.lit("module").alias("role"), "dominant_intent", "file_count", "chunk_count", stamp)
        modules = settled(maintenance.upsert_modules(modules, _shaped(d, "module_intents"), "directory", repos), "modules")
    if mode in ("logical", "all"):
        m = synthesis.logical_modules(ix, min_files, resolution, most, percentile)
        first = F.element_at(F.split("member_symbols", ","), 1)
        slug = F.concat(F.lit("_logical/"), F.regexp_replace(F.lower(first), "[^a-z0-9]+", "-"), F.lit("-"), F.col("community"))
        m = m.select("repo", slug.alias("module_path"), F.lit("logical").alias("kind"), first.alias("module_name"), F.lit("Logical module").alias("summary"), F.lit("module").alias("role"), "file_count", "chunk_count", "member_symbols", stamp)
        modules = settled(maintenance.upsert_modules(modules, _shaped(m, "module_intents"), "logical", repos), "modules")
    ix.snapshots.commit({"module_intents": modules})
    return ix.raw("module_intents").count()
