"""Changing the stored index: every operation computes the next state of a table from the present one.

Tables are immutable Parquet snapshots: a change writes a new version beside the old one and then moves the pointer
(``Snapshots``), so readers never see half a change and a lost job leaves the old version in force.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.operators.changefeed import _Store, hash_key, path_key
from codelode.workspace import settled

KEY = ["repo", "path"]


def latest_scans(scans: DataFrame) -> DataFrame:
    """Per (repo, path) the last scan with a hash: the present state of the repositories."""
    rows = scans.select("repo", path_key(F.col("path")).alias("path"), hash_key(F.col("hash")).alias("hash"), "scanned_at", "scan_id")
    rows = rows.where("hash is not null and repo is not null and path is not null and scanned_at is not null")
    return rows.groupBy("repo", "path").agg(F.max(F.struct("scanned_at", "scan_id", "hash")).alias("s")).select("repo", "path", "s.hash", "s.scanned_at", "s.scan_id")


def skip_unchanged(stored: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """``incoming`` (repo, path, hash) with ``status``: ``skipped`` where the stored hash is the same, else ``indexed``."""
    old = stored.select("repo", path_key(F.col("path")).alias("path"), hash_key(F.col("hash")).alias("old_hash")).dropDuplicates(KEY)
    same = F.coalesce(F.col("old_hash") == F.col("hash"), F.lit(False)) & F.lit(not force)
    return incoming.join(old, KEY, "left").withColumn("status", F.when(same, "skipped").otherwise("indexed")).drop("old_hash")


def upsert_files(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, repo, path, hash, operation) after an upsert by key: changed rows keep their id, new ones get the next ids.

    Ids follow the order of keys; no single task numbers all rows.
    """
    old = stored.select("id", "repo", path_key(F.col("path")).alias("path"), hash_key(F.col("hash")).alias("old_hash"))
    both = old.join(incoming.select("repo", "path", "hash"), KEY, "full_outer")
    operation = F.when(F.col("id").isNull(), "insert").when(F.col("hash").isNull() | (F.col("hash") == F.col("old_hash")), "keep").otherwise("update")
    rows = both.select("id", "repo", "path", F.coalesce("hash", "old_hash").alias("hash"), operation.alias("operation"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(rows.where("id is null").drop("id"), ["repo", "path"]).crossJoin(F.broadcast(top))  # one row
    new = new.select((F.col("n") + F.col("top")).alias("id"), "repo", "path", "hash", "operation")
    return rows.where("id is not null").unionByName(new)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``n`` from 1 in the order given: positions inside ranges of about equal size plus the sizes of the ranges before.

    The ranges are cut by sampling, so a hot repository is numbered by many tasks; they are written once, so that sizes and rows agree.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_size")).withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("n", inside).join(offsets, "_range").withColumn("n", F.col("n") + F.col("_offset")).drop("_range", "_offset")


def prune(stored: DataFrame, present: DataFrame) -> DataFrame:
    """The stored files whose path is no longer there, in repositories that were walked."""
    old = stored.select("id", "repo", path_key(F.col("path")).alias("path"))
    walked = present.select("repo").distinct()
    return old.join(walked, "repo", "left_semi").join(present.select(*KEY).distinct(), KEY, "left_anti")


def delete_prefix(stored: DataFrame, folder: str, repo: str | None = None) -> DataFrame:
    """The files that stay when a folder is deleted (and the file of that very path, as after a move)."""
    gone = F.col("path").startswith(folder.rstrip("/") + "/") | (F.col("path") == folder.rstrip("/"))
    return stored.where(~(gone & (F.col("repo") == repo if repo else F.lit(True))))


def delete_repository(stored: DataFrame, repo: str, confirm: bool = False) -> tuple[DataFrame, int]:
    """What stays without a repository, and how many files go; nothing happens without ``confirm``."""
    if not confirm:
        raise ValueError("deleting a repository needs confirm=True")
    return stored.where(F.col("repo") != repo), stored.where(F.col("repo") == repo).count()


def cascade(tables: dict[str, DataFrame], kept: DataFrame, renewed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The child tables without the rows of files that are gone or whose children are replaced (``renewed``, file_id).

    Chunks and symbols go with their file, references with their source file or chunk, dependencies with their source
    file, a resolved target file or either symbol; symbols of a gone chunk lose the link, not the row. Nulls link nothing.
    """
    ids = kept.select(F.col("id").alias("_id")).distinct()
    mine = ids if renewed is None else ids.join(renewed.select(F.col("file_id").alias("_id")).distinct(), "_id", "left_anti")

    def linked(df: DataFrame, key: str, to: DataFrame, null: bool = True) -> DataFrame:
        there = df.where(F.col(key).isNotNull()).join(to, F.col(key) == F.col("_id"), "left_semi")
        return there.unionByName(df.where(F.col(key).isNull())) if null else there

    out = dict(tables)
    chunks = out["code_chunks"] = linked(tables["code_chunks"], "file_id", mine, False)
    symbols = linked(tables["symbols"], "file_id", mine, False)
    held = chunks.select(F.col("id").alias("_id")).distinct()
    named = symbols.select(F.col("id").alias("_id")).distinct()
    out["symbols"] = symbols.join(held, F.col("chunk_id") == F.col("_id"), "left").withColumn("chunk_id", F.col("_id")).drop("_id")
    out["symbol_references"] = linked(linked(tables["symbol_references"], "source_file_id", mine, False), "source_chunk_id", held)
    deps = linked(linked(tables["dependencies"], "source_file_id", mine, False), "target_file_id", ids)
    out["dependencies"] = linked(linked(deps, "source_symbol_id", named), "target_symbol_id", named)
    return out


def replace_children(children: DataFrame, fresh: DataFrame, key: str = "file_id") -> DataFrame:
    """The children of re-indexed files replaced by the fresh ones, all others kept."""
    return children.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert_modules(stored: DataFrame, fresh: DataFrame, kind: str, repos: DataFrame | None = None) -> DataFrame:
    """Module rows after a synthesis of one kind: rows of that kind go in all the repositories that were synthesised (``repos``,
    by default those in ``fresh``), also where no module of the kind is left; of fresh rows with one key (repo, module_path)
    the last by ``updated_at`` stays.
    """
    order = Window.partitionBy("repo", "module_path").orderBy(F.desc("updated_at"), F.desc("module_name"))
    last = fresh.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    old = stored.where(F.col("kind") == kind).join((fresh if repos is None else repos).select("repo").distinct(), "repo", "left_semi").select("repo", "module_path", "kind")
    kept = stored.join(old, ["repo", "module_path", "kind"], "left_anti").join(last.select("repo", "module_path"), ["repo", "module_path"], "left_anti")
    return kept.unionByName(last)


def close_runs(runs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Runs with their outcome: ``statuses`` (run_id, status) are folded to counters, files processed = indexed + skipped + errors."""
    folded = fold_statuses(statuses, ["run_id"])
    out = runs.select("id", "repo", "started_at").join(folded.withColumnRenamed("run_id", "id"), "id")
    return out.withColumn("files_processed", F.col("indexed") + F.col("skipped") + F.col("errors")).withColumn("status", F.lit("completed"))


STATUSES = ("indexed", "skipped", "deleted", "errors")


def fold_statuses(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Counters per key; statuses that are not known count as errors."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("errors")
    return statuses.groupBy(*keys).agg(*[F.sum((known == s).cast("long")).alias(s) for s in STATUSES])


def latest_events(feed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key in a change feed, however late it was delivered."""
    rest = [c for c in feed.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("e")
    return feed.groupBy(*keys).agg(best).select(*keys, *[F.col(f"e.{c}").alias(c) for c in [*order, *rest]])


def split_moves(feed: DataFrame) -> DataFrame:
    """A move becomes a delete of the old path and an upsert of the new one. ``feed`` has op, path, to_path and more."""
    moved = F.array(F.struct(F.lit("deleted").alias("op"), F.col("path").alias("path")), F.struct(F.lit("modified").alias("op"), F.col("to_path").alias("path")))
    same = F.array(F.struct(F.col("op").alias("op"), F.col("path").alias("path")))
    rest = [c for c in feed.columns if c not in ("op", "path", "to_path")]
    return feed.select(*rest, F.explode(F.when(F.col("op") == "moved", moved).otherwise(same)).alias("x")).select(*rest, "x.op", "x.path")


class Snapshots:
    """Versioned tables under one folder: ``<name>/<version>`` with a pointer file, replaced last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = _Store(spark, self.root)

    def versions(self) -> dict:
        return self.store.read("current.json") or {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{name}/{self.versions()[name]}")

    def commit(self, tables: dict[str, DataFrame], partition: dict[str, str] | None = None) -> dict:
        """Write a new version of each table, then move the pointer to all of them at once."""
        now = self.versions()
        new = {name: now.get(name, 0) + 1 for name in tables}
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            if partition and name in partition:
                writer = writer.partitionBy(partition[name])
            writer.parquet(f"{self.root}/{name}/{new[name]}")
        self.store.write("current.json", now | new)
        return new

    def with_columns(self, name: str, **defaults) -> DataFrame:
        """A table with columns added where it lacks them: an idempotent patch of the schema."""
        df = self.read(name)
        missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
        return df.withColumns(missing) if missing else df


def describe(tables: dict[str, DataFrame]) -> str:
    """Names and columns of tables as JSON, for logs."""
    return json.dumps(reduce(lambda acc, kv: acc | {kv[0]: kv[1].columns}, tables.items(), {}))
