"""Processing only new or changed records (problem 4).

The incoming scans are an append log: Parquet files in a folder to which only whole files are added. The log's own
positions are the offsets: each file is a log partition and a record's offset in it is its row number. Neither event nor
receipt time takes part, so a record that arrives late, whatever its times, lies in a new file and is read. A run

1. plans a batch: of every file that is new or has grown, the rows [from, to); at most ``most_files`` files a batch;
2. writes the plan ahead, before any record is read;
3. reads those rows only, folds them to one winner per key and drops those the state already surpasses;
4. writes the surviving winners as the batch's own part of the state and hands the changes to the sink;
5. commits, once the sink has returned.

A run that dies anywhere before 5, in the sink too, leaves a plan without commit: the next run replays exactly that plan,
overwriting its own output and nothing else, so no record is skipped. The sink sees a batch again under the same number
and keeps its output by that number; the sink that is built in does. Repeats collapse by key and offset: of a key only a
record with a greater (scanned_at, scan_id) than any before passes. Parts of the state are merged every ``compact_every``
batches; between that a run writes no more than its batch brought.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.workspace import shared_dir

WINNER = ["repo", "path_key", "scan_id", "run_id", "hash_key", "scanned_at", "received_at"]
BUCKETS = 32
Sink = Callable[[DataFrame, int], None]


def path_key(c: Column) -> Column:
    """Paths are the same if they differ only in a leading ``./`` or in backslashes for slashes."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./+)+", "")


def hash_key(c: Column) -> Column:
    """Hashes are the same if they differ only in case or outer white space; a blank one is none."""
    return F.lower(F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")))


def append(scans: DataFrame, folder: str) -> None:
    """Add records to a log as files of their own."""
    scans.write.mode("append").parquet(folder)


def as_log(scans: DataFrame) -> DataFrame:
    """The scans that can be the current state of a file, as log records.

    Scans without a hash, a key, a scan time or a number never can and are left out.
    """
    return scans.select(
        "repo", path_key(F.col("path")).alias("path_key"), "scan_id", "run_id", hash_key(F.col("hash")).alias("hash_key"), "scanned_at", "received_at"
    ).where("hash_key is not null and repo is not null and path_key is not null and scanned_at is not null and scan_id is not null")


def winners(log: DataFrame) -> DataFrame:
    """Per key the record with the greatest (scanned_at, scan_id).

    A plain max over a struct: partial aggregation leaves at most one row per key and task to shuffle, however hot a key.
    """
    rest = [c for c in WINNER if c not in ("repo", "path_key", "scanned_at", "scan_id")]
    best = F.max(F.struct("scanned_at", "scan_id", *rest)).alias("w")
    return log.groupBy("repo", "path_key").agg(best).select("repo", "path_key", *[F.col(f"w.{c}").alias(c) for c in WINNER[2:]])


def stored_state(files: DataFrame) -> DataFrame:
    """What the index holds per (repo, path): hash and time of the version indexed last."""
    per_key = files.where("repo is not null and path is not null").select(
        "repo", path_key(F.col("path")).alias("path_key"), "indexed_at", hash_key(F.col("hash")).alias("stored_hash")
    )
    best = F.max(F.struct("indexed_at", "stored_hash")).alias("s")
    return per_key.groupBy("repo", "path_key").agg(best, F.lit(True).alias("known")).select("repo", "path_key", "s.indexed_at", "s.stored_hash", "known")


def changed(latest: DataFrame, files: DataFrame) -> DataFrame:
    """Of the winners, those new to the index or different from what it holds and scanned after it was indexed.

    A stored file without ``indexed_at`` or hash was never indexed successfully, so any scan of it is a change.
    """
    joined = latest.join(stored_state(files), ["repo", "path_key"], "left")
    newer = F.coalesce(F.col("scanned_at") > F.col("indexed_at"), F.lit(True))
    differs = F.coalesce(F.col("stored_hash") != F.col("hash_key"), F.lit(True))
    return joined.where(F.col("known").isNull() | (differs & newer)).select(
        *WINNER, F.when(F.col("known").isNull(), "new").otherwise("changed").alias("change")
    )


class _Store:
    """Small files of the run's state in the shared folder, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark.sparkContext._jvm, root
        self._fs = self._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def write(self, name: str, value: dict) -> None:
        """Written beside and renamed, so that a reader sees all of it or nothing."""
        beside = self._path(name + ".part")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(self._path(name)):
            self._fs.delete(self._path(name), False)
        if not self._fs.rename(beside, self._path(name)):
            raise OSError(f"cannot commit {name}")

    def read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def numbers(self, folder: str, ending: str = ".json") -> list[int]:
        """The numbers of what a folder holds."""
        at = self._path(folder)
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(ending) and s.getPath().getName().split(".")[0].isdigit())


class ChangeCapture:
    """Incremental runs over a scan log with state in ``state``; see the module for the protocol.

    ``log`` is a DataFrame read straight from the log's Parquet files, whose positions Spark knows. The driver sees file
    names and row numbers of one batch (at most ``most_files``), never records.
    """

    def __init__(self, spark: SparkSession, state: str, most_files: int = 10_000, compact_every: int = 16):
        self.spark, self.state, self.most_files, self.compact_every = spark, state.rstrip("/"), most_files, compact_every
        self.store = _Store(spark, self.state)

    def _last(self) -> int:
        return max(self.store.numbers("commits"), default=-1)

    def _ends(self, log: DataFrame) -> DataFrame:
        """(file, n): the files of the log with their numbers of rows; no column of the data is read."""
        try:
            return log.groupBy(F.col("_metadata.file_path").alias("file")).agg((F.max("_metadata.row_index") + 1).alias("n"))
        except AnalysisException as e:
            raise ValueError("the log must be read straight from its Parquet files; append() adds records to one") from e

    def _done(self) -> DataFrame:
        """(file, done): up to which row each file was committed."""
        if self._last() < 0:
            return self.spark.createDataFrame([], "file string, done long")
        read = self.spark.read.schema("files array<struct<file: string, start: long, stop: long>>").json(f"{self.state}/commits/*.json")
        return read.select(F.explode("files").alias("f")).groupBy("f.file").agg(F.max("f.stop").alias("done"))

    def plan(self, log: DataFrame) -> dict | None:
        """Write ahead the next batch, or return the one a failed run left; None if nothing is new."""
        batch = self._last() + 1
        left = self.store.read(f"plans/{batch}.json")
        if left is not None:
            return left
        fresh = self._ends(log).join(self._done(), "file", "left").withColumn("start", F.coalesce("done", F.lit(0))).where("n > start")
        files = [{"file": r["file"], "start": r["start"], "stop": r["n"]} for r in fresh.select("file", "start", "n").orderBy("file").limit(self.most_files).collect()]
        if not files:
            return None
        plan = {"batch": batch, "files": files}
        self.store.write(f"plans/{batch}.json", plan)
        return plan

    def _slice(self, log: DataFrame, plan: dict) -> DataFrame:
        """The planned rows: only the files of the plan are opened."""
        bounds = self.spark.createDataFrame([(f["file"], f["start"], f["stop"]) for f in plan["files"]], "_file string, _start long, _stop long")
        rows = log.where(F.col("_metadata.file_path").isin([f["file"] for f in plan["files"]])).withColumns({"_at": F.col("_metadata.row_index"), "_path": F.col("_metadata.file_path")})
        # one row per planned file, so its size is bounded by most_files
        return rows.join(F.broadcast(bounds), (F.col("_path") == F.col("_file")) & (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_stop")))

    def _state(self, before: int) -> DataFrame | None:
        """The winners of all batches before the given one, several of a key where it changed since the last merge."""
        base = max([n for n in self.store.numbers("bases") if n < before], default=-1)
        parts = [f"{self.state}/winners/kind=base/batch={base}"] * (base >= 0) + [f"{self.state}/winners/kind=delta/batch={n}" for n in range(base + 1, before)]
        return self.spark.read.schema(self._schema).option("basePath", f"{self.state}/winners").parquet(*parts) if parts else None

    _schema = "repo string, path_key string, scan_id long, run_id long, hash_key string, scanned_at timestamp, received_at timestamp, bucket int"

    def process(self, log: DataFrame, files: DataFrame, plan: dict) -> DataFrame:
        """Fold the planned rows and write the batch's part of the state and its changes; rerunning overwrites the same output."""
        batch = plan["batch"]
        news = winners(as_log(self._slice(log, plan))).withColumn("bucket", F.pmod(F.xxhash64("repo", "path_key"), F.lit(BUCKETS)).cast("int"))
        state = self._state(batch)
        if state is not None:
            held = state.groupBy("bucket", "repo", "path_key").agg(F.max(F.struct("scanned_at", "scan_id")).alias("held"))
            news = news.join(held, ["bucket", "repo", "path_key"], "left").where("held is null or struct(scanned_at, scan_id) > held").drop("held")
        # a bucket's rows go to one file
        news.select(*WINNER, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.state}/winners/kind=delta/batch={batch}")
        own = self.spark.read.schema(self._schema).parquet(f"{self.state}/winners/kind=delta/batch={batch}").drop("bucket")
        return changed(own, files)

    def run(self, log: DataFrame, files: DataFrame, sink: Sink | None = None) -> DataFrame:
        """Process everything that was added to the log since the last commit; the changes it brought, as the built-in sink keeps them.

        ``sink(changes, batch)`` takes each batch before it is committed; if it fails, the next run brings the batch
        again. With a sink of one's own the result is empty. Files are planned until none is left.
        """
        first = self._last() + 1
        while (plan := self.plan(log)) is not None:
            batch = plan["batch"]
            found = self.process(log, files, plan)
            if sink is None:
                found.write.mode("overwrite").parquet(f"{self.state}/changes/{batch}")
            else:
                sink(found, batch)
            self.store.write(f"commits/{batch}.json", plan)
            if (batch + 1) % self.compact_every == 0:
                self.compact()
        return self.changes(first) if sink is None else changed(winners(as_log(log.limit(0))), files)

    def changes(self, since: int = 0) -> DataFrame:
        """The changes that the built-in sink holds of the committed batches from ``since`` on, for a consumer that failed."""
        schema = self._schema.replace("bucket int", "change string")
        kept = set(self.store.numbers("changes", ""))
        parts = [f"{self.state}/changes/{n}" for n in self.store.numbers("commits") if n >= since and n in kept]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Merge the parts of the state into one and drop them; what the commits say stays."""
        last = self._last()
        state = self._state(last + 1)
        if state is None or last in self.store.numbers("bases"):
            return
        old = self.store.numbers("bases")
        merged = winners(state).withColumn("bucket", F.pmod(F.xxhash64("repo", "path_key"), F.lit(BUCKETS)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.state}/winners/kind=base/batch={last}")
        self.store.write(f"bases/{last}.json", {})
        for n in old:
            self.store.drop(f"bases/{n}.json")
            self.store.drop(f"winners/kind=base/batch={n}")
        for n in range(max(old, default=-1) + 1, last + 1):
            self.store.drop(f"winners/kind=delta/batch={n}")

    def outstanding(self, files: DataFrame) -> DataFrame:
        """All files still to be indexed, whichever run brought them."""
        state = self._state(self._last() + 1)
        if state is None:
            raise ValueError("no run has been committed")
        return changed(winners(state), files)


def changed_records(scans: DataFrame, files: DataFrame, state: str | None = None) -> DataFrame:
    """One run of ``ChangeCapture``; without ``state`` a first run with fresh state in the shared folder."""
    spark = scans.sparkSession
    return ChangeCapture(spark, state or f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}").run(scans, files)


def duplicates_of_key(latest: DataFrame) -> DataFrame:
    """Keys that came out of a run more than once: always empty, a check for tests and monitoring."""
    n = F.count("*").over(Window.partitionBy("repo", "path_key"))
    return latest.withColumn("n", n).where("n > 1").drop("n")
