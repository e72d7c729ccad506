"""Watching repositories: a stream of file changes applied to the index in micro-batches.

The feed is a folder of JSON records (repo, op, path, to_path, content, seq, at). Each micro-batch keeps the last event of a
path, turns moves into delete and upsert, and commits a new snapshot under the batch's number: a batch that is replayed
after a failure finds its number committed and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators.changefeed import _Store
from codelode.operators.maintenance import fold_statuses, latest_events, numbered, split_moves
from codelode.sources.repository import Settings, excluded, language_of, line_count

FEED = "repo string, op string, path string, to_path string, content string, seq long, at timestamp"
STATE = "id long, repo string, path string, language string, size_bytes long, line_count int, hash string, indexed_at timestamp"


class Watcher:
    """Applies change feeds to a versioned table of files under ``root``."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.store = _Store(spark, self.root)

    def last(self) -> int:
        done = self.store.numbers("commits")
        return done[-1] if done else -1

    def files(self) -> DataFrame:
        n = self.last()
        return self.spark.read.schema(STATE).parquet(f"{self.root}/files/{n}") if n >= 0 else self.spark.createDataFrame([], STATE)

    def statuses(self) -> DataFrame:
        """(batch, status, path) of everything applied so far."""
        return self.spark.read.schema("batch long, repo string, path string, status string").parquet(f"{self.root}/statuses/*")

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; idempotent by its number."""
        if number <= self.last():
            return
        before = self.files()
        events = split_moves(batch.select("repo", "op", "path", "to_path", "content", "seq", "at"))
        language = language_of(F.col("path"), self.settings.extensions)
        # a folder's deletion is a prefix, a file's a key
        events = latest_events(events, ["repo", "path"], ["seq"]).withColumn("language", language).withColumn("left_out", excluded(F.col("path"), self.settings.exclude))
        gone = events.where("op = 'deleted'").select("repo", F.col("path").alias("gone"), F.col("seq").alias("gone_seq"))
        upserts = events.where("op <> 'deleted' and language is not null and not left_out and content is not null")
        fresh = upserts.select(
            "repo", "path", "language", F.octet_length("content").cast("long").alias("size_bytes"), line_count(F.col("content")).cast("int").alias("line_count"), F.sha2("content", 256).alias("hash"),
            F.coalesce("at", F.current_timestamp()).alias("indexed_at"), "seq",
        )
        under = lambda df: df.join(gone, (df["repo"] == gone["repo"]) & ((df["path"] == gone["gone"]) | df["path"].startswith(F.concat(gone["gone"], F.lit("/")))), "left_anti")
        later = lambda df: df.join(gone, (df["repo"] == gone["repo"]) & ((df["path"] == gone["gone"]) | df["path"].startswith(F.concat(gone["gone"], F.lit("/")))) & (df["seq"] < gone["gone_seq"]), "left_anti")
        kept, fresh = under(before), later(fresh)
        old = before.select("repo", "path", F.col("id").alias("old_id"), F.col("hash").alias("old_hash"))
        fresh = fresh.join(old, ["repo", "path"], "left")
        unchanged = fresh.where("old_hash = hash")
        changed = fresh.where("old_hash is null or old_hash <> hash").drop("old_hash", "seq")
        top = before.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        new = numbered(changed.where("old_id is null"), ["repo", "path"]).crossJoin(F.broadcast(top)).withColumn("id", F.col("n") + F.col("top"))
        columns = [c.split()[0] for c in STATE.split(", ")]
        upserted = changed.where("old_id is not null").withColumn("id", F.col("old_id")).select(*columns).unionByName(new.select(*columns))
        after = kept.join(upserted.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(upserted)
        again = unchanged.join(kept.select("repo", "path"), ["repo", "path"], "left_anti")
        after = after.unionByName(before.join(again.select("repo", "path"), ["repo", "path"], "left_semi"))
        after.write.mode("overwrite").parquet(f"{self.root}/files/{number}")
        tell = lambda df, status: df.select(F.lit(number).cast("long").alias("batch"), "repo", "path", F.lit(status).alias("status"))
        removed = before.join(kept.select("repo", "path"), ["repo", "path"], "left_anti")
        removed = removed.join(fresh.select("repo", "path"), ["repo", "path"], "left_anti")
        tell(changed, "indexed").unionByName(tell(unchanged, "skipped")).unionByName(tell(removed, "deleted")).write.mode("overwrite").parquet(f"{self.root}/statuses/{number}")
        self.store.write(f"commits/{number}.json", {"batch": number})

    def start(self, feed: str, once: bool = False) -> StreamingQuery:
        """Watch a folder of JSON records; with ``once`` stop when all that is there has been applied."""
        stream = self.spark.readStream.schema(FEED).json(feed)
        writer = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", f"{self.root}/checkpoint").queryName(f"watch-{abs(hash(feed))}")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()

    def counters(self) -> DataFrame:
        return fold_statuses(self.statuses(), ["repo"])


def tool_call_counts(stream: DataFrame, name: str = "event_type") -> DataFrame:
    """Running counts of tool calls, for ``complete`` output."""
    return stream.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("calls"))
