"""The stored tables of the code index and their deduplicated views.

Rows are delivered at least once and files keep older versions, so every operator reads through
these views: one row per id, for files the version indexed last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "files code_chunks symbols symbol_references dependencies ingestion_runs source_texts file_scans documents eval_items "
    "region nation customer supplier part orders lineitem events embeddings"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A raw table; Catalyst prunes columns and pushes filters into the Parquet scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{root}/{name}.parquet")


def distinct_ids(df: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """One row per ``key`` of the given columns (all if none); repeats are whole rows, so any will do."""
    df = df.select(key, *[c for c in columns if c != key]) if columns else df
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def stored_files(df: DataFrame, *columns: str) -> DataFrame:
    """The stored version of each file: of the rows with one id, the one with the latest ``indexed_at``.

    Ties go to the greatest hash. Rows without id are left out.
    """
    keep = list(dict.fromkeys(["id", *columns])) if columns else df.columns
    order = Window.partitionBy("id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("hash").desc_nulls_last())
    need = list(dict.fromkeys([*keep, "indexed_at", "hash"]))
    ranked = df.select(*need).where(F.col("id").isNotNull()).withColumn("_version", F.row_number().over(order))
    return ranked.where("_version = 1").select(*keep)


class Index:
    """Lazy deduplicated views over the index at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def files(self, *columns: str) -> DataFrame:
        return stored_files(self.raw("files"), *columns)

    def chunks(self, *columns: str) -> DataFrame:
        return distinct_ids(self.raw("code_chunks"), *columns)

    def symbols(self, *columns: str) -> DataFrame:
        return distinct_ids(self.raw("symbols"), *columns)

    def references(self, *columns: str) -> DataFrame:
        return distinct_ids(self.raw("symbol_references"), *columns)

    def dependencies(self, *columns: str) -> DataFrame:
        return distinct_ids(self.raw("dependencies"), *columns)

    def runs(self, *columns: str) -> DataFrame:
        return distinct_ids(self.raw("ingestion_runs"), *columns)
