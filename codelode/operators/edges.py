"""Edges between files: dependencies, and references resolved by name.

Name resolution is the join that can explode: a name may be referred to by a large share of all rows and be declared many
times. References are therefore counted per (repository, name, file, kind) and declarations per (repository, name, file)
first; the join then meets each combination once, and the numbers of raw pairs are products of the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.search import resolve_symbols
from codelode.sources.tables import Index


def reference_counts(ix: Index, *more: str) -> DataFrame:
    """(repo, name_lc, source_id, source, reference_kind, *more, refs)."""
    files = ix.files("id", "repo", "path").select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("source"))
    refs = ix.references("id", "source_file_id", "target_name", "reference_kind", *more).withColumn("name_lc", F.lower("target_name")).where("name_lc is not null")
    counted = refs.groupBy("source_file_id", "name_lc", "reference_kind", *more).agg(F.count("*").alias("refs"))
    return counted.join(files, "source_file_id").withColumnRenamed("source_file_id", "source_id")


def declaration_counts(ix: Index, *more: str) -> DataFrame:
    """(repo, name_lc, target_id, target, *more, decls)."""
    files = ix.files("id", "repo", "path").select(F.col("id").alias("file_id"), "repo", F.col("path").alias("target"))
    symbols = ix.symbols("id", "file_id", "name", *more).withColumn("name_lc", F.lower("name")).where("name_lc is not null")
    counted = symbols.groupBy("file_id", "name_lc", *more).agg(F.count("*").alias("decls"))
    return counted.join(files, "file_id").withColumnRenamed("file_id", "target_id")


def resolved_references(ix: Index) -> DataFrame:
    """(repo, source_id, source, target_id, target, kind, edges): references with every declaration of their name in the repository."""
    both = reference_counts(ix).join(declaration_counts(ix), ["repo", "name_lc"])
    return both.groupBy("repo", "source_id", "source", "target_id", "target", F.col("reference_kind").alias("kind")).agg(F.sum(F.col("refs") * F.col("decls")).alias("edges"))


def repository_graph(ix: Index, limit: int = 300) -> DataFrame:
    """(repo, source, target, kind, weight, place): the heaviest edges of each repository; self edges stay."""
    files = ix.files("id", "repo", "path")
    src = files.select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("source"))
    tgt = files.select(F.col("id").alias("target_file_id"), F.col("repo").alias("target_repo"), F.col("path").alias("target_path"))
    deps = ix.dependencies("id", "source_file_id", "target_file_id", "kind", "external_module").join(src, "source_file_id").join(tgt, "target_file_id", "left")
    deps = deps.where(F.col("target_repo").isNull() | (F.col("target_repo") == F.col("repo")))
    target = F.coalesce("target_path", "external_module")
    direct = deps.where(target.isNotNull()).groupBy("repo", "source", target.alias("target"), "kind").agg(F.count("*").alias("weight"))
    named = resolved_references(ix).groupBy("repo", "source", "target", "kind").agg(F.sum("edges").alias("weight"))
    edges = direct.unionByName(named).groupBy("repo", "source", "target", "kind").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("repo").orderBy(F.desc("weight"), "source", "target", "kind")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(50, min(limit, 2000)))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(repo, node, degree): weights summed at both ends; a self edge counts twice."""
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("node"), "weight")
    return ends.groupBy("repo", "node").agg(F.sum("weight").alias("degree"))


def induced_subgraph(edges: DataFrame, nodes: int = 80, most: int = 180) -> DataFrame:
    """The edges among the ``nodes`` nodes of highest degree of each repository, at most ``most``."""
    order = Window.partitionBy("repo").orderBy(F.desc("degree"), "node")
    top = graph_nodes(edges).withColumn("n", F.row_number().over(order)).where(F.col("n") <= nodes).select("repo", "node")
    kept = edges.join(top.withColumnRenamed("node", "source"), ["repo", "source"], "left_semi").join(top.withColumnRenamed("node", "target"), ["repo", "target"], "left_semi")
    again = Window.partitionBy("repo").orderBy("place")
    return kept.withColumn("row", F.row_number().over(again)).where(F.col("row") <= most).select("repo", "source", "target", "kind", "weight")


def unified_edges(ix: Index) -> DataFrame:
    """All directed edges with their symbols: dependencies, their targets resolved directly, by symbol or late by name,
    and references with each declaration of their name.

    (repo, source_id, target_id, kind, source_symbol, target_symbol, external_module, edges); ``edges`` counts equal rows.
    """
    files = ix.files("id", "repo")
    src = files.select(F.col("id").alias("source_id"), "repo")
    symbols = ix.symbols("id", "file_id", "name")
    deps = ix.dependencies("id", "source_file_id", "target_file_id", "source_symbol_id", "target_symbol_id", "kind", "external_module")
    deps = deps.withColumnRenamed("source_file_id", "source_id").join(src, "source_id")
    direct = files.select(F.col("id").alias("target_file_id"), F.col("repo").alias("repo"), F.lit(True).alias("is_direct"))
    by_symbol = symbols.join(files.withColumnRenamed("id", "file_id").withColumnRenamed("repo", "symbol_repo"), "file_id", "left").select(
        F.col("id").alias("target_symbol_id"), F.col("name").alias("symbol_name"), F.col("file_id").alias("symbol_file"), "symbol_repo"
    )
    late = resolve_symbols(ix, by_repo=True).select("repo", "name_lc", F.col("file_id").alias("late_file"), F.col("name").alias("late_name"))
    wanted = F.when(F.col("target_symbol_id").isNull(), F.lower("external_module"))
    joined = (
        deps.join(direct, ["target_file_id", "repo"], "left")
        .join(symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source_symbol")), "source_symbol_id", "left")
        .join(by_symbol, "target_symbol_id", "left")
        .withColumn("name_lc", wanted).join(late, ["repo", "name_lc"], "left")
    )
    target = F.coalesce(F.when(F.col("is_direct"), F.col("target_file_id")), F.when(F.col("symbol_repo") == F.col("repo"), F.col("symbol_file")), F.col("late_file"))
    dependency = joined.select("repo", "source_id", target.alias("target_id"), "kind", "source_symbol", F.coalesce("symbol_name", "late_name").alias("target_symbol"), "external_module")
    keys = ["repo", "source_id", "target_id", "kind", "source_symbol", "target_symbol", "external_module"]
    dependency = dependency.groupBy(*keys).agg(F.count("*").alias("edges"))
    refs, decls = reference_counts(ix, "source_symbol_name"), declaration_counts(ix, "name")
    named = refs.join(decls, ["repo", "name_lc"]).select(
        "repo", "source_id", "target_id", F.col("reference_kind").alias("kind"), F.col("source_symbol_name").alias("source_symbol"), F.col("name").alias("target_symbol"),
        F.lit(None).cast("string").alias("external_module"), (F.col("refs") * F.col("decls")).alias("edges"),
    )
    return dependency.unionByName(named.groupBy(*keys).agg(F.sum("edges").alias("edges")))

