"""Dependency traces, breadth first over the edge table, one join a level; cycles are found by ``cycles``.

Levels are written to the shared folder, so a lost executor costs one level and lineage does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.columns import DEPENDENCY_ORDER, contains, under
from codelode.operators import cycles
from codelode.operators.edges import resolved_references, unified_edges
from codelode.sources.tables import Index
from codelode.workspace import settled

_ROW = ["repo", "source_path", "target_path_out", "dep_kind", "source_symbol", "target_symbol", "external_module", "depth"]


def _kind_order(kind="dep_kind"):
    out = F.lit(5)
    for k, n in DEPENDENCY_ORDER.items():
        out = F.when(F.col(kind) == k, n).otherwise(out)
    return out


def trace_dependencies(ix: Index, path: str, direction: str = "both", max_depth: int = 3, limit: int | None = 200, repo: str | None = None) -> DataFrame:
    """Edges reachable from the files whose path contains ``path``, by depth.

    The first level goes out of, into or both ways from the seeds; an inbound edge also counts if the name of its target is
    declared in a seed. All further levels follow targets outward. Equal rows of a level are kept once.
    """
    edges = unified_edges(ix).drop("edges")
    edges = edges.where(F.col("repo") == repo) if repo else edges
    files = ix.files("id", "repo", "path")
    seeds = files.where(contains(F.col("path"), path)).select("repo", "id")
    edges = settled(edges.join(files.select("repo", F.col("id").alias("source_id"), F.col("path").alias("source_path")), ["repo", "source_id"])
                    .join(files.select(F.col("id").alias("target_id"), F.col("path").alias("target_path")), "target_id", "left"), "edges")
    parts = []
    if direction in ("outbound", "both"):
        parts.append(edges.join(seeds.withColumnRenamed("id", "source_id"), ["repo", "source_id"], "left_semi"))
    if direction in ("inbound", "both"):
        parts.append(edges.join(seeds.withColumnRenamed("id", "target_id"), ["repo", "target_id"], "left_semi"))
        names = ix.symbols("id", "file_id", "name").join(seeds.withColumnRenamed("id", "file_id"), "file_id").select("repo", F.col("name").alias("target_symbol")).distinct()
        parts.append(edges.where("target_id is not null").join(names, ["repo", "target_symbol"], "left_semi"))
    frontier = parts[0]
    for p in parts[1:]:
        frontier = frontier.unionByName(p)
    frontier = settled(frontier.distinct().withColumn("depth", F.lit(1)), "trace")
    levels = [frontier]
    for depth in range(2, max_depth + 1):
        reached = frontier.where("target_id is not null").select("repo", F.col("target_id").alias("source_id")).distinct()
        frontier = settled(edges.join(reached, ["repo", "source_id"], "left_semi").distinct().withColumn("depth", F.lit(depth)), "trace")
        levels.append(frontier)
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    rows = rows.select("repo", "source_path", F.coalesce("target_path", "external_module").alias("target_path_out"), F.col("kind").alias("dep_kind"), "source_symbol", "target_symbol", "external_module", "depth").distinct()
    if limit is None:
        return rows
    order = Window.partitionBy("repo").orderBy("depth", _kind_order(), *[F.col(c).asc_nulls_first() for c in _ROW[1:]])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(*_ROW)


def trace_summary(trace: DataFrame, path: str) -> DataFrame:
    """Traced rows by direction, file at the other end and kind: edges and least depth."""
    out = F.col("source_path").contains(path)
    target = F.coalesce("target_path_out", "external_module", F.lit("unknown"))
    return trace.groupBy("repo", F.when(out, "outbound").otherwise("inbound").alias("direction"), F.when(out, target).otherwise(F.col("source_path")).alias("file"), F.col("dep_kind").alias("kind")).agg(
        F.count("*").alias("edges"), F.min("depth").alias("min_depth")
    )


def trace_stored(ix: Index, path: str, direction: str = "both", max_depth: int = 3) -> DataFrame:
    """The unscoped trace over stored dependencies only; further levels continue from the path found last."""
    files = ix.files("id", "path")
    symbols = ix.symbols("id", "name")
    edges = (
        ix.dependencies("id", "source_file_id", "target_file_id", "source_symbol_id", "target_symbol_id", "kind", "external_module")
        .join(files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path")), "source_file_id")
        .join(files.select(F.col("id").alias("target_file_id"), F.col("path").alias("target_path")), "target_file_id", "left")
        .join(symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source_symbol")), "source_symbol_id", "left")
        .join(symbols.select(F.col("id").alias("target_symbol_id"), F.col("name").alias("target_symbol")), "target_symbol_id", "left")
        .select("source_path", F.coalesce("target_path", "external_module").alias("target_path_out"), "target_path", F.col("kind").alias("dep_kind"), "source_symbol", "target_symbol", "external_module")
        .distinct()
    )
    edges = settled(edges, "edges")
    out, into = contains(F.col("source_path"), path), F.coalesce(contains(F.col("target_path"), path), F.lit(False))
    base = {"outbound": out, "inbound": into, "both": out | into}[direction]
    frontier = settled(edges.where(base).withColumn("depth", F.lit(1)), "trace")
    levels, step = [frontier], "source_path" if direction == "inbound" else "target_path_out"
    for depth in range(2, max_depth + 1):
        reached = frontier.where(F.col(step).isNotNull()).select(F.col(step).alias("source_path")).distinct()
        frontier = settled(edges.join(reached, "source_path", "left_semi").withColumn("depth", F.lit(depth)), "trace")
        levels.append(frontier)
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    return rows.drop("target_path").distinct()


def cycle_edges(ix: Index, prefix: str = "") -> DataFrame:
    """(repo, source, target): distinct edges between different files of the part, by dependency or reference."""
    files = ix.files("id", "repo", "path").where(under(F.col("path"), prefix))
    src = files.select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("source"))
    tgt = files.select(F.col("id").alias("target_file_id"), "repo", F.col("path").alias("target"))
    deps = ix.dependencies("id", "source_file_id", "target_file_id").join(src, "source_file_id").join(tgt, ["target_file_id", "repo"]).select("repo", "source", "target")
    refs = resolved_references(ix).where(under(F.col("source"), prefix) & under(F.col("target"), prefix)).select("repo", "source", "target")
    return deps.unionByName(refs).where("source <> target").distinct()


def find_cycles(edges: DataFrame, max_length: int = 6, paths: bool = True) -> DataFrame:
    """(repo, length, cycle, path): simple cycles of at most ``max_length`` (10) files, one for each set of files.

    Paths start at their least file; of the cycles of one set the least path is kept. Without ``paths`` the last column is left out.
    """
    return cycles.listed(edges, min(max_length, 10), paths)


def rank_cycle_files(edges: DataFrame, max_length: int = 6) -> DataFrame:
    """(repo, node, cycles): in how many of the cycles of ``find_cycles`` each file is."""
    return cycles.counted(edges, min(max_length, 10))
