"""Finding modules: coupling graphs, hub dampening and community detection.

Edges are aggregated in the cluster. Communities are found per repository by a deterministic Louvain in one task; a
repository whose graph has more than ``most_edges`` edges is first contracted by joins, each node merging with its
strongest neighbour, until it fits. So no task ever takes an unbounded graph and no edge is dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.columns import CLASS_KINDS, directory
from codelode.operators.edges import resolved_references
from codelode.sources.tables import Index
from codelode.workspace import settled


def _undirected(edges: DataFrame) -> DataFrame:
    """(repo, a, b, weight) with a < b, weights of both directions summed."""
    return edges.where("src <> tgt").groupBy("repo", F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.sum("weight").alias("weight"))


def class_nodes(ix: Index) -> DataFrame:
    """(repo, id, name, kind, path): class-like symbols without parent, in repositories that have at least five."""
    files = ix.files("id", "repo", "path").withColumnRenamed("id", "file_id")
    nodes = ix.symbols("id", "file_id", "name", "kind", "parent_id").where(F.col("kind").isin(*CLASS_KINDS) & F.col("parent_id").isNull()).join(files, "file_id")
    enough = nodes.groupBy("repo").agg(F.count("*").alias("n")).where("n >= 5").select("repo")
    return nodes.join(enough, "repo", "left_semi").select("repo", "id", "name", "kind", "path")


def class_graph(ix: Index) -> DataFrame:
    """(repo, a, b, weight): couplings of classes, by dependency between symbols and by distinct reference, members lifted to their parent."""
    nodes = class_nodes(ix)
    deps = ix.dependencies("id", "source_symbol_id", "target_symbol_id").where("source_symbol_id is not null and target_symbol_id is not null")
    deps = deps.groupBy(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("tgt")).agg(F.count("*").alias("weight"))
    symbols = ix.symbols("id", "file_id", "name", "parent_id")
    lifted = symbols.select(F.col("file_id").alias("source_file_id"), F.col("name").alias("source_symbol_name"), F.coalesce("parent_id", "id").alias("src"))
    refs = ix.references("id", "source_file_id", "source_symbol_name", "target_name").select("source_file_id", "source_symbol_name", F.lower("target_name").alias("name_lc")).distinct()
    # only classes can be ends, so both joins meet few rows however popular a name is
    wanted = nodes.select(F.lower("name").alias("name_lc"), F.col("id").alias("tgt"), F.col("repo").alias("tgt_repo"))
    named = refs.join(lifted, ["source_file_id", "source_symbol_name"]).join(nodes.select(F.col("id").alias("src"), F.col("repo").alias("src_repo")), "src")
    named = named.join(wanted, (named.name_lc == wanted.name_lc) & (named.src_repo == wanted.tgt_repo)).select("src", "tgt").distinct().withColumn("weight", F.lit(1).cast("long"))
    ends = nodes.select("repo", "id")
    edges = deps.unionByName(named).join(ends.withColumnRenamed("id", "src"), "src").join(ends.select(F.col("id").alias("tgt"), F.col("repo").alias("r2")), "tgt").where("repo = r2")
    return _undirected(edges.select("repo", "src", "tgt", "weight"))


def file_graph(ix: Index) -> DataFrame:
    """(repo, a, b, weight): couplings of files by reference and dependency; the way out for repositories without a class graph."""
    refs = resolved_references(ix).where("source_id <> target_id").select("repo", F.col("source").alias("src"), F.col("target").alias("tgt"), F.col("edges").alias("weight"))
    files = ix.files("id", "repo", "path")
    deps = (
        ix.dependencies("id", "source_file_id", "target_file_id").where("source_file_id <> target_file_id")
        .join(files.select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("src")), "source_file_id")
        .join(files.select(F.col("id").alias("target_file_id"), "repo", F.col("path").alias("tgt")), ["target_file_id", "repo"])
        .groupBy("repo", "src", "tgt").agg(F.count("*").alias("weight"))
    )
    return _undirected(refs.unionByName(deps))


def dampen_hubs(edges: DataFrame, percentile: float = 90.0) -> DataFrame:
    """Edges with the weights of hubs scaled by median degree / own degree, at each end that is a hub.

    Degrees are unweighted; a hub has more than the degree at the percentile, if that exceeds the median. Repositories of
    fewer than three nodes stay as they are.
    """
    degrees = edges.select("repo", F.explode(F.array("a", "b")).alias("node")).groupBy("repo", "node").agg(F.count("*").alias("degree"))
    # ranks over distinct degrees: a histogram row per degree, not a row per node
    histogram = degrees.groupBy("repo", "degree").agg(F.count("*").alias("c"))
    order = Window.partitionBy("repo").orderBy("degree")
    h = histogram.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("repo")))
    at = F.least(F.floor(F.col("n") * percentile / 100), F.col("n") - 1)
    limits = h.groupBy("repo").agg(
        F.min(F.when(F.col("upto") > at, F.col("degree"))).alias("threshold"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("degree"))).alias("median"), F.max("n").alias("n")
    )
    hub = (F.col("n") >= 3) & (F.col("threshold") > F.col("median")) & (F.col("degree") > F.col("threshold"))
    scales = degrees.join(limits, "repo").where(hub).select("repo", "node", (F.col("median") / F.col("degree")).alias("scale"))
    left, right = scales.select("repo", F.col("node").alias("a"), F.col("scale").alias("sa")), scales.select("repo", F.col("node").alias("b"), F.col("scale").alias("sb"))
    out = edges.join(left, ["repo", "a"], "left").join(right, ["repo", "b"], "left")
    return out.select("repo", "a", "b", (F.col("weight") * F.coalesce("sa", F.lit(1.0)) * F.coalesce("sb", F.lit(1.0))).alias("weight"))


def louvain(adjacency: dict, resolution: float = 1.0) -> list[set]:
    """Communities of a weighted graph {node: {node: weight}}: local moves in sorted order, then the same over the communities.

    Deterministic: nodes are visited in order and ties go to the least community.
    """
    graph = {u: dict(vs) for u, vs in adjacency.items()}
    inside = {u: 0.0 for u in graph}  # weight of edges within a contracted node, twice
    members = {u: {u} for u in graph}
    while True:
        degree = {u: sum(vs.values()) + inside[u] for u, vs in graph.items()}
        total = sum(degree.values())
        if not total:
            break
        home = {u: u for u in graph}
        sums = dict(degree)
        moved_at_all = moved = True
        rounds = 0
        moved_at_all = False
        while moved and rounds < 50:
            moved, rounds = False, rounds + 1
            for u in sorted(graph, key=repr):
                links: dict = {}
                for v, w in graph[u].items():
                    links[home[v]] = links.get(home[v], 0.0) + w
                old = home[u]
                sums[old] -= degree[u]
                gain = lambda c: links.get(c, 0.0) - resolution * degree[u] * sums[c] / total  # noqa: E731, B023
                best = max(sorted({*links, old}, key=repr), key=lambda c: (round(gain(c), 12), c == old))
                sums[best] += degree[u]
                if best != old:
                    home[u], moved, moved_at_all = best, True, True
        if not moved_at_all:
            break
        names = {}
        for u in sorted(graph, key=repr):
            names.setdefault(home[u], u)
        contracted: dict = {n: {} for n in names.values()}
        loops = {n: 0.0 for n in names.values()}
        joined = {n: set() for n in names.values()}
        for u, vs in graph.items():
            a = names[home[u]]
            loops[a] += inside[u]
            joined[a] |= members[u]
            for v, w in vs.items():
                b = names[home[v]]
                if a == b:
                    loops[a] += w
                else:
                    contracted[a][b] = contracted[a].get(b, 0.0) + w
        graph, inside, members = contracted, loops, joined
    return sorted(members.values(), key=lambda c: (-len(c), repr(sorted(c, key=repr)[0])))


def split_oversized(adjacency: dict, communities: list[set], most: int = 20, resolution: float = 1.5) -> list[set]:
    """Communities above ``most`` members split again at twice the resolution, as long as that splits them."""
    out = []
    for c in communities:
        if len(c) <= most:
            out.append(c)
            continue
        part = {u: {v: w for v, w in adjacency[u].items() if v in c} for u in c}
        again = louvain(part, 2 * resolution)
        out += [c] if len(again) <= 1 else split_oversized(part, again, most, 2 * resolution)
    return out


def modularity(adjacency: dict, communities: list[set], resolution: float = 1.0) -> float:
    degree = {u: sum(vs.values()) for u, vs in adjacency.items()}
    total = sum(degree.values())
    if not total:
        return 0.0
    inside = sum(w for c in communities for u in c for v, w in adjacency[u].items() if v in c)
    return inside / total - resolution * sum((sum(degree[u] for u in c) / total) ** 2 for c in communities)


def contract(edges: DataFrame, most_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges contracted until no repository has more than ``most_edges``, and (repo, node, into) of merged nodes, None if nothing was."""
    spread = None
    for _ in range(30):
        big = edges.groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("repo")
        if big.isEmpty():
            break
        both = edges.join(big, "repo", "left_semi").select("repo", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "weight").select("repo", "e.u", "e.v", "weight")
        choice = both.groupBy("repo", "u").agg(F.max_by("v", F.struct("weight", "v")).alias("v"))
        mutual = choice.join(choice.select("repo", F.col("v").alias("u"), F.col("u").alias("v")), ["repo", "u", "v"])
        step = settled(mutual.where("u > v").select("repo", F.col("u").alias("node"), F.col("v").alias("into")), "contract")
        if step.isEmpty():
            break
        name = lambda side: step.select("repo", F.col("node").alias(side), F.col("into").alias(f"{side}2"))  # noqa: E731, B023
        edges = edges.join(name("a"), ["repo", "a"], "left").join(name("b"), ["repo", "b"], "left")
        edges = settled(_undirected(edges.select("repo", F.coalesce("a2", "a").alias("src"), F.coalesce("b2", "b").alias("tgt"), "weight")), "contract")
        if spread is None:
            spread = step
        else:
            moved = spread.join(step.select("repo", F.col("node").alias("into"), F.col("into").alias("into2")), ["repo", "into"], "left").select("repo", "node", F.coalesce("into2", "into").alias("into"))
            spread = settled(moved.unionByName(step), "contract")
    return edges, spread


def communities(edges: DataFrame, resolution: float = 1.5, most: int = 20, split: bool = True, most_edges: int = 2_000_000) -> DataFrame:
    """(repo, node, community): community numbers from 0 by falling size within each repository."""
    kind = dict(edges.dtypes)["a"]
    small, spread = contract(edges, most_edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph: dict = {}
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"]):
            graph.setdefault(a, {})[b] = float(w)
            graph.setdefault(b, {})[a] = float(w)
        found = louvain(graph, resolution)
        found = split_oversized(graph, found, most, resolution) if split else found
        found = sorted(found, key=lambda c: (-len(c), repr(sorted(c, key=repr)[0])))
        return pd.DataFrame([(pdf["repo"].iloc[0], u, n) for n, c in enumerate(found) for u in sorted(c, key=repr)], columns=["repo", "node", "community"])

    out = small.groupBy("repo").applyInPandas(run, f"repo string, node {kind}, community int")
    if spread is None:
        return out
    merged = spread.join(out.withColumnRenamed("node", "into"), ["repo", "into"]).select("repo", "node", "community")
    return out.unionByName(merged)


def logical_modules(ix: Index, min_files: int = 3, resolution: float = 1.5, most: int = 20, percentile: float = 90.0) -> DataFrame:
    """Communities of at least ``min_files`` members over more than one folder: by classes where a repository has a class graph, else by files."""
    classes = settled(class_graph(ix), "graph")
    with_classes = classes.select("repo").distinct()
    files = file_graph(ix).join(with_classes, "repo", "left_anti")
    nodes = class_nodes(ix).select("repo", F.col("id").alias("node"), "name", "path")
    by_class = communities(dampen_hubs(classes, percentile), resolution, most).join(nodes, ["repo", "node"])
    chunks = ix.chunks("id", "file_id").groupBy("file_id").agg(F.count("*").alias("chunks"))
    paths = ix.files("id", "repo", "path").join(chunks, F.col("id") == F.col("file_id"), "left").select("repo", F.col("path").alias("node"), F.substring_index("path", "/", -1).alias("name"), "path", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    by_file = communities(dampen_hubs(files, percentile), resolution, most).join(paths, ["repo", "node"])
    columns = ["repo", "community", "name", "path"]
    rows = by_class.select(*columns, F.lit(0).cast("long").alias("chunks"), F.lit("class").alias("level")).unionByName(by_file.select(*columns, "chunks", F.lit("file").alias("level")))
    out = rows.groupBy("repo", "level", "community").agg(
        F.count("*").alias("members"), F.countDistinct("path").alias("file_count"), F.countDistinct(directory(F.col("path"))).alias("directories"), F.sum("chunks").alias("chunk_count"),
        F.array_join(F.sort_array(F.collect_set("name")), ",").alias("member_symbols"),
    )
    return out.where((F.col("members") >= min_files) & (F.col("directories") > 1))
