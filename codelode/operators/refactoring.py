"""Coupling, interfaces and seams of the part of each repository under a path prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.columns import joined, under
from codelode.operators.edges import declaration_counts, reference_counts, resolved_references
from codelode.sources.tables import Index

_COUPLING = ["repo", "direction", "internal_path", "external_path", "kind", "edge_count"]


def coupling_outbound(ix: Index, prefix: str) -> DataFrame:
    """Dependencies that leave the part; a target in another repository counts as external."""
    files = ix.files("id", "repo", "path")
    inner = files.where(under(F.col("path"), prefix)).select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("internal_path"))
    targets = files.select(F.col("id").alias("target_file_id"), "repo", F.col("path").alias("target_path"))
    deps = ix.dependencies("id", "source_file_id", "target_file_id", "kind", "external_module").join(inner, "source_file_id").join(targets, ["target_file_id", "repo"], "left")
    out = deps.where(F.col("target_path").isNull() | ~under(F.col("target_path"), prefix))
    external = F.coalesce("target_path", "external_module", F.lit("(external)"))
    return _counted(out.select("repo", "internal_path", external.alias("external_path"), "kind"), "outbound")


def _counted(rows: DataFrame, direction: str) -> DataFrame:
    counted = rows.groupBy("repo", "internal_path", "external_path", "kind").agg(F.count("*").alias("edge_count"))
    return counted.withColumn("direction", F.lit(direction)).select(*_COUPLING)


def coupling_inbound(ix: Index, prefix: str) -> DataFrame:
    """Dependencies that enter the part from the same repository."""
    files = ix.files("id", "repo", "path")
    inner = files.where(under(F.col("path"), prefix)).select(F.col("id").alias("target_file_id"), "repo", F.col("path").alias("internal_path"))
    outer = files.where(~under(F.col("path"), prefix)).select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("external_path"))
    deps = ix.dependencies("id", "source_file_id", "target_file_id", "kind").join(inner, "target_file_id").join(outer, ["source_file_id", "repo"])
    return _counted(deps, "inbound")


def _coupled_references(ix: Index, prefix: str, outbound: bool) -> DataFrame:
    inner, outer = ("source", "target") if outbound else ("target", "source")
    rows = resolved_references(ix).where(under(F.col(inner), prefix) & ~under(F.col(outer), prefix))
    counted = rows.groupBy("repo", F.col(inner).alias("internal_path"), F.col(outer).alias("external_path"), "kind").agg(F.sum("edges").alias("edge_count"))
    return counted.withColumn("direction", F.lit("ref_outbound" if outbound else "ref_inbound")).select(*_COUPLING)


def coupling_ref_out(ix: Index, prefix: str) -> DataFrame:
    """References from the part to declarations outside it."""
    return _coupled_references(ix, prefix, True)


def coupling_ref_in(ix: Index, prefix: str) -> DataFrame:
    """References from outside to declarations in the part."""
    return _coupled_references(ix, prefix, False)


def analyze_coupling(ix: Index, prefix: str) -> DataFrame:
    """All four kinds of edges across the border."""
    return coupling_outbound(ix, prefix).unionByName(coupling_inbound(ix, prefix)).unionByName(coupling_ref_out(ix, prefix)).unionByName(coupling_ref_in(ix, prefix))


def coupling_metrics(ix: Index, prefix: str) -> DataFrame:
    """Per repository: distinct external paths depended on (ce) and depending (ca), instability ce / (ca + ce), edges a file, and a label."""
    inner = ix.files("id", "repo", "path").where(under(F.col("path"), prefix)).groupBy("repo").agg(F.count("*").alias("internal_files"))
    edges = analyze_coupling(ix, prefix)
    out = F.col("direction").isin("outbound", "ref_outbound")
    m = edges.groupBy("repo").agg(
        F.countDistinct(F.when(out, F.col("external_path"))).alias("ce"), F.countDistinct(F.when(~out, F.col("external_path"))).alias("ca"),
        F.sum("edge_count").alias("edges"), F.sum(F.when(out, F.col("edge_count")).otherwise(0)).alias("edges_out"),
    )
    instability = F.coalesce(F.try_divide(F.col("ce").cast("double"), (F.col("ca") + F.col("ce")).cast("double")), F.lit(0.0))
    m = m.join(inner, "repo").withColumn("instability", F.round(instability, 6)).withColumn("edges_per_file", F.round(F.col("edges") / F.col("internal_files"), 6))
    return m.withColumn("label", F.when(F.col("instability") > 0.7, "volatile").when(F.col("instability") < 0.3, "stable").otherwise("moderate"))


def _module_symbols(ix: Index, prefix: str, public_only: bool) -> DataFrame:
    files = ix.files("id", "repo", "path").where(under(F.col("path"), prefix)).select(F.col("id").alias("file_id"), "repo", F.col("path").alias("file_path"))
    symbols = ix.symbols("id", "file_id", "name", "qualified_name", "kind", "signature", "visibility", "is_exported", "start_line", "end_line", "container_symbol")
    symbols = symbols.where("is_exported or visibility = 'public'") if public_only else symbols
    return symbols.join(files, "file_id").withColumnRenamed("id", "symbol_id").withColumn("name_lc", F.lower("name"))


def _consumers(parts: DataFrame) -> DataFrame:
    """Per repository and name: the paths outside that use it, how often and in which ways."""
    return parts.groupBy("repo", "name_lc").agg(
        joined(F.collect_set("consumer")).alias("consumer_files"), F.sum("n").alias("total_refs"), joined(F.collect_set("kind")).alias("ref_kinds")
    )


def _outside_references(ix: Index, prefix: str) -> DataFrame:
    refs = reference_counts(ix).where(~under(F.col("source"), prefix))
    return refs.select("repo", "name_lc", F.col("source").alias("consumer"), F.col("reference_kind").alias("kind"), F.col("refs").alias("n"))


def module_interface(ix: Index, prefix: str, include_unused: bool = False) -> DataFrame:
    """Exported or public symbols of the part that others in the repository use, by reference or dependency.

    Names are compared ignoring case throughout, so spellings of one name make one row.
    """
    own = _module_symbols(ix, prefix, True)
    refs = _outside_references(ix, prefix).join(own.select("repo", "name_lc").distinct(), ["repo", "name_lc"], "left_semi")
    files = ix.files("id", "repo", "path").where(~under(F.col("path"), prefix)).select(F.col("id").alias("source_file_id"), "repo", F.col("path").alias("consumer"))
    targets = _module_symbols(ix, prefix, False).select(F.col("symbol_id").alias("target_symbol_id"), F.col("name_lc"))
    deps = ix.dependencies("id", "source_file_id", "target_symbol_id", "kind").join(targets, "target_symbol_id").join(files, "source_file_id")
    deps = deps.groupBy("repo", "name_lc", "consumer", "kind").agg(F.count("*").alias("n"))
    used = _consumers(refs.unionByName(deps))
    return own.join(used, ["repo", "name_lc"], "left" if include_unused else "inner").drop("name_lc", "file_id", "is_exported")


def seam_interfaces(ix: Index, prefix: str) -> DataFrame:
    """Symbols of the part, public or not, that references from outside use."""
    own = _module_symbols(ix, prefix, False)
    return own.join(_consumers(_outside_references(ix, prefix)), ["repo", "name_lc"]).drop("name_lc", "file_id", "is_exported")


_SEAM = ["repo", "direction", "internal_file", "external_file", "symbol_name", "symbol_kind", "signature", "reference_kind", "usage_count"]


def _seams(ix: Index, prefix: str, outbound: bool) -> DataFrame:
    refs, decls = reference_counts(ix, "target_name"), declaration_counts(ix, "kind", "signature")
    inner, outer = ("source", "target") if outbound else ("target", "source")
    refs = refs.where(under(F.col("source"), prefix) if outbound else ~under(F.col("source"), prefix))
    decls = decls.where(~under(F.col("target"), prefix) if outbound else under(F.col("target"), prefix))
    both = refs.join(decls, ["repo", "name_lc"])
    return both.groupBy(
        "repo", F.lit("outbound" if outbound else "inbound").alias("direction"), F.col(inner).alias("internal_file"), F.col(outer).alias("external_file"),
        F.col("target_name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), "signature", "reference_kind",
    ).agg(F.sum(F.col("refs") * F.col("decls")).alias("usage_count")).select(*_SEAM)


def seam_dependencies(ix: Index, prefix: str) -> DataFrame:
    """Symbols from outside that the part uses, by place of use and kind of reference."""
    return _seams(ix, prefix, True)


def seam_edges(ix: Index, prefix: str) -> DataFrame:
    """All reference edges across the border, both ways."""
    return _seams(ix, prefix, False).unionByName(_seams(ix, prefix, True))


def seam_plan(ix: Index, prefix: str) -> DataFrame:
    """Per repository what extracting the part takes: interfaces to keep, distinct dependencies to inject, references to cut, and how hard that is."""
    files = ix.files("id", "repo", "path").where(under(F.col("path"), prefix)).groupBy("repo").agg(F.count("*").alias("internal_files"))
    interfaces = seam_interfaces(ix, prefix).groupBy("repo").agg(F.count("*").alias("interfaces"))
    deps = seam_dependencies(ix, prefix).groupBy("repo", "symbol_name").agg(F.max("usage_count").alias("most"))
    deps = deps.groupBy("repo").agg(F.count("*").alias("dependencies"), F.sum("most").alias("dependency_usage"))
    seams = seam_edges(ix, prefix).groupBy("repo").agg(F.sum("usage_count").alias("seams"))
    out = files.join(interfaces, "repo", "left").join(deps, "repo", "left").join(seams, "repo", "left")
    out = out.fillna(0, ["interfaces", "dependencies", "dependency_usage", "seams"])
    hard = (F.col("interfaces") > 10) | (F.col("dependencies") > 10) | (F.col("seams") > 50)
    moderate = (F.col("interfaces") > 5) | (F.col("dependencies") > 5) | (F.col("seams") > 20)
    return out.withColumn("difficulty", F.when(hard, "HIGH").when(moderate, "MODERATE").otherwise("LOW"))
