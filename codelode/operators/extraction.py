"""Extraction from source text: imports, references, enclosing chunks and service edges."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as an import, by language; the first group is the module.
IMPORTS = {
    "python": [r"^import\s+([\w.]+)", r"^from\s+([\w.]+)\s+import"],
    "typescript": [r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"],
    "javascript": [r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"],
    "rust": [r"use\s+([\w:]+)", r"extern\s+crate\s+(\w+)"],
    "go": [r"\"([^\"]+)\""],
    "java": [r"import\s+([\w.]+)"],
    "c": [r"#include\s+[<\"]([^>\"]+)[>\"]"],
    "cpp": [r"#include\s+[<\"]([^>\"]+)[>\"]"],
    "swift": [r"^import\s+([\w.]+)"],
    "csharp": [r"^(?:global\s+)?using\s+static\s+([\w.]+)\s*;", r"^(?:global\s+)?using\s+\w+\s*=\s*([\w.]+)\s*;", r"^(?:global\s+)?using\s+([\w.]+)\s*;"],
}
# How names are referred to, and the words that are no names.
TYPE_NAME = r"(?U)\b([A-Z][A-Za-z0-9_]*)\b"
CALL = r"(?U)(?<![.\w])([a-z_][A-Za-z0-9_]*)\s*\("
MEMBER_CALL = r"(?U)\.([A-Za-z_][A-Za-z0-9_]*)\s*\("
NO_NAMES = (
    "as catch class defer else enum extension for func guard if import init in let private protocol public return struct subscript switch throw try var where while"
).split()
SERVICE_ENDINGS = ("Service", "Manager", "Coordinator", "Resolver", "Store")


def strip_separators(text: Column) -> Column:
    """Text without lines that only draw a line: ``/*****/`` and ``// ----``."""
    out = F.regexp_replace(text, r"(?m)^[ \t]*/\*[\* \t]*\*/[ \t]*\n?", "")
    return F.regexp_replace(out, r"(?m)^[ \t]*//[ \t]*[-=+\*]{3,}[ \t]*\n?", "")


def numbered_lines(texts: DataFrame, content: str = "content", *keep: str) -> DataFrame:
    """(keep, line_no from 1, line)."""
    rows = texts.select(*keep, F.posexplode(F.split(content, "\n")).alias("p", "line"))
    return rows.select(*keep, (F.col("p") + 1).alias("line_no"), "line")


def imports(texts: DataFrame) -> DataFrame:
    """(file_id, line_no, module, kind, raw): per line the first pattern of its language that matches.

    ``texts`` has file_id, language and content; other languages import nothing.
    """
    lines = numbered_lines(texts.where(F.col("language").isin(*IMPORTS)), "content", "file_id", "language").withColumn("raw", F.regexp_replace("line", r"^\s+|\s+$", ""))

    def module(patterns: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("raw", p, 1), F.lit("")) for p in patterns])

    found = reduce(lambda acc, kv: acc.when(F.col("language") == kv[0], module(kv[1])), list(IMPORTS.items())[1:], F.when(F.col("language") == "python", module(IMPORTS["python"])))
    return lines.withColumn("module", found).where("module is not null").select("file_id", "line_no", "module", F.lit("import").alias("kind"), "raw")


def _named(pattern: str, kind: str) -> Column:
    """The distinct names a pattern finds in ``line``, with their kind."""
    names = F.array_distinct(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))
    return F.transform(names, lambda n: F.struct(n.alias("target_name"), F.lit(kind).alias("reference_kind")))


def references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_symbol_name, target_name, reference_kind, line_no), each once per chunk and line.

    ``chunks`` has id, content, start_line, symbol_name and parent_symbol. Names of one's own symbol don't count.
    """
    lines = numbered_lines(chunks.where("content is not null"), "content", "id", "start_line", "symbol_name", "parent_symbol")
    lines = lines.select(
        F.col("id").alias("chunk_id"), F.coalesce(F.nullif("symbol_name", F.lit("")), "parent_symbol").alias("source_symbol_name"), (F.col("start_line") + F.col("line_no") - 1).cast("int").alias("line_no"),
        F.concat(_named(TYPE_NAME, "type_reference"), _named(CALL, "call"), _named(MEMBER_CALL, "member_call")).alias("found"),
    )
    rows = lines.select("chunk_id", "source_symbol_name", "line_no", F.inline("found"))
    return rows.where(~F.col("target_name").isin(*NO_NAMES) & (F.col("source_symbol_name").isNull() | (F.col("target_name") != F.col("source_symbol_name"))))


def enclosing_chunks(lines: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` (file_id, line_no) with the id of the smallest chunk around each; null where there is none.

    An equi join on the file with the range as a condition, then the least by size and id per ``keys``.
    """
    spans = chunks.select("file_id", "start_line", "end_line", F.col("id").alias("chunk_id"))
    inside = lines.join(spans, "file_id").where("line_no between start_line and end_line")
    best = inside.groupBy(*keys).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "chunk_id")).alias("b"))
    return lines.join(best.select(*keys, F.col("b.chunk_id").alias("enclosing_chunk_id")), keys, "left")


def clean_type(name: Column) -> Column:
    """The bare name of a type: without ``?``, ``!``, generics and module."""
    out = F.regexp_replace(F.trim(name), r"[?!]+$", "")
    return F.substring_index(F.regexp_replace(out, r"<.*?>", ""), ".", -1)


# Typed properties, initialisers, their parameters and calls on members.
_PROPERTY = r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:\w+\s+)*(?:let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([A-Za-z_][A-Za-z0-9_<>.?\[\]]*)"
_INIT = r"(?s)\binit\s*\((.*?)\)"
_PARAMETER = r"(?:[A-Za-z_][A-Za-z0-9_]*\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([A-Za-z_][A-Za-z0-9_<>.?\[\]]*)"
_MEMBER = r"\b([a-z_][A-Za-z0-9_]*)\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("
_SITES = "file_id long, what string, name string, type string, line_no int, pos int"


def _sites(batches):
    """Places in Swift texts that declare or use a member: a batch-wise scan, as one match may span lines."""
    import re

    prop, init, param, member = (re.compile(p) for p in (_PROPERTY, _INIT, _PARAMETER, _MEMBER))
    for pdf in batches:
        out = []
        for file_id, text in zip(pdf["file_id"], pdf["content"]):
            line = lambda at: text.count("\n", 0, at) + 1  # noqa: E731, B023
            n = 0
            for m in prop.finditer(text):
                out.append((file_id, "type_reference", m[1], m[2], line(m.start()), n := n + 1))
            for m in init.finditer(text):
                out += [(file_id, "injection", p[1], p[2], line(m.start()), n := n + 1) for p in param.finditer(m[1])]
            out += [(file_id, "service_usage", m[1], None, line(m.start()), n := n + 1) for m in member.finditer(text)]
        yield pd.DataFrame(out, columns=["file_id", "what", "name", "type", "line_no", "pos"])


def service_edges(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, source_symbol_name, target_name, kind, line_no): how Swift code holds, is given and uses services.

    A member's type is that of its last typed property, else of its first initialiser parameter; only types with a
    service-like ending count. ``chunks`` has id, file_id, start_line, end_line, symbol_name, symbol_type, parent_symbol.
    """
    sites = texts.where("content is not null").select("file_id", "content").mapInPandas(_sites, _SITES).withColumn("type", clean_type(F.col("type")))
    service = reduce(Column.__or__, [F.endswith("type", F.lit(e)) for e in SERVICE_ENDINGS])
    typed = sites.where(F.col("type").isNotNull() & service)
    rank = F.when(F.col("what") == "type_reference", F.struct(F.lit(0).alias("k"), (-F.col("pos")).alias("p"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("pos").alias("p")))
    members = typed.groupBy("file_id", "name").agg(F.min_by("type", rank).alias("member_type"))
    used = sites.where("what = 'service_usage'").join(members, ["file_id", "name"]).withColumn("type", F.col("member_type")).drop("member_type")
    found = typed.unionByName(used)
    own = enclosing_chunks(found, chunks, ["file_id", "pos"])
    own = own.join(chunks.select(F.col("id").alias("enclosing_chunk_id"), "symbol_name", "symbol_type", "parent_symbol"), "enclosing_chunk_id", "left")
    parent = F.nullif("parent_symbol", F.lit(""))
    lifted = (F.col("what") == "service_usage") | (F.col("symbol_type") == "method")
    source = F.when(lifted & parent.isNotNull(), parent).otherwise(F.col("symbol_name"))
    return own.select("file_id", source.alias("source_symbol_name"), F.col("type").alias("target_name"), F.col("what").alias("kind"), "line_no").distinct()


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """Symbol rows with ``parent_id`` resolved: the container of the same file whose qualified name is path:container.

    Where several containers share a name, the last one before the member counts.
    """
    own = symbols.select("file_id", F.col("id").alias("p_id"), F.col("qualified_name").alias("p_name"), F.col("start_line").alias("p_line"))
    path = F.substring_index("qualified_name", ":", 1)
    wanted = F.when(F.col("container_symbol").isNotNull(), F.concat(path, F.lit(":"), "container_symbol"))
    keyed = symbols.withColumn("p_name", wanted)
    near = keyed.join(own, ["file_id", "p_name"], "left").where(F.col("p_line").isNull() | (F.col("p_line") <= F.col("start_line")) | F.col("p_id").isNull())
    order = Window.partitionBy("id").orderBy(F.col("p_line").desc_nulls_last(), F.col("p_id").desc_nulls_last())
    picked = near.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", F.col("p_id").alias("resolved_parent_id"))
    return symbols.join(picked, "id", "left")
