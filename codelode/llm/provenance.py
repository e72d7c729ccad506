"""Generated, minified or vendored source files (problem 3).

Three operators, each with an output of its own:

- ``forest_scores``: the method named. A random forest over what the text looks like without its header (compression
  ratio, entropy of tokens as a share of the most, length of identifiers, share of very short ones, density of comments)
  and the row's bytes a line, labelled by the notices of generators in that header, which no feature sees. It is fitted on
  at most ``sample`` rows with text and scores every row.
- ``notices``: the notices themselves.
- ``conventions``: which convention of generators, bundlers and dependency folders the path follows, or whether the
  lines are longer than anybody writes. Only whole parts of a path count, so a folder of one's own about vendors or
  bundles is none. Conventions are neither label nor feature of the forest.

``not_hand_written`` joins them: a file is not hand-written if the forest says so, a notice does or a convention does.
The forest alone cannot give the required result (see the README for figures): copies of libraries carry no notice,
generated texts look like any others, and two thirds of the files in question have no text at all.

Defined cases: unknown sizes and texts have features of their own (-1); null paths follow no convention; repeated ids
count once, by the version indexed last; where no text or every text carries a notice, no forest can be fitted and the
score is null.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.workspace import settled

# Folders filled by package tools or holding third-party code, by common convention.
VENDOR_DIRS = (
    "node_modules bower_components jspm_packages vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd_party external externals extern deps_vendor "
    "site-packages dist-packages .tox .venv venv virtualenv .nox .eggs pods carthage checkouts godeps .bundle .yarn .pnp .cargo"
).split()
# Folders of generated or built output.
OUTPUT_DIRS = "generated __generated__ gen autogen auto_generated generated-sources generated-src generated_sources codegen_out obj .next .nuxt __pycache__ bazel-out".split()
GENERATED_NAME = (
    r"(?:\.pb\.(?:go|swift|cc|h|c)|_pb2(?:_grpc)?\.pyi?|\.pb|_grpc\.pb\.go|\.g\.(?:cs|dart|i\.cs)|\.designer\.(?:cs|vb)|\.generated\.\w+|[._-]generated\.\w+"
    r"|_gen\.\w+|\.gen\.\w+|zz_generated.*|\.tab\.[ch]|\.yy\.[ch]|lex\.yy\.c|\.deepcopy\.go|_string\.go|\.freezed\.dart|assemblyinfo\.cs)$"
)
MINIFIED_NAME = r"(?:[.\-_]min\.(?:js|mjs|cjs|css|ts)|\.bundle\.js|\.chunk\.js|\.packed\.js|[.\-][0-9a-f]{8,}\.js|\.[0-9a-z]{10,}\.js)$"
VERSIONED = r"(?:^|/)[A-Za-z][\w.]*[-_@]v?\d+\.\d+(?:\.\d+)?[\w.\-]*/"
NOTICE = re.compile(
    r"(?i)@generated\b|\bcode generated\b|\bdo not edit\b|\bauto-?generated (?:by|file|code|from)\b|\bgenerated (?:by|from|with) (?:the )?\w|\bproduced by a (?:tool|generator)\b"
    r"|\bchanges (?:to this file )?(?:will|may) be (?:lost|overwritten)\b|\bthis (?:file|code) (?:is|was) (?:auto(?:matically)?[- ]?)?generated\b"
)
TEXT_FEATURES = "compression entropy identifiers short comments".split()
FEATURES = [*TEXT_FEATURES, "line_bytes"]

_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]")
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?m:^[ \t]*#[^\n]*)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)")
_HEADER = re.compile(r"(?:\s*(?://[^\n]*|#(?!include|define|if|pragma|region)[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|--[^\n]*|;[^\n]*)\n?)+")


def header(text: str) -> tuple[str, str]:
    """(leading comments, the rest) of a text."""
    m = _HEADER.match(text.lstrip("﻿"))
    return (m.group(), text[m.end() :]) if m else ("", text)


def text_features(text: str | None) -> tuple[float, ...]:
    """(compression, entropy, identifiers, short, comments, notice) of a text, -1 where it is unknown or empty."""
    if not text:
        return (-1.0,) * len(TEXT_FEATURES) + (0.0,)
    head, body = header(text)
    notice = float(bool(NOTICE.search(head)))
    if not body.strip():
        return (-1.0,) * len(TEXT_FEATURES) + (notice,)
    raw = body.encode("utf-8", "replace")
    counts = Counter(_TOKEN.findall(body))
    total = sum(counts.values()) or 1
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    names = [(w, n) for w, n in counts.items() if w[0].isalpha() or w[0] == "_"]
    named = sum(n for _, n in names) or 1
    return (
        len(zlib.compress(raw, 3)) / len(raw), entropy / math.log2(total + 1), sum(len(w) * n for w, n in names) / named, sum(n for w, n in names if len(w) < 3) / named,
        sum(len(c) for c in _COMMENT.findall(body)) / len(body), notice,
    )


LONG_LINE = 350  # bytes a line that nobody writes on average


def line_bytes() -> Column:
    """Bytes a line; null where either number is unknown or there is no line."""
    return F.when(F.col("line_count") > 0, F.col("size_bytes") / F.col("line_count"))


def convention(path: Column) -> Column:
    """The convention a path follows (vendored, generated, minified), null if none."""
    low = F.lower(F.coalesce(path, F.lit("")))
    clean = F.regexp_replace(F.translate(low, "\\", "/"), r"^(\./)+", "")
    parts = F.split(clean, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    among = lambda names: F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    library = clean.rlike(VERSIONED) & (F.size(dirs) > 1)  # a folder named after a library and its version, not at the root
    return (
        F.when(among(VENDOR_DIRS) | library, "vendored").when(among(OUTPUT_DIRS) | name.rlike(GENERATED_NAME), "generated").when(name.rlike(MINIFIED_NAME), "minified")
    )


def conventions(files: DataFrame) -> DataFrame:
    """(id, convention) of every file: by its path, else ``long lines`` by its size, else null. Narrow, all in the JVM."""
    return files.select("id", F.coalesce(convention(F.col("path")), F.when(line_bytes() > LONG_LINE, "long lines")).alias("convention"))


def _text_rows(texts: DataFrame) -> DataFrame:
    """(id, TEXT_FEATURES, notice) of every text, one row per id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([text_features(t) for t in pdf["content"]], columns=[*TEXT_FEATURES, "notice"], dtype="float64")
            out.insert(0, "id", pdf["file_id"].to_numpy())
            yield out

    own = texts.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), "content")
    return own.mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in [*TEXT_FEATURES, "notice"])).dropDuplicates(["id"])


def features(files: DataFrame, texts: DataFrame | None) -> DataFrame:
    """(id, FEATURES, notice, convention) of every file; ``notice`` is null where there is no text."""
    rows = files.select("id", F.coalesce(F.log1p(line_bytes()), F.lit(-1.0)).alias("line_bytes"), F.coalesce(convention(F.col("path")), F.when(line_bytes() > LONG_LINE, "long lines")).alias("convention"))
    if texts is None:
        return rows.withColumns({c: F.lit(-1.0) for c in TEXT_FEATURES} | {"notice": F.lit(None).cast("double")})
    return rows.join(_text_rows(texts), "id", "left").withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in TEXT_FEATURES})


def notices(texts: DataFrame) -> DataFrame:
    """(id) of the texts whose header carries the notice of a generator."""
    return _text_rows(texts).where("notice > 0").select("id")


def forest_scores(rows: DataFrame, sample: int = 20_000, trees: int = 40, seed: int = 3) -> DataFrame:
    """``rows`` (see ``features``) with ``score``, the forest's share of votes for generated; null where none can be fitted.

    Labelled rows are those with text. Rows with a notice are kept first, so that a bounded sample holds both kinds.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = {r["notice"]: r["count"] for r in rows.where("notice is not null").groupBy("notice").count().collect()}  # two rows at most
    if len(known) < 2:
        return rows.withColumn("score", F.lit(None).cast("double"))
    share = {k: min(1.0, sample / 2 / n) for k, n in known.items()}
    some = rows.where("notice is not null").select(*FEATURES, "notice").sampleBy("notice", share, seed)
    some = some.withColumn("weight", F.when(F.col("notice") > 0, 1 / share[1.0]).otherwise(1 / share[0.0])).limit(2 * sample)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=8, maxBins=64, minInstancesPerNode=3, featureSubsetStrategy="0.6", seed=seed, labelCol="notice", featuresCol="features", weightCol="weight"
    )
    model = forest.fit(vector.transform(some).coalesce(8))
    return model.transform(vector.transform(rows)).select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def not_hand_written(files: DataFrame, texts: DataFrame | None = None, sample: int = 20_000, trees: int = 40, seed: int = 3) -> DataFrame:
    """(id, score, notice, convention, hand_written) of every file; ``files`` has one row per id, ``texts`` file_id and content."""
    rows = forest_scores(settled(features(files, texts), "provenance"), sample, trees, seed)
    notice = F.coalesce(F.col("notice") > 0, F.lit(False))
    by_hand = ~(notice | F.col("convention").isNotNull() | F.coalesce(F.col("score") >= 0.5, F.lit(False)))
    return rows.select("id", "score", notice.alias("notice"), "convention", by_hand.alias("hand_written"))
