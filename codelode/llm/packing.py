"""Filling fixed-capacity containers with items (problem 8).

Vector best-fit decreasing: a container has residual capacities for tokens, documents and attention cost (the sum of
squared lengths). Documents are placed in order of falling length into the open container that fits under every
constraint and scores best, by the weighted dot product of demand and residual or by the weighted norm of the residual
left over; where none fits a new one is opened.

Items are spread by a hash over groups of a bounded number of tokens, each packed by itself in one task, so no task
grows with the corpus and no hot source matters. A group leaves about one container partly filled, out of
``group_tokens / capacity``; that is the price, 0.1 % at the defaults.

Defined cases: a document longer than a capacity is cut into pieces of just that size and a remainder, packed like
others; a text without tokens (null, empty) needs no room and has a null container; repeated rows of one id are one
document.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.workspace import settled

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, piece int, tokens int, container long"


@dataclass(frozen=True)
class Capacity:
    """Of one container; ``cost`` bounds the sum of squared lengths (by default what one full document costs)."""

    tokens: int = 4096
    documents: int = 64
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"  # or "dot"

    @property
    def most_cost(self) -> int:
        return self.cost or self.tokens**2

    @property
    def longest(self) -> int:
        """The longest item that fits an empty container."""
        return min(self.tokens, math.isqrt(self.most_cost))


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file; needs the file on every node."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row, 0 for null; a narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["doc_id", "tokens"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens int").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def pack(sizes: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers) for items that each fit an empty container."""
    n = len(sizes)
    out = np.empty(n, np.int64)
    total = np.array([capacity.tokens, capacity.documents, capacity.most_cost], np.float64)
    weights = np.asarray(capacity.weights) / total**2
    room = np.empty((3, 256), np.float64)  # residual capacities of open containers
    number = np.empty(256, np.int64)
    live = opened = 0
    order = np.argsort(-sizes, kind="stable")
    least = int(sizes.min()) if n else 0
    for i in order:
        size = int(sizes[i])
        demand = np.array([size, 1, size * size], np.float64)
        at = -1
        if live:
            left = room[:, :live] - demand[:, None]
            fits = (left >= 0).all(axis=0)
            if fits.any():
                score = -(weights @ (left * left)) if capacity.rule == "norm" else (weights * demand) @ room[:, :live] * -1
                at = int(np.where(fits, score, -np.inf).argmax())
        if at < 0:
            if live == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            at, live = live, live + 1
            room[:, at], number[at] = total, opened
            opened += 1
        room[:, at] -= demand
        out[i] = number[at]
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least * least:  # closed: nothing fits any more
            live -= 1
            room[:, at], number[at] = room[:, live], number[live]
    return out, opened


def pack_documents(
    docs: DataFrame, capacity: Capacity | None = None, vocabulary: str = VOCABULARY, group_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Container numbers of every document or piece, see ``SCHEMA``. Numbers are unique, not dense over groups."""
    capacity = capacity or Capacity()
    sizes = settled(token_counts(docs, vocabulary, key, text), "sizes")
    total = sizes.agg(F.sum(F.col("tokens").cast("long"))).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    whole = F.lit(capacity.longest)
    count = F.greatest(F.lit(1), F.ceil(F.col("tokens") / whole).cast("int"))
    pieces = sizes.select("doc_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"), F.col("tokens").alias("all")).select(
        "doc_id", "piece", F.least(whole, F.col("all") - F.col("piece") * whole).cast("int").alias("tokens")
    )
    full = pieces.where(F.col("tokens") > 0).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
        at, _ = pack(pdf["tokens"].to_numpy(), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "tokens": pdf["tokens"], "container": at * groups + pdf["group"]})

    packed = full.groupBy("group").applyInPandas(run, SCHEMA)
    return packed.unionByName(pieces.where("tokens = 0").withColumn("container", F.lit(None).cast("long")))


def fill(packed: DataFrame) -> DataFrame:
    """(containers, tokens, least_possible) of a packing: how close it comes to the bound by tokens."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum(F.col("tokens").cast("long")).alias("tokens"))
