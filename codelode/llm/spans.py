"""Long exact spans shared between records (problem 10).

Two operators:

``spans_in_reference`` follows the named method: suffix automata of reference shards are broadcast one after another and
texts are streamed through them for matching statistics. It fits a reference of bounded size.

``shared_spans`` finds what every record shares with any other record. Here the reference is the whole corpus, and with
the named method each of n shards would have to be broadcast to, and each text streamed n times: the work grows with
the square of the corpus. It therefore brings equal content together by content instead:

1. every window of ``least`` characters chooses an anchor, the ``gram`` inside it with the least hash; equal windows
   choose equal anchors at equal places, and successive windows mostly the same one. Per text this leaves about
   2 / (least - gram) runs of windows a character, each with its anchor and a hash of all characters it covers;
2. anchors found in one record only are dropped (by a window function over the anchor, so that runs are shuffled once and
   never written besides; a group too large for memory goes to disk, all in one task);
3. an anchor whose runs are all equal settles them at once, however many records have it: copies cost no more;
4. the windows of the other runs (where sharing begins or ends) are compared one by one, by their hash and place at
   the anchor, in the same way;
5. the stretches of each record are merged.

Hashes are 64 bits of a polynomial over mixed code points; windows are keyed by anchor hash, place and window hash.

Defined cases: null texts and texts shorter than ``least`` share nothing; repeated rows of one id are one record; equal
texts under different ids share everything; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.workspace import settled

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_RUNS = "doc_id long, anchor long, start int, windows int, covers long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _B)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _B_INV)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Hashed:
    """Prefix sums from which the hash of any stretch of one text follows."""

    def __init__(self, text: str, powers: _Powers):
        points = code_points(text)
        self.n = len(points)
        up, self.down = powers.get(self.n + 1)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=self.prefix[1:])

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.prefix[k:] - self.prefix[:-k]) * self.down[: self.n - k + 1])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.down[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: block-wise prefix and suffix minima."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _runs(text: str, least: int, gram: int, powers: _Powers) -> tuple[np.ndarray, ...] | None:
    """(anchor, first window, number of windows, hash of what they cover and where the anchor lies) of a text's runs."""
    if len(text) < least:
        return None
    with np.errstate(over="ignore"):
        h = _Hashed(text, powers)
        g = h.grams(gram)
        lowest = _window_min(g, least - gram + 1)
        # equal neighbours share their anchor unless the same gram occurs twice; then the run also splits at its first place
        change = np.flatnonzero(lowest[1:] != lowest[:-1]) + 1
        start = np.concatenate([[0], change])
        end = np.concatenate([change, [len(lowest)]])
        cover = h.stretch(start, end - 1 + least)
        return lowest[start].view(np.int64), start, end - start, (cover ^ _mix((end - start).astype(np.uint64))).view(np.int64)


def anchor_runs(docs: DataFrame, least: int, gram: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of windows of every text, see ``_RUNS``; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = _runs(t, least, gram, powers)
                if found:
                    cols[0].append(np.full(len(found[0]), d, np.int64))
                    for c, x in zip(cols[1:], found):
                        c.append(x)
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int64)
            arrays = [pa.array(np.concatenate(c).astype(k) if c else np.empty(0, k)) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "anchor", "start", "windows", "covers"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).mapInArrow(run, _RUNS)


_WINDOWS = "doc_id long, place long, start int"


def _window_hashes(docs: DataFrame, least: int) -> DataFrame:
    """The windows of the given runs, one by one: ``docs`` has doc_id, text and runs (array of anchor, start, windows).

    Equal windows have equal hashes whatever their run, and so the hash alone is their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            out: list[list] = [[], [], []]
            starts, counts = b.column(2), b.column(3)
            for d, t, ss, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), starts.to_pylist(), counts.to_pylist()):
                with np.errstate(over="ignore"):
                    h = _Hashed(t, powers)
                    s, n = np.asarray(ss, np.int64), np.asarray(ns, np.int64)
                    first = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                    at = np.unique(first + np.arange(n.sum()))
                    hashes = h.stretch(at, at + least)
                out[0].append(np.full(len(at), d, np.int64))
                out[1].append(hashes.view(np.int64))
                out[2].append(at.astype(np.int32))
            kinds = (np.int64, np.int64, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, k)) for c, k in zip(out, kinds)], ["doc_id", "place", "start"])

    return docs.mapInArrow(run, _WINDOWS)


def shared_spans(docs: DataFrame, least: int = 300, gram: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end): the maximal stretches of each text made of windows of ``least`` characters that occur in
    another record too; positions are characters from 0, end excluded, and stretches of a record neither touch nor overlap.
    """
    gram = gram or max(1, least * 3 // 5)
    # runs are as many bytes as the texts' files: an aggregation joined back would shuffle them twice and need them written
    shared = _in_two_records(anchor_runs(docs, least, gram, key, text), "anchor", "covers")
    known = settled(shared.select("doc_id", "start", "windows", "equal"), "spans")
    whole = known.where("equal").selectExpr("doc_id", "start", f"start + windows - 1 + {least} AS end")
    open_runs = known.where("not equal").groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= least)
    again = texts.join(open_runs, "doc_id").select("doc_id", "text", "starts", "counts")
    parts = _in_two_records(_window_hashes(again, least), "place").selectExpr("doc_id", "start", f"start + {least} AS end")
    return _merged(whole.unionByName(parts))


def _in_two_records(rows: DataFrame, by: str, same: str | None = None) -> DataFrame:
    """The rows whose ``by`` stands in more than one record, and in ``equal`` whether all rows of that ``by`` agree in ``same``."""
    group = Window.partitionBy(by)
    about = {"several": F.min("doc_id").over(group) != F.max("doc_id").over(group)}
    if same:
        about["equal"] = F.min(same).over(group) == F.max(same).over(group)
    return rows.withColumns(about).where("several").drop("several")


def _merged(parts: DataFrame) -> DataFrame:
    """Union of overlapping or touching stretches per record. A record's stretches are bounded by its own length."""
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, ss in zip(pdf["doc_id"], pdf["s"]):
                begin = stop = None
                for x in ss:
                    s, e = x["start"], x["end"]
                    if stop is None or s > stop:
                        if stop is not None:
                            out.append((d, begin, stop))
                        begin, stop = s, e
                    elif e > stop:
                        stop = e
                out.append((d, begin, stop))
            yield pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return joined.mapInPandas(merge, "doc_id long, start int, end int")


def shared_chars(docs: DataFrame, least: int = 300, **names: str) -> DataFrame:
    """(doc_id, shared_chars, spans): how much of each record lies in stretches shared with another; others are left out."""
    return shared_spans(docs, least, **names).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("spans"))


class SuffixAutomaton:
    """The suffix automaton of a text: every substring is a path, in linear space."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.size[q] == self.size[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def statistics(self, text: str) -> Iterator[int]:
        """For each position the length of the longest stretch ending there that the automaton's text holds."""
        state = length = 0
        for ch in text:
            while state and ch not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if ch in self.next[state]:
                state = self.next[state][ch]
                length += 1
            yield length

    def stretches(self, text: str, least: int) -> list[tuple[int, int]]:
        """Merged stretches of ``text`` covered by matches of at least ``least`` characters."""
        out: list[list[int]] = []
        for end, length in enumerate(self.statistics(text), 1):
            if length >= least:
                if out and end - length <= out[-1][1]:
                    out[-1] = [min(out[-1][0], end - length), end]
                else:
                    out.append([end - length, end])
        return [(s, e) for s, e in out]


def spans_in_reference(docs: DataFrame, reference: DataFrame, least: int = 300, shard_chars: int = 2_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end): stretches of the texts that occur verbatim in a reference of bounded size.

    Reference texts are gathered into shards of ``shard_chars`` characters; each shard's automaton is built in the tasks
    from its broadcast text, and the documents are streamed through one shard after another. The work is documents
    times shards: for evaluation sets, licences and the like, not for a corpus against itself.
    """
    spark, found = docs.sparkSession, None
    shards, part, size = [], [], 0
    for r in reference.where(F.length(text) >= least).select(text).toLocalIterator():
        part.append(r[0])
        size += len(r[0])
        if size >= shard_chars:
            shards.append(part)
            part, size = [], 0
    shards += [part] if part or not shards else []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= least)
    for shard in shards:
        shared = spark.sparkContext.broadcast("\x00".join(shard))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = SuffixAutomaton(shared.value)
            for pdf in batches:
                out = [(d, s, e) for d, t in zip(pdf["doc_id"], pdf["text"]) for s, e in automaton.stretches(t, least)]
                yield pd.DataFrame(out, columns=["doc_id", "start", "end"])

        one = rows.mapInPandas(run, "doc_id long, start int, end int")
        found = one if found is None else found.unionByName(one)
    return _merged(found)
