"""Evaluation texts leaking into training text (problem 9).

Pigeonhole edit matching. An item is looked for in two kinds of unit: as a whole, with an error budget of one word in
``share``, and in its passages, which are every ``passage`` consecutive words, with a budget of ``edits`` words. A unit
of budget b is cut into b + 1 pieces; a stretch within b edits of it must hold one piece exactly. An Aho-Corasick
automaton over the pieces of all units finds those in one pass over each text. The places of a unit that overlap are
united, and Myers' bit-parallel edit distance, over words, decides on each united place once, so the work is linear in
the text however often a piece repeats. A row comes out if a unit is within its budget. The longest exact run, a second
output, is read off the matching statistics of the item's suffix automaton over the same places.

Items are broadcast in blocks of at most about ``block_bytes`` of text. With several blocks each is written before the
next is gathered, so neither the driver nor the executors hold more than one.

Defined cases: null or blank texts match nothing; items shorter than a passage match as a whole only, those of fewer
than ``least`` words not at all; equal items all match; repeated documents or items give one row (of items that differ
under one id the least text counts); extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.spans import SuffixAutomaton
from codelode.workspace import settled

SCHEMA = "doc_id long, item_id long, passage_edits int, distance int, run int, at_word int"
_KEEP = bytes(c if chr(c).isalnum() and chr(c).isascii() and not chr(c).isupper() else 32 for c in range(256))


def normal(text: str) -> str:
    """The words of a text (runs of a-z and 0-9 after lower-casing), each between single spaces."""
    words = text.lower().encode("ascii", "replace").translate(_KEEP).split()
    return (b" " + b" ".join(words) + b" ").decode("ascii") if words else ""


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 balanced pieces of ``n_words`` words, as (start, end): one of them survives ``budget`` edits."""
    k = budget + 1
    return [(n_words * i // k, n_words * (i + 1) // k) for i in range(k)]


def masks(pattern: list[str]) -> dict[str, int]:
    """For each word of the pattern the places where it stands, as bits."""
    peq: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    return dict(peq)


def myers(pattern: list[str], text: list[str], peq: dict[str, int] | None = None) -> tuple[int, int]:
    """(least distance, end) of ``pattern`` against any stretch of ``text``, bit-parallel over the pattern's words."""
    m, peq = len(pattern), masks(pattern) if peq is None else peq
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask  # the stretch may begin anywhere, so the first row stays 0
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break  # no later place can be closer
    return best, end


def united(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Spans within 0..``most``, in order, those that touch united."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        s, e = max(0, s), min(most, e)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Unit:
    """A stretch of an item that is matched with ``budget`` edits: its passages and the item itself."""

    __slots__ = ("item", "words", "budget", "whole", "masks")

    def __init__(self, item: int, words: list[str], budget: int, whole: bool):
        self.item, self.words, self.budget, self.whole, self.masks = item, words, budget, whole, None

    def distance(self, text: list[str]) -> int | None:
        """The edits to the closest stretch of ``text``, if within the budget.

        Each word of the unit that has no partner costs an edit, so a text with too few of its words is out at once.
        """
        if self.masks is None:
            self.masks = masks(self.words)
        if sum(map(self.masks.__contains__, text)) < len(self.words) - self.budget:
            return None
        d = myers(self.words, text, self.masks)[0]
        return d if d <= self.budget else None


class Matcher:
    """The pieces of the units of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], passage: int = 12, edits: int = 1, share: int = 6, least: int = 12):
        self.words: dict[int, list[str]] = {}
        self.runs: dict[int, SuffixAutomaton] = {}
        where: dict[str, list[tuple[Unit, int]]] = defaultdict(list)

        def enter(unit: Unit) -> None:
            for s, e in pieces(len(unit.words), unit.budget):
                where[" " + " ".join(unit.words[s:e]) + " "].append((unit, s))

        for item_id, text in items:
            words = normal(text).split()
            if len(words) < least:
                continue
            self.words[item_id] = words
            enter(Unit(item_id, words, len(words) // share, True))
            for p in dict.fromkeys(tuple(words[i : i + passage]) for i in range(len(words) - passage + 1)):
                enter(Unit(item_id, list(p), edits, False))
        self.automaton = ahocorasick.Automaton()
        for k, v in where.items():
            self.automaton.add_word(k, (len(k), v))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> Iterator[tuple[int, int | None, int | None, int, int]]:
        """(item, least edits of a passage, edits of the whole, longest exact run, its first word) of every item with a unit within its budget."""
        s = normal(text) if text and not self.empty else ""
        hits = [(end - size + 1, v) for end, (size, v) in self.automaton.iter(s)] if s else []
        if not hits:
            return
        doc = s.split()
        places: dict[int, dict[Unit, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        word, seen = 0, 0
        for start, v in sorted(hits, key=lambda h: h[0]):
            word += s.count(" ", seen, start)
            seen = start
            for unit, offset in v:
                begin = word - offset  # where the unit would begin
                places[unit.item][unit].append((begin - unit.budget, begin + len(unit.words) + unit.budget))
        for item_id, units in places.items():
            found: dict[bool, int | None] = {True: None, False: None}
            spans: list[tuple[int, int]] = []
            for unit, windows in units.items():
                windows = united(windows, len(doc))
                spans += windows
                if found[unit.whole] == 0:
                    continue
                for a, b in windows:
                    d = unit.distance(doc[a:b])
                    if d is not None and (found[unit.whole] is None or d < found[unit.whole]):
                        found[unit.whole] = d
            if found[True] is not None or found[False] is not None:
                yield item_id, found[False], found[True], *self._run(item_id, doc, united(spans, len(doc)))

    def _run(self, item_id: int, doc: list[str], spans: list[tuple[int, int]]) -> tuple[int, int]:
        """(words, first word) of the longest exact run of the item within the spans."""
        automaton = self.runs.get(item_id)
        if automaton is None:
            automaton = self.runs[item_id] = SuffixAutomaton(self.words[item_id])
        best = at = 0
        for a, b in spans:
            for end, n in enumerate(automaton.statistics(doc[a:b]), a + 1):
                if n > best:
                    best, at = n, end - n
        return best, at


def leaks(docs: DataFrame, items: DataFrame, passage: int = 12, edits: int = 1, share: int = 6, least: int = 12, block_bytes: int = 32 << 20) -> DataFrame:
    """Each document with each item that leaked into it, see ``SCHEMA``.

    ``passage_edits`` are the edits of the closest passage (null above ``edits``), ``distance`` those of the whole item
    (null above one in ``share`` of its words), ``run`` the longest exact run of words and ``at_word`` its place.
    One narrow pass over the documents per block of items, no shuffle of texts; the final aggregate moves only hits.
    """
    spark = docs.sparkSession
    test = items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    total = test.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def scan(n: int) -> DataFrame:
        part = test.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n) if blocks > 1 else test
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.select("item_id", "text").collect()])  # at most about block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, passage, edits, share, least)
            names = ["doc_id", "item_id", "passage_edits", "distance", "run", "at_word"]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            for b in batches:
                out = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if d is not None for hit in matcher.find(t or "")]
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        if blocks > 1:
            found = settled(found, "leaks")
            shared.destroy()
        return found

    found = reduce(DataFrame.unionByName, [scan(n) for n in range(blocks)])
    best = F.max_by(F.struct("run", "at_word"), F.struct("run", -F.col("at_word"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(F.min("passage_edits").alias("passage_edits"), F.min("distance").alias("distance"), best).select(
        "doc_id", "item_id", "passage_edits", "distance", "m.run", "m.at_word"
    )
