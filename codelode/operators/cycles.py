"""Simple cycles of bounded length in the graph of each repository, each found where its least file is.

The files of a repository are numbered in the order of their paths. The work is dealt out by the cycles' first step: a share has
the repository's whole graph as packed numbers and some of the steps (least file, file after it). Within a share, paths are
grown from the least file only through files from which it can be reached in the steps left, in blocks of bounded size. Whether a
cycle's path is the least one over its set of files follows from the edges among these files alone; so cycles are neither
gathered nor compared, and a path is text only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 17  # paths grown at once
DENSE = 1 << 28  # a graph's edges are a table of bytes up to this size, else they are searched
EDGES_A_SHARE, MOST_SHARES = 500, 192
_FAR = 99
_GRAPH = "repo string, share int, files array<string>, first binary, targets binary, starts binary"


def _spans(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of each element of the spans."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) + np.repeat(begin - np.cumsum(count) + count, count)


def _index(sources: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(sources, minlength=n))])


def _trimmed(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges without those of files that have no edge in or none out, again and again."""
    while len(a):
        into, out = np.zeros(n, bool), np.zeros(n, bool)
        into[b] = out[a] = True
        keep = into[a] & out[b]
        if keep.all():
            break
        a, b = a[keep], b[keep]
    return a, b


def _shares(a: np.ndarray, b: np.ndarray, n: int, length: int) -> list[np.ndarray]:
    """(file, from, to) for the least files and the part of their edges to begin with, by share; the edges are sorted."""
    up, down = b > a, a > b
    first, begin = _index(a, n), np.arange(n)
    low = first[:-1] + np.bincount(a[down | (a == b)], minlength=n)
    steps = first[1:] - low
    weight = steps * np.bincount(b[down], minlength=n) * (1 - begin / n) ** max(0, length - 3)
    starts = np.flatnonzero(weight > 0)
    if not len(starts):
        return []
    number = min(MOST_SHARES, 1 + len(a[up]) // EDGES_A_SHARE)
    unit = weight.sum() / number / 2
    pieces = []
    for s in starts:
        parts = int(min(steps[s], 1 + weight[s] // unit))
        cuts = low[s] + np.arange(parts + 1) * steps[s] // parts
        pieces += [(weight[s] / parts, s, x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    # heavy and light pieces in turn, to and fro
    place = np.arange(len(pieces)) % (2 * number)
    place = np.where(place < number, place, 2 * number - 1 - place)
    out = np.array([p[1:] for p in pieces], np.int64)
    return [x[np.lexsort((x[:, 1], x[:, 0]))] for k in range(number) if len(x := out[place == k])]


def deal(edges: pa.Table, length: int) -> Iterator[dict]:
    """The shares of one repository's graph, as rows of _GRAPH without the repository."""
    source, target = (edges[c].combine_chunks().cast(pa.string()) for c in ("source", "target"))
    files = pc.unique(pa.concat_arrays([source, target]))
    files = files.take(pc.sort_indices(files))
    a, b = (pc.index_in(x, files).to_numpy(zero_copy_only=False).astype(np.int64) for x in (source, target))
    n = len(files)
    for _ in range(2):  # what is trimmed takes its files along
        a, b = _trimmed(a[a != b], b[a != b], n)
        kept = np.unique(np.concatenate([a, b]))
        a, b, files, n = np.searchsorted(kept, a), np.searchsorted(kept, b), files.take(pa.array(kept)), len(kept)
    a, b = np.divmod(np.unique(a * max(n, 1) + b), max(n, 1))
    for k, starts in enumerate(_shares(a, b, n, length)):
        yield {"share": k, "files": files, "first": _index(a, n).tobytes(), "targets": b.astype(np.int32).tobytes(), "starts": starts.tobytes()}


class Walker:
    """The cycles of at most ``length`` files of a graph; ``targets`` holds each file's targets in order, from ``first`` on."""

    def __init__(self, first: np.ndarray, targets: np.ndarray, length: int):
        self.n, self.length, self.first, self.targets = len(first) - 1, length, first, targets.astype(np.int64)
        sources = np.repeat(np.arange(self.n), np.diff(first))
        order = np.argsort(targets, kind="stable")
        self.back_first, self.back = _index(targets, self.n), sources[order]
        self.dist = np.full(self.n, _FAR, np.int8)
        self.keys = sources * self.n + targets
        self.table = None
        if self.n * self.n <= DENSE:
            self.table = np.zeros(self.n * self.n, np.int8)
            self.table[self.keys] = 1
        # the edges by which paths may end, set for each least file
        self.begin, self.count = np.zeros((2, self.n), np.int64), np.zeros((2, self.n), np.int64)
        self.place = np.zeros(self.n, np.int64)
        self.doubtful: dict[int, list[np.ndarray]] = {}

    def edge(self, a, b) -> np.ndarray:
        """1 where there is an edge from a to b."""
        key = a * self.n + b
        if self.table is not None:
            return self.table.take(key, mode="clip")
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key).astype(np.int8)

    def cycles(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Columns of files, a cycle each, all of one length in one array; each set of files once, by its least path."""
        at = 0
        while at < len(starts):
            s, to = starts[at, 0], at
            while to < len(starts) and starts[to, 0] == s:
                to += 1
            steps = np.concatenate([self.targets[x:y] for _, x, y in starts[at:to]])
            yield from self._of(int(s), steps)
            at = to
        for k in list(self.doubtful):
            yield from self._least(k)

    def _of(self, s: int, steps: np.ndarray) -> Iterator[np.ndarray]:
        touched, last = [], []
        frontier = np.array([s])
        for r in range(1, self.length):  # the steps in which s is reached through greater files
            begin = self.back_first[frontier]
            rows, at = _spans(begin, self.back_first[frontier + 1] - begin)
            sources = self.back[at]
            up = sources > s
            sources = sources[up]
            if r in (2, 3):
                last.append((sources, frontier[rows[up]]))
            new = sources[self.dist[sources] == _FAR]
            if not len(new):
                break
            self.dist[new] = r
            self.place[new] = np.arange(len(new))
            frontier = new[self.place[new] == np.arange(len(new))]
            touched.append(frontier)
        if touched:
            steps = steps[self.dist[steps] < self.length]
            self.ends: list[np.ndarray] = []
            for k in range(len(last)):
                sources, targets = (np.concatenate([x[i] for x in last[: k + 1]]) for i in (0, 1))
                order = np.argsort(sources, kind="stable")
                sources = sources[order]
                new = np.ones(len(sources) + 1, bool)
                np.not_equal(sources[1:], sources[:-1], out=new[1:-1])
                begin = np.flatnonzero(new[: len(sources) + 1])
                own = sources[begin[:-1]]
                self.begin[k, own], self.count[k, own] = begin[:-1], begin[1:] - begin[:-1]
                self.ends.append(targets[order])
            path = np.empty((2, len(steps)), np.int64)
            path[0], path[1] = s, steps
            arcs = np.ones(len(steps), np.int8) + self.edge(steps, s)
            yield from self._sure(path, arcs, self.dist[steps] == 1)
            if self.length > 2:
                yield from self._grow(path, arcs)
            for sources, _ in last:
                self.count[:, sources] = 0
        for x in touched:
            self.dist[x] = _FAR

    def _grow(self, path: np.ndarray, arcs: np.ndarray) -> Iterator[np.ndarray]:
        """Cycles that go on from these paths. arcs: how many edges there are among the files of each."""
        left = self.length - len(path)  # steps in which the next file must reach the first
        ends = left <= len(self.ends)
        if ends:
            begin, count, targets = self.begin[left - 1][path[-1]], self.count[left - 1][path[-1]], self.ends[left - 1]
        else:
            begin, targets = self.first[path[-1]], self.targets
            count = self.first[path[-1] + 1] - begin
        block = np.cumsum(count) // BLOCK if count.sum() > BLOCK else np.zeros(len(count), np.int64)
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-2)) if len(block) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            rows, at = _spans(begin[x:y], count[x:y])
            new = targets[at]
            ok = np.ones(len(new), bool) if ends else (self.dist[new] <= left) & (new > path[0, 0])
            rows += x
            for p in path[1:-1]:
                ok &= p[rows] != new
            rows, new = rows[ok], new[ok]
            if not len(new):
                continue
            grown = np.empty((len(path) + 1, len(new)), np.int64)
            np.take(path, rows, axis=1, out=grown[:-1], mode="clip")
            grown[-1] = new
            more = arcs[rows] + 1
            for p in grown[:-2]:
                more += self.edge(p, new)
                more += self.edge(new, p)
            more += self.edge(new, grown[-2])
            yield from self._sure(grown, more, self.dist[new] == 1)
            if len(grown) < self.length:
                yield from self._grow(grown, more)

    def _sure(self, path: np.ndarray, arcs: np.ndarray, closed: np.ndarray) -> Iterator[np.ndarray]:
        """The closed paths that are the only cycle over their files; the others wait for ``_least``.

        Two cycles over the same k files differ in three edges or more, so with less than k + 3 edges there is one only.
        """
        k = len(path)
        alone = arcs < k + 3
        if not closed.all():
            alone, doubt = closed & alone, closed & ~alone
        else:
            doubt = ~alone
        if doubt.any():
            yield path[:, alone]
            wait = self.doubtful.setdefault(k, [])
            wait.append(path[:, doubt])
            if sum(x.shape[1] for x in wait) >= BLOCK:
                yield from self._least(k)
        else:
            yield path[:, alone] if not alone.all() else path

    def _least(self, k: int) -> Iterator[np.ndarray]:
        """Those of the waiting cycles of k files that are the least one over their files.

        All ways through a set are followed at once: ways[m] has the files from which all of m are met, then the first.
        """
        waiting = np.concatenate(self.doubtful.pop(k), axis=1)
        size = max(1, (BLOCK << 4) >> k)
        for x in range(0, waiting.shape[1], size):
            some = waiting[:, x : x + size]
            rest = np.sort(some[1:], axis=0)
            out = np.zeros((k, some.shape[1]), np.uint16)  # targets of the first, then of the others, as bits
            home = np.zeros((k - 1, some.shape[1]), np.uint16)
            for j in range(k - 1):
                out[0] |= self.edge(some[0], rest[j]).astype(np.uint16) << j
                home[j] = self.edge(rest[j], some[0])
                for i in range(k - 1):
                    if i != j:
                        out[i + 1] |= self.edge(rest[i], rest[j]).astype(np.uint16) << j
            ways = np.zeros((1 << (k - 1), some.shape[1]), np.uint16)
            for m in range(1, 1 << (k - 1)):
                for i in range(k - 1):
                    if m >> i & 1:
                        others = m & ~(1 << i)
                        ways[m] |= (((out[i + 1] & ways[others]) != 0).astype(np.uint16) if others else home[i]) << i
            every = np.arange(some.shape[1])
            ok, at, m = np.ones(len(every), bool), np.zeros(len(every), np.int64), np.full(len(every), (1 << (k - 1)) - 1)
            for step in some[1:]:
                place = (rest < step).sum(axis=0)
                can = (out[at, every] & ways[m, every]).astype(np.int64)
                ok &= (can & -can) == 1 << place
                at, m = place + 1, m & ~(1 << place)
            yield some[:, ok]


def graphs(edges: DataFrame, length: int) -> DataFrame:
    """The shares of each repository's graph, spread over the executors."""
    spark = edges.sparkSession

    def dealt(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(deal(table, length))
        lists = [x["files"] for x in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.table({
            "repo": pa.array([key[0].as_py()] * len(rows), pa.string()), "share": pa.array([x["share"] for x in rows], pa.int32()),
            "files": pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.string())),
            **{c: pa.array([x[c] for x in rows], pa.binary()) for c in ("first", "targets", "starts")},
        })

    known = edges.select("repo", "source", "target").dropna()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return known.groupBy("repo").applyInArrow(dealt, _GRAPH).repartition(parts, "repo", "share")


def _walks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[str, pa.Array, Iterator[np.ndarray]]]:
    """Repository, files and cycles of each share."""
    for batch in batches:
        for i in range(batch.num_rows):
            first, targets, starts = (np.frombuffer(batch[c][i].as_buffer(), t) for c, t in (("first", np.int64), ("targets", np.int32), ("starts", np.int64)))
            yield batch["repo"][i].as_py(), batch["files"][i].values, Walker(first, targets, length).cycles(starts.reshape(-1, 3))


def listed(edges: DataFrame, length: int, paths: bool) -> DataFrame:
    """(repo, length, cycle and, with ``paths``, path) of every cycle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for repo, files, found in _walks(batches, length):
            kept: dict[int, list[np.ndarray]] = {}
            for x in found:
                own = kept.setdefault(len(x), [])
                own.append(x)
                if sum(y.shape[1] for y in own) >= BLOCK // 4:
                    yield from texts(repo, files, np.concatenate(kept.pop(len(x)), axis=1))
            for own in kept.values():
                yield from texts(repo, files, np.concatenate(own, axis=1))

    def texts(repo: str, files: pa.Array, cycles: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in range(0, cycles.shape[1], BLOCK // 4):
            some = cycles[:, x : x + BLOCK // 4]
            k, n = some.shape
            out = {"repo": pa.repeat(pa.scalar(repo, pa.string()), n), "length": pa.repeat(pa.scalar(k, pa.int32()), n), "cycle": pc.binary_join_element_wise(*[files.take(pa.array(c)) for c in some], " > ")}
            if paths:
                out["path"] = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, files.take(pa.array(some.T.ravel())))
            yield pa.RecordBatch.from_pydict(out)

    return graphs(edges, length).mapInArrow(rows, "repo string, length int, cycle string" + ", path array<string>" * paths)


def counted(edges: DataFrame, length: int) -> DataFrame:
    """(repo, node, cycles): in how many cycles each file is; cycles are counted where they are found."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for repo, files, found in _walks(batches, length):
            total, held, size = np.zeros(len(files), np.int64), [], 0
            for x in found:
                held.append(x.ravel())
                size += x.size
                if size >= max(8 * BLOCK, len(files)):
                    total += np.bincount(np.concatenate(held), minlength=len(files))
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(files))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"repo": pa.repeat(pa.scalar(repo, pa.string()), len(at)), "node": files.take(pa.array(at)), "cycles": pa.array(total[at], pa.int64())})

    return graphs(edges, length).mapInArrow(rows, "repo string, node string, cycles bigint").groupBy("repo", "node").agg(F.sum("cycles").alias("cycles"))
