"""Most similar vectors for every vector (problem 6).

Multi-index hashing over learned binary codes. Rotations fitted on a bounded sample (iterative quantisation) make the
signs of the rotated vector a code of 2 x 64 bits in which the angle between vectors shows as Hamming distance. Codes are
cut into substrings, each an index of its own; by pigeonhole, codes that are close agree, or nearly agree, in some of
them. Two operators use that:

- ``similar_pairs``, for pairs above a similarity: each 64 bits in 8 substrings; codes that differ in up to 6 of the 64 agree in
  two of the 8, so the combinations of two substrings are the keys. Codes within the radius in either 64 bits meet, at every size
  of table and bucket: crowded buckets are compared in blocks, and where near copies crowd, the vectors give each row's k best.
- ``topk``, for the k most similar of given rows at any similarity: 8 substrings of 16 bits from all 128; the buckets
  within ``radius`` bits of the query's substring are probed, candidates within ``reach`` of 128 bits are reranked. Queries
  that found fewer than k go through the exact scan, so every query gets k neighbours where there are k.

Copies of one vector would fill a bucket with a number of pairs that is the square of theirs. Of each group of copies
only the k + 1 rows with the least ids enter the index of ``similar_pairs``: for equal similarity the least ids win, so no
other row of the group can be among the k most similar of any row. ``copies`` gives every row its group.

Usable vectors have the length most of their owner's have, finite numbers and are not all zeros; others take no part.
Norms do not matter. Repeated rows of one id are one vector. Ties in similarity go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.workspace import settled

BITS = 64
SAMPLE = 20_000
_CODES = "owner string, id long, code long, more long, copy long"


def _matrix(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors as float64) of the usable vectors of an Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    ok = np.flatnonzero((np.diff(offsets) == dims) & ~column.is_null().to_numpy(zero_copy_only=False))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values[offsets[ok][:, None] + np.arange(dims)] if len(ok) else np.empty((0, dims))
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return ok[good], x[good] / norm[good, None]


def _plain(vectors: DataFrame) -> DataFrame:
    """The three columns that count, of rows that have an id and a vector."""
    return vectors.where("id is not null and embedding is not null").select("owner", F.col("id").cast("long").alias("id"), "embedding")


def fit(sample: np.ndarray, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """A rotation (dims x BITS) that brings the signs of the rotated sample close to itself: iterative quantisation."""
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    if dims >= BITS:
        _, _, v = np.linalg.svd(sample, full_matrices=False) if len(sample) >= BITS else (0, 0, np.eye(dims))
        base = v[:BITS].T
    else:  # fewer numbers than bits: a tight frame of random directions
        base = np.linalg.qr(rng.normal(size=(BITS, dims)))[0].T * np.sqrt(BITS / dims)
    y = sample @ base
    r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds if len(sample) else 0):
        u, _, vt = np.linalg.svd(y.T @ np.where(y @ r > 0, 1.0, -1.0))
        r = u @ vt
    return base @ r


def usual_lengths(vectors: DataFrame) -> dict[str, int]:
    """Per owner the length most of its vectors have (the smaller on ties); owners are tables, so few."""
    counts = vectors.where("owner is not null and embedding is not null and size(embedding) > 0").groupBy("owner", F.size("embedding").alias("n")).count()
    top = counts.groupBy("owner").agg(F.max(F.struct("count", -F.col("n"))).alias("m")).select("owner", (-F.col("m.col2")).alias("n"))
    return {r["owner"]: r["n"] for r in top.collect()}


def by_length(vectors: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """The vectors by their length, each owner's of its usual length only; as many parts as there are different lengths."""
    usual = usual_lengths(vectors)
    for dims in sorted(set(usual.values())):
        owners = [o for o, n in usual.items() if n == dims]
        yield dims, vectors.where(F.col("owner").isin(owners) & (F.size("embedding") == dims))


def train(vectors: DataFrame, dims: int, sample: int = SAMPLE) -> np.ndarray:
    """Two rotations (dims x 128) fitted on about ``sample`` vectors, whatever the size of the collection."""
    rows = vectors.count()
    share = min(1.0, 1.2 * sample / max(1, rows))
    some = vectors.select("embedding").where(F.size("embedding") == dims)
    some = some.sample(share, seed=11) if share < 1 else some
    _, x = _matrix(some.limit(sample).toArrow().column("embedding"), dims)
    return np.hstack([fit(x), fit(x, seed=23)])


def encode(vectors: DataFrame, rotation: np.ndarray) -> DataFrame:
    """Codes of the usable vectors, a hash by which copies are recognised, see ``_CODES``, and the vectors."""
    dims = rotation.shape[0]
    shared = vectors.sparkSession.sparkContext.broadcast(rotation)
    mixer = np.random.default_rng(5).integers(1, 2**63, dims, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        for b in batches:
            rows, x = _matrix(b.column(2), dims)
            signs = (x @ shared.value > 0).reshape(len(x), 2, BITS)
            code = np.where(signs, power, np.uint64(0)).sum(axis=2, dtype=np.uint64).view(np.int64)
            with np.errstate(over="ignore"):
                copy = (np.round(x * 1e6).astype(np.int64).view(np.uint64) * mixer).sum(axis=1, dtype=np.uint64)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(copy.view(np.int64)), b.column(2).take(take)],
                ["owner", "id", "code", "more", "copy", "embedding"],
            )

    plain = _plain(vectors)
    return plain.mapInArrow(run, f"{_CODES}, embedding {plain.schema['embedding'].dataType.simpleString()}")


M = 8  # substrings of 8 bits


def keys(code: Column, c: int) -> Column:
    """The keys of a code: of each combination of c of its M substrings a hash of their bits and the combination."""
    part = [F.shiftrightunsigned(code, 8 * i).bitwiseAND(F.lit(255)) for i in range(M)]
    out = []
    for number, chosen in enumerate(combinations(range(M), c)):
        key = F.lit(number).cast("long")  # c <= 6 substrings and the number fit 64 bits; beyond, the hash of all does
        for i in chosen if c <= 6 else ():
            key = F.shiftleft(key, 8).bitwiseOR(part[i])
        out.append(key if c <= 6 else F.xxhash64(F.lit(number), *[part[i] for i in chosen]))
    return F.array(*out)


def _distance(a: str, b: str) -> Column:
    """Differing bits of two codes of 128."""
    return F.bit_count(F.col(f"{a}.code").bitwiseXOR(F.col(f"{b}.code"))) + F.bit_count(F.col(f"{a}.more").bitwiseXOR(F.col(f"{b}.more")))


def _runs(batches: Iterator[pa.RecordBatch], by: int, least: int = 1 << 17, most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of grouped batches in tables of whole runs of the first ``by`` columns, and where each run begins, with the end.

    Of a run of more than ``most`` rows at least ``most`` + 1 come, not all.
    """
    kept: list[pa.RecordBatch] = []
    passed = None

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for c in t.columns[:by]:
            x = c.combine_chunks().dictionary_encode()
            x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).indices.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        new[:1] = True
        return np.append(np.flatnonzero(new), len(t))

    for b in batches:
        if passed is not None:
            t = pa.Table.from_batches([passed, b])
            n = begins(t)[1] - 1
            if n == b.num_rows:
                continue
            b, passed = b.slice(n), None
        kept.append(b)
        if sum(x.num_rows for x in kept) >= least:
            t = pa.Table.from_batches(kept).combine_chunks()
            at = begins(t)
            kept = t.slice(at[-2]).to_batches()
            if most is not None and at[-1] - at[-2] > most:
                kept, passed = [], kept[0].slice(0, 1)
                yield t, at
            elif len(at) > 2:
                yield t.slice(0, at[-2]), at[:-1]
    if sum(x.num_rows for x in kept):
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, begins(t)


_NUMBER = np.zeros((M, M), np.int64)  # of the combination (i, j)
for _n, (_i, _j) in enumerate(combinations(range(M), 2)):
    _NUMBER[_i, _j] = _n
PAIRS = M * (M - 1) // 2
SMALL = 64  # rows of a bucket up to which many buckets are paired at once
_PAIR, _DENSE, _LARGE = 0, 1, 2


def _first_shared(code: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The number of the first combination of two substrings in which two codes agree, from their differences."""

    def first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = x.astype("<u8").view(np.uint8).reshape(-1, M) == 0
        enough, i = same.sum(axis=1) > 1, same.argmax(axis=1)
        same[np.arange(len(i)), i] = False
        return enough, _NUMBER[i, same.argmax(axis=1)]

    enough, number = first(code)
    return np.where(enough, number, PAIRS + first(more)[1])


def _meet(k: int, reach: int, bound: int | None = None):
    """Grouped rows of buckets to the pairs within ``reach``, each from the first bucket it meets in; of a bucket with very many pairs its rows (id and side), of one with more rows than ``bound`` its name alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _runs(batches, 3, most=bound):
            key, part, side, ids = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
            code, more = (t.column(i).to_numpy().view(np.uint64) for i in (5, 6))

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return np.bitwise_count(code[a] ^ code[b]) + np.bitwise_count(more[a] ^ more[b]) <= reach

            def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return _first_shared(code[a] ^ code[b], more[a] ^ more[b]) == key[a] >> 16

            size = np.diff(at)
            large = size > (len(t) if bound is None else bound)
            left, right, dense = [], [], []
            end = np.repeat(np.where((size <= SMALL) & ~large, at[1:], 0), size)
            rows = np.arange(len(end))
            for d in range(1, SMALL):
                rows = rows[rows + d < end[rows]]
                if not len(rows):
                    break
                a = rows[near(rows, rows + d)]
                a = a[first(a, a + d) & ((side[a] == 0) | (side[a] != side[a + d]))]
                left.append(a)
                right.append(a + d)
            for n in np.flatnonzero((size > SMALL) & ~large):
                lo, hi = at[n], at[n + 1]
                own, found, most = np.arange(lo, hi), [], 4 * (k + 1) * (hi - lo)
                one = side[lo] == 0
                mine, other = (own, own) if one else (own[side[lo:hi] == 1], own[side[lo:hi] == 2])
                step = max(1, (1 << 17) // max(1, len(other)))
                for n in range(0, len(mine), step):
                    x, y = mine[n : n + step], other[n if one else 0 :]
                    i, j = np.nonzero(near(x[:, None], y[None, :]))
                    a, b = x[i], y[j]
                    if one:
                        a, b = a[a < b], b[a < b]
                    ok = first(a, b)
                    found.append((a[ok], b[ok]))
                    most -= int(ok.sum())
                    if most < 0:
                        dense.append(own)
                        break
                else:
                    left += [a for a, _ in found]
                    right += [b for _, b in found]
            a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
            rows = np.concatenate([*dense, np.empty(0, np.int64)]).astype(np.int64)
            parts = [a, rows, at[:-1][large]]
            what = np.repeat(np.array([_PAIR, _DENSE, _LARGE], np.int32), [len(x) for x in parts])
            take = np.concatenate(parts)
            low, high = np.concatenate([np.minimum(ids[a], ids[b]), ids[take[len(a) :]]]), np.concatenate([np.maximum(ids[a], ids[b]), side[take[len(a) :]]])
            columns = [t.column(0).take(pa.array(take)), *(pa.array(x) for x in (low, high, what, key[take], part[take]))]
            yield from pa.Table.from_arrays(columns, ["owner", "id_a", "id_b", "what", "key", "part"]).to_batches()

    return run


def _closest(k: int):
    """Sorted rows of buckets with their vectors to the k most similar others of each row in its bucket, from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _runs(batches, 3, 1 << 14):
            for lo, hi in zip(at[:-1], at[1:]):
                own = t.slice(lo, hi - lo).combine_chunks()
                side, ids = own.column(3).to_numpy(), own.column(4).to_numpy()
                ok, x = _matrix(own.column(5), len(own.column(5)[0]))
                side, ids = side[ok], ids[ok]
                for mine, other in ((0, 0), (1, 2), (2, 1)):
                    m, o = side == mine, side == other
                    if m.any() and o.any():
                        i, j, s = _best(x[m], ids[m], x[o], ids[o], k)
                        owner = pa.array([own.column(0)[0].as_py()] * len(i), pa.string())
                        yield pa.RecordBatch.from_arrays([owner, pa.array(ids[m][i]), pa.array(ids[o][j]), pa.array(s)], ["owner", "id", "neighbour", "similarity"])

    return run


_BUCKET = ["owner", "key", "part"]


def _grouped(rows: DataFrame, run, schema) -> DataFrame:
    """``run`` over the rows, those of one bucket one after the other."""
    return rows.repartition(*_BUCKET).sortWithinPartitions("key", "part", "owner").mapInArrow(run, schema)


def candidates(codes: DataFrame, k: int, reach: int, bound: int = 32_768) -> DataFrame:
    """(owner, id_a, id_b) with id_a < id_b: the pairs of one owner that meet in a bucket and are within ``reach``.

    A bucket holds the rows whose codes agree in two substrings of the first or of the second 64 bits. All pairs of a bucket are
    compared, those of more than ``bound`` rows in blocks of about ``bound``, each with each. Where more than 4 (k + 1) pairs a row
    are within reach, the vectors decide: out come each row's k most similar of that bucket.
    """
    one = codes.select("owner", "id", "code", "more", "copy").dropDuplicates(["owner", "id"])
    place = F.row_number().over(Window.partitionBy("owner", "copy").orderBy("id"))
    rows = settled(one.withColumn("place", place).where(F.col("place") <= k + 1).select("owner", "id", "code", "more"), "codes")
    both = F.concat(keys(F.col("code"), 2), F.transform(keys(F.col("more"), 2), lambda x: x + F.lit(PAIRS << 16)))
    probes = rows.select("owner", "id", "code", "more", F.explode(both).alias("key"))
    probes = probes.select("owner", "key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "id", "code", "more")
    met = _grouped(probes, _meet(k, reach, bound), "owner string, id_a long, id_b long, what int, key long, part long")
    met = settled(met, "met")
    large = met.where(F.col("what") == _LARGE).select("owner", "key")
    if not large.isEmpty():
        crowd = probes.join(large.hint("merge"), ["owner", "key"], "left_semi")
        blocks = settled(crowd.groupBy("owner", "key").agg(F.ceil(F.count("*") / bound).alias("blocks")), "blocks")
        crowd = crowd.join(blocks.hint("merge"), ["owner", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        crowd = crowd.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        part = F.shiftleft(F.least("block", "with") + 1, 31) + F.greatest("block", "with")
        side = F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2)
        crowd = crowd.select("owner", "key", part.alias("part"), side.alias("side"), "id", "code", "more")
        met = met.unionByName(settled(_grouped(crowd, _meet(k, reach), met.schema), "met"))
    pairs, dense = met.where(F.col("what") == _PAIR).select("owner", "id_a", "id_b"), met.where(F.col("what") == _DENSE)
    if dense.isEmpty():
        return pairs
    held = dense.select(*_BUCKET, F.col("id_b").alias("side"), F.col("id_a").alias("id"))
    vectors = codes.select("owner", "id", "embedding").join(held.select("owner", "id").distinct().hint("merge"), ["owner", "id"], "left_semi")
    held = held.join(vectors.dropDuplicates(["owner", "id"]).hint("merge"), ["owner", "id"]).select(*_BUCKET, "side", "id", "embedding")
    best = _grouped(held, _closest(k), "owner string, id long, neighbour long, similarity double").distinct()
    order = Window.partitionBy("owner", "id").orderBy(F.desc("similarity"), "neighbour")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return pairs.unionByName(best.select("owner", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))).distinct()


def topk(queries: DataFrame, vectors: DataFrame, k: int = 5, radius: int = 3, reach: int = 46) -> DataFrame:
    """(owner, id, neighbour, similarity, place): the k most similar rows of the same owner for each query row, through the index.

    Of a substring of 16 bits the 697 values within ``radius`` = 3 are probed. The result is approximate (see the README
    for the recall measured); queries for which the index brings fewer than k rows are answered by ``nearest``, exactly.
    """
    found, schema = None, "owner string, id long, neighbour long, similarity double, place int"
    masks = F.lit([sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(16), r)])
    vectors, queries = _plain(vectors), _plain(queries)
    for dims, own in by_length(vectors):
        rotation = train(own, dims)
        codes = settled(encode(own, rotation).dropDuplicates(["owner", "id"]).select("owner", "id", "code", "more", "copy"), "codes")
        # a group of copies enters with its k + 1 least ids and is asked for once, by its least id
        place = F.row_number().over(Window.partitionBy("owner", "copy").orderBy("id"))
        base = codes.withColumn("place", place).where(F.col("place") <= k + 1)
        least = codes.groupBy("owner", "copy").agg(F.min("id").alias("rep"))
        members = codes.join(queries.where(F.size("embedding") == dims).select("owner", "id").distinct().hint("merge"), ["owner", "id"], "left_semi").join(least.hint("merge"), ["owner", "copy"])
        members = settled(members.select("owner", "id", "rep", "code", "more"), "asked")
        asked = members.groupBy("owner", F.col("rep").alias("id")).agg(F.min("code").alias("code"), F.min("more").alias("more"))
        part = [F.shiftrightunsigned(F.col(c), 16 * i).bitwiseAND(F.lit(65535)).cast("int") for c in ("code", "more") for i in range(4)]
        cut = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), p.alias("bits")) for n, p in enumerate(part)])).alias("s")
        table = base.select("owner", "id", "code", "more", cut).select("owner", "id", "code", "more", "s.n", F.col("s.bits").alias("key"))
        probes = asked.select("owner", "id", "code", "more", cut).select("owner", "id", "code", "more", "s.n", F.explode(F.transform(masks, lambda x: F.col("s.bits").bitwiseXOR(x))).alias("key"))
        a, b = probes.alias("a"), table.alias("b")
        same = (F.col("a.owner") == F.col("b.owner")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id"))
        pairs = a.join(b.hint("merge"), same & (_distance("a", "b") <= reach)).select(F.col("a.owner").alias("owner"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
        order = Window.partitionBy("owner", "id").orderBy(F.desc("similarity"), "neighbour")
        best = rerank(pairs, own).select("owner", F.col("id_a").alias("id"), F.col("id_b").alias("neighbour"), "similarity")
        best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("owner", F.col("id").alias("rep"), "neighbour", "similarity")
        best = best.unionByName(members.select("owner", "rep", F.col("rep").alias("neighbour"), F.lit(1.0).alias("similarity")).distinct())
        ranked = members.select("owner", "id", "rep").join(best.hint("merge"), ["owner", "rep"]).where("id <> neighbour").drop("rep")
        ranked = settled(ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "ranked")
        full = ranked.where(F.col("place") == k).select("owner", "id")
        short = own.join(members.join(full.hint("merge"), ["owner", "id"], "left_anti").select("owner", "id").hint("merge"), ["owner", "id"], "left_semi")
        both = ranked.join(full.hint("merge"), ["owner", "id"], "left_semi").unionByName(nearest(short, own, k))
        found = both if found is None else found.unionByName(both)
    return vectors.sparkSession.createDataFrame([], schema) if found is None else found


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to usable vectors the unit vector in bytes, with its scale and a bound of its error."""
    for b in batches:
        if b.num_rows:
            at, x = _matrix(b.column(2), len(b.column(2)[0]))
            scale = (np.abs(x).max(axis=1) / 127).astype("<f4")
            q = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
            error = (np.sqrt(((x - q * scale[:, None].astype(float)) ** 2).sum(axis=1)) + 1e-6).astype("<f4")
            blob = np.hstack([q.view(np.uint8), scale[:, None].view(np.uint8), error[:, None].view(np.uint8)])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:3]), pa.array([r.tobytes() for r in blob], pa.binary())], ["owner", "id", "embedding", "small"])


def _likely(least: float):
    """Pairs whose vectors in bytes do not rule out the similarity ``least``."""

    def part(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blob = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        scale, error = (np.ascontiguousarray(blob[:, i:j]).view("<f4")[:, 0].astype(float) for i, j in ((-8, -4), (-4, blob.shape[1])))
        return blob[:, :-8].view(np.int8).astype(np.float32), scale, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (x, p, e), (y, q, f) = part(b.column(3)), part(b.column(4))
                ok = (x * y).sum(axis=1) * p * q + e + f + e * f + 1e-5 >= least
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:3]], ["owner", "id_a", "id_b"])

    return run


def rerank(pairs: DataFrame, vectors: DataFrame, least: float | None = None) -> DataFrame:
    """(owner, id_a, id_b, similarity): cosine from the floats, in double precision.

    With ``least``, pairs that are surely below it are left out before floats are joined: their vectors in bytes say so.
    """
    pairs = settled(pairs, "pairs")
    need = pairs.select("owner", F.col("id_a").alias("id")).unionByName(pairs.select("owner", F.col("id_b").alias("id"))).distinct()
    floats = vectors.select("owner", "id", "embedding").join(need.hint("merge"), ["owner", "id"], "left_semi").dropDuplicates(["owner", "id"])
    floats = settled(floats.mapInArrow(_small, f"owner string, id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, small binary"), "floats")
    if least is not None:
        x, y = (floats.select("owner", F.col("id").alias(i), F.col("small").alias(n)).hint("merge") for i, n in (("id_a", "x"), ("id_b", "y")))
        both = pairs.join(x, ["owner", "id_a"]).join(y, ["owner", "id_b"]).select("owner", "id_a", "id_b", "x", "y")
        pairs = settled(both.mapInArrow(_likely(least), pairs.schema), "likely")
    left = floats.select("owner", F.col("id").alias("id_a"), F.col("embedding").alias("x"))
    right = floats.select("owner", F.col("id").alias("id_b"), F.col("embedding").alias("y"))
    both = pairs.join(left.hint("merge"), ["owner", "id_a"]).join(right.hint("merge"), ["owner", "id_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                dims = len(b.column(3)[0])
                x, y = (b.column(i).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, dims) for i in (3, 4))
                s = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s)], ["owner", "id_a", "id_b", "similarity"])

    return both.select("owner", "id_a", "id_b", "x", "y").mapInArrow(run, "owner string, id_a long, id_b long, similarity double")


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.95, reach: int = 23) -> DataFrame:
    """(owner, id_a, id_b, similarity, mutual): pairs of one owner with at least the similarity ``least`` of which one
    is among the other's k most similar; ``mutual`` if each is. ``vectors`` has owner, id and embedding.

    Radius 6 in either 64 bits is guaranteed, larger distances are found with falling certainty; ``reach`` counts over 128 bits,
    where vectors with a cosine of 0.95 differ in 13 on average.
    """
    vectors, found = _plain(vectors), None
    for dims, own in by_length(vectors):
        one = rerank(candidates(encode(own, train(own, dims)), k, reach), own, least)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "owner string, id_a long, id_b long, similarity double, mutual boolean")
    found = found.where(F.col("similarity") >= least)
    sides = found.select("owner", F.explode(F.array(F.struct(F.col("id_a").alias("me"), F.col("id_b").alias("you")), F.struct(F.col("id_b").alias("me"), F.col("id_a").alias("you")))).alias("p"), "similarity")
    order = Window.partitionBy("owner", "p.me").orderBy(F.desc("similarity"), F.col("p.you"))
    top = sides.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    pair = top.groupBy("owner", F.least("p.me", "p.you").alias("id_a"), F.greatest("p.me", "p.you").alias("id_b"))
    return pair.agg(F.max("similarity").alias("similarity"), (F.count("*") == 2).alias("mutual"))


def copies(vectors: DataFrame) -> DataFrame:
    """(owner, id, same_as, size): the group of each usable vector among its copies, named by the least id, and its size."""
    found = vectors.sparkSession.createDataFrame([], "owner string, id long, copy long")
    for dims, own in by_length(_plain(vectors)):
        found = found.unionByName(encode(own, np.eye(dims, 2 * BITS)).select("owner", "id", "copy"))
    codes = settled(found.dropDuplicates(["owner", "id"]), "copies")
    named = codes.groupBy("owner", "copy").agg(F.min("id").alias("same_as"), F.count("*").alias("size"))
    return codes.join(named.hint("merge"), ["owner", "copy"]).select("owner", "id", "same_as", "size")


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their row; the rows are in order."""
    return np.arange(len(row)) - np.searchsorted(row, row) < k


def _best(q: np.ndarray, qid: np.ndarray, y: np.ndarray, yid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of y, similarity): the k most similar rows of y with another id for each row of q, the smaller id on ties.

    The last bits of a matrix product depend on the place in the matrix. What comes near the k-th is computed again pair
    by pair, so that copies tie.
    """
    found, step = [], max(1, (1 << 18) // len(y))
    for n in range(0, len(q), step):
        s = q[n : n + step] @ y.T
        s[qid[n : n + step, None] == yid[None, :]] = -2
        least = np.partition(s, -k, axis=1)[:, -k] - 1e-12 if len(y) > k else np.full(len(s), -1.5)
        i, j = np.nonzero(s >= np.maximum(least, -1.5)[:, None])
        s = (q[n + i] * y[j]).sum(axis=1)
        order = np.lexsort((yid[j], -s, i))
        order = order[_first(i[order], k)]
        found.append((n + i[order], j[order], s[order]))
    i, j, s = (np.concatenate(x) for x in zip(*found))
    return i, j, s


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 4_000) -> DataFrame:
    """(owner, id, neighbour, similarity, place): the k most similar rows of the same owner for each query row.

    The stated queries go against all rows in blocks of ``block`` broadcast vectors, one block at a time; each task keeps the
    k best of its rows per query, and a second step the k best of those. Exact, and the yardstick for ``similar_pairs``.
    """
    found, rows, queries = None, _plain(vectors), _plain(queries)
    for dims, own in by_length(rows):
        one = _scan(queries.where(F.size("embedding") == dims), own, dims, block, k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], "owner string, id long, neighbour long, similarity double, place int")
    found = found.dropDuplicates(["owner", "id", "neighbour"])
    order = Window.partitionBy("owner", "id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _scan(queries: DataFrame, rows: DataFrame, dims: int, block: int, k: int) -> DataFrame:
    """The k best of each task for every query; the driver holds one block of queries, whatever their number."""
    schema, found = "owner string, id long, neighbour long, similarity double", []
    asked = settled(queries.dropDuplicates(["owner", "id"]).select("owner", "id", "embedding"), "queries")
    blocks = -(-asked.count() // block)
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow()
        at, x = _matrix(part.column(2), dims)
        owners, ids = np.array(part.column(0).to_pylist(), object)[at], part.column(1).to_numpy()[at]
        by = {owner: (ids[owners == owner], x[owners == owner]) for owner in set(owners)}
        shared = rows.sparkSession.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[str, tuple] = {}
            for b in batches:
                at, x = _matrix(b.column(2), dims)
                owners, ids = np.array(b.column(0).to_pylist(), object)[at], b.column(1).to_numpy()[at]
                for owner in set(owners) & set(shared.value):
                    mine = owners == owner
                    qid, q = shared.value[owner]
                    n = np.unique(ids[mine], return_index=True)[1]
                    y, yid = x[mine][n], ids[mine][n]
                    i, j, s = _best(q, qid, y, yid, k)
                    who = yid[j]
                    if owner in best:
                        i, who, s = (np.concatenate(z) for z in zip(best[owner], (i, who, s)))
                        order = np.lexsort((-s, who, i))  # an id counts once
                        order = order[np.append(True, (np.diff(i[order]) != 0) | (np.diff(who[order]) != 0))] if len(order) else order
                        order = order[np.lexsort((who[order], -s[order], i[order]))]
                        order = order[_first(i[order], k)]
                        i, who, s = i[order], who[order], s[order]
                    best[owner] = (i, who, s)
            for owner, (i, who, s) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([owner] * len(i), pa.string()), pa.array(shared.value[owner][0][i]), pa.array(who), pa.array(s)], ["owner", "id", "neighbour", "similarity"])

        found.append(settled(rows.mapInArrow(run, schema), "nearest"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)
