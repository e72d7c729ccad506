"""Similar vectors against brute force."""

from itertools import combinations

import numpy as np
import pytest

from codelode.llm import neighbours as N

SCHEMA = "owner string, id long, embedding array<float>, code int"


def collection(seed, n=400, dims=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims))
    x = r.normal(size=(n, dims)) * 0.8 + centres[r.integers(0, 5, n)]
    rows, i = [], 0
    for v in x:
        rows.append((i, v))
        i += 1
    for v in x[:40]:
        for _ in range(r.integers(1, 5)):
            rows.append((i, (v + r.normal(size=dims) * 0.08) * r.uniform(0.5, 3)))
            i += 1
    return [(i, [float(np.float32(a)) for a in v]) for i, v in rows]


def brute(rows, k, least):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = [np.lexsort((ids, -s[a]))[:k] for a in range(len(ids))]
    return {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in top[a] if ids[a] < ids[b] and s[a, b] >= least and a in top[b]}, {int(ids[a]): [int(ids[b]) for b in top[a]] for a in range(len(ids))}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs(spark, seed):
    rows = collection(seed)
    awkward = [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [1.0] * 32), (9005, [float("inf")] * 64)]
    both = [("a", i, v, 0) for i, v in rows + awkward + rows[:5]] + [("b", i, v, 0) for i, v in rows[:60]] + [("a", None, rows[0][1], 0)]
    got = N.similar_pairs(spark.createDataFrame(both, SCHEMA)).where("mutual").collect()
    for owner, own in (("a", rows), ("b", rows[:60])):
        want, _ = brute(own, 5, 0.95)
        assert {(r.id_a, r.id_b) for r in got if r.owner == owner} == want


def test_a_third_of_all_rows_are_copies(spark):
    rows = collection(3, 200)
    same = rows[0][1]
    rows += [(5000 + i, [2 * a for a in same]) for i in range(150)]
    df = spark.createDataFrame([("a", i, v, 0) for i, v in rows], SCHEMA)
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df).where("mutual").collect()}
    want, _ = brute(rows, 5, 0.95)
    group = {0, *range(5000, 5150)}
    assert {p for p in got if not set(p) & group} == {p for p in want if not set(p) & group}
    six = sorted(group)[:6]
    assert {p for p in got if set(p) <= group} == {(a, b) for a in six for b in six if a < b}
    classes = {r.id: r.same_as for r in N.copies(df).collect()}
    assert all(classes[i] == 0 for i in group) and len(classes) == len(rows)


def test_nearest_is_exact(spark):
    rows = collection(4, 150)
    df = spark.createDataFrame([("a", i, v, 0) for i, v in rows] + [("a", 1, rows[1][1], 0), ("a", 8000, None, 0)], SCHEMA)
    got = {}
    for r in N.nearest(df.where("id % 10 = 0"), df, k=5, block=7).collect():
        got.setdefault(r.id, {})[r.place] = r.neighbour
    _, want = brute(rows, 5, 0)
    assert {i: [p[k] for k in range(1, 6)] for i, p in got.items()} == {i: v for i, v in want.items() if i % 10 == 0}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.similar_pairs(none).count() == 0
    useless = spark.createDataFrame([("a", 1, [0.0, 0.0], 0), ("a", 2, [0.0, 0.0], 0)], SCHEMA)
    assert N.similar_pairs(useless).count() == 0


def test_keys_agree_within_the_radius(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        a = int(r.integers(-(2**63), 2**63 - 1))
        b = np.int64(a)
        for bit in r.choice(64, 6, replace=False):
            b ^= np.int64(np.uint64(1) << np.uint64(bit))
        rows.append((a, int(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert all(x.n >= 1 for x in df.select(F.size(F.array_intersect(N.keys(F.col("a"), 2), N.keys(F.col("b"), 2))).alias("n")).collect())
    for c in range(2, 9):
        assert all(x.n == len(list(combinations(range(8), c))) for x in df.select(F.size(F.array_distinct(N.keys(F.col("a"), c))).alias("n")).collect())


def test_crowded_buckets_are_split_and_every_near_copy_keeps_neighbours(spark):
    r = np.random.default_rng(8)
    centre = r.normal(size=64)
    rows = [("a", i, [float(a) for a in centre + r.normal(size=64) * 1e-3], 0) for i in range(2000)] + [("a", 5000 + i, [float(a) for a in r.normal(size=64)], 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    codes = N.encode(df.select("owner", "id", "embedding"), N.train(df, 64))
    pairs = N.candidates(codes, 5, 23, bound=128).collect()
    assert len(pairs) < 2000 * 128  # all pairs would be 1,999,000
    assert set(range(2000)) <= {i for p in pairs for i in (p.id_a, p.id_b)}


def test_topk_is_close_to_the_exact_scan(spark):
    rows = collection(6, 1500)
    same = rows[0][1]
    rows += [(9000 + i, [2 * a for a in same]) for i in range(400)]
    short = [("c", i, v[:32], 0) for i, v in rows[:80]]  # an owner with vectors of another length
    df = spark.createDataFrame([("a", i, v, 0) for i, v in rows] + short + [("a", 20000, None, 0), ("a", 20010, [0.0] * 64, 0), ("a", 20020, [1.0], 0), ("a", 0, same, 0)], SCHEMA)
    queries = df.where("id % 10 = 0")
    got, exact = ({(x.owner, x.id, x.place): (x.neighbour, x.similarity) for x in f(queries, df).collect()} for f in (N.topk, N.nearest))
    assert set(got) == set(exact) and {o for o, _, _ in got} == {"a", "c"}
    found = {(o, i, n) for (o, i, _), (n, _) in got.items()}
    assert len(found) == len(got) and len(found & {(o, i, n) for (o, i, _), (n, _) in exact.items()}) >= 0.9 * len(exact)
    for i in (0, 9000, 9390):  # a third are copies of row 0: the least ids come first
        assert [got["a", i, p][0] for p in range(1, 6)] == [exact["a", i, p][0] for p in range(1, 6)]
    assert N.topk(df.limit(0), df).count() == 0 and N.topk(df.limit(0), df.limit(0)).count() == 0
