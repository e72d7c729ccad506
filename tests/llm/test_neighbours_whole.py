"""No crowd of rows costs a similar pair."""

import numpy as np
from pyspark.sql import functions as F

from codelode.llm import neighbours as N

SCHEMA = "owner string, id long, embedding array<float>"
CODES = "owner string, id long, code long, more long, copy long, along double, embedding array<float>"


def number(bytes_):
    return int(np.frombuffer(np.array(bytes_, np.uint8).tobytes(), "<i8")[0])


def pairs_of_codes(spark, codes, **kw):
    rows = [("a", i, number(c), number(m), i, float(i), [1.0, float(i)]) for i, (c, m) in enumerate(codes)]
    return {(p.id_a, p.id_b) for p in N.candidates(spark.createDataFrame(rows, CODES), 5, 23, **kw).collect()}


def test_a_crowded_bucket_keeps_pairs_that_meet_nowhere_else(spark):
    r = np.random.default_rng(2)
    codes = [([1, 2, *r.integers(0, 256, 6)], r.integers(0, 256, 8)) for _ in range(300)]
    c, m = codes[0]
    codes.append((np.array([*c[:2], *(x ^ 1 for x in c[2:])]), m ^ 1))  # 6 and 8 bits differ: two substrings agree
    assert (0, 300) in pairs_of_codes(spark, codes, bound=128)


def test_codes_near_in_the_second_half_alone_meet(spark):
    r = np.random.default_rng(3)
    codes = [(r.integers(0, 256, 8), r.integers(0, 256, 8)) for _ in range(50)]
    c, m = codes[7]
    codes.append((c ^ 1, np.array([*m[:2], *(x ^ 2 for x in m[2:])])))
    assert pairs_of_codes(spark, codes) == {(7, 50)}


def near_copies(n):
    r = np.random.default_rng(8)
    centre = r.normal(size=64)
    x = np.vstack([centre + r.normal(size=(n, 64)) * 1e-3, r.normal(size=(100, 64))]).astype(np.float32)
    return x.astype(float)


def test_each_of_many_near_copies_gets_its_most_similar(spark):
    x = near_copies(700)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = [set(np.argsort(-row)[:5].tolist()) for row in s]
    want = {(a, b) for a in range(len(x)) for b in top[a] if a < b and s[a, b] >= 0.95 and a in top[b]}
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    assert {(p.id_a, p.id_b) for p in N.similar_pairs(df).where("mutual").collect()} == want
    blocks = N.candidates(N.encode(df, N.train(df, 64)), 5, 23, bound=128).collect()
    assert want <= {(p.id_a, p.id_b) for p in blocks} and len(blocks) < 700 * 100


def test_vectors_in_bytes_rule_out_no_pair_above_the_limit(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 64))
    y = x + r.normal(size=(400, 64)) * r.uniform(0.2, 0.5, (400, 1))
    df = spark.createDataFrame([("a", i, [float(a) for a in v]) for i, v in enumerate(np.vstack([x, y]))], SCHEMA)
    pairs = spark.createDataFrame([("a", i, 400 + i) for i in range(400)], "owner string, id_a long, id_b long")
    full, less = N.rerank(pairs, df).where(F.col("similarity") >= 0.95).collect(), N.rerank(pairs, df, 0.95).collect()
    assert 50 < len(full) < 350 and {tuple(p) for p in full} <= {tuple(p) for p in less} and len(less) < 400
