"""Rows delivered many times take one place among the nearest."""

import numpy as np

from codelode.llm import neighbours as N


def test_repeats_in_many_batches_push_nobody_out(spark):
    r = np.random.default_rng(4)
    q = r.normal(size=64)
    near = [(i, q + r.normal(size=64) * 0.05 * i) for i in range(1, 8)]
    rows = near[::-1] + [near[j % 2] for j in range(60)]
    data = [("a", i, [float(np.float32(x)) for x in v]) for i, v in rows + [(100, q)]]
    schema = "owner string, id long, embedding array<float>"
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        df = spark.createDataFrame(data, schema).coalesce(1)
        got = N.nearest(df.where("id = 100"), df, k=5).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    x = {i: np.float32(v) / np.linalg.norm(np.float32(v)) for i, v in near}
    want = sorted(x, key=lambda i: -float(x[i] @ (q / np.linalg.norm(q))))[:5]
    assert [g.neighbour for g in got] == want
