"""What the search for similar vectors sends through the driver does not grow with the tables."""

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.core.context import SparkContext

from codelode.llm import neighbours as N

SCHEMA = "owner string, id long, embedding array<float>"


def rows(n):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 64))
    x[n // 2 :] = x[: n - n // 2] + r.normal(size=(n - n // 2, 64)) * 0.05
    return [("a", i, [float(a) for a in v]) for i, v in enumerate(x)]


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    df, seen, real = spark.createDataFrame(rows(200), SCHEMA), [], N.settled
    monkeypatch.setattr(N, "settled", lambda df, name="stage": (seen.append(df), real(df, name))[1])
    seen += [N.similar_pairs(df), N.topk(df.where("id % 10 = 0"), df), N.copies(df)]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_one_block_of_queries_is_held_at_a_time(spark, monkeypatch):
    df, held, most = spark.createDataFrame(rows(120), SCHEMA), [], []
    broadcast, destroy = SparkContext.broadcast, Broadcast.destroy

    def begin(self, value):
        b = broadcast(self, value)
        held.append(b)
        most.append(sum(len(x.value["a"][0]) for x in held))
        return b

    def end(self, *a, **kw):
        held.remove(self)
        destroy(self, *a, **kw)

    monkeypatch.setattr(SparkContext, "broadcast", begin)
    monkeypatch.setattr(Broadcast, "destroy", end)
    got = N.nearest(df, df, k=5, block=20).collect()
    assert len(got) == 600 and len(most) >= 6 and max(most) < 60 and not held
