"""What the search for shared stretches puts on disk."""

import random
from pathlib import Path

import pytest

from codelode.llm import spans as S
from codelode.workspace import shared_dir


@pytest.fixture
def no_broadcast(spark):
    """Joins as on large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_shuffles_and_tables_stay_below_four_times_the_input(spark, no_broadcast, tmp_path):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(5, 16))) for _ in range(100)]  # texts that compress like those of the tables
    passages = [" ".join(r.choices(words, k=50)) for _ in range(100)]
    docs = [(i, " ".join(r.choices(words, k=70)) + passages[i % 100] * (i % 13 == 0) + " ".join(r.choices(words, k=70))) for i in range(5000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(path := str(tmp_path / "documents"))
    shared = shared_dir(spark).removeprefix("file://")
    before, tables = shuffled(spark), size(shared)
    got = {x.doc_id for x in S.shared_chars(spark.read.parquet(path)).collect()}
    assert got == set(range(0, 5000, 13))
    assert shuffled(spark) - before + size(shared) - tables < 4 * size(path)
