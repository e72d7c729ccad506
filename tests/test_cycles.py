"""Cycles of larger graphs: counted and listed where they are found, without paths on disk."""

import os
import random
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from test_graphs import simple_cycles

from codelode.operators import cycles
from codelode.operators import tracing as T
from codelode.plans.registry import core
from codelode.workspace import shared_dir


def stored(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def table(spark, edges):
    return spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, source string, target string")


def test_rank_counts_without_stored_paths(spark, data):
    before = stored(spark)
    assert core()[0]["q_cycle_rank"](spark, data).collect()
    assert stored(spark) == before


def test_rank_of_a_complete_graph(spark):
    edges = [(f"n{a:02d}", f"n{b:02d}") for a in range(12) for b in range(12)]  # 133,364 paths close, over 2,497 sets
    got = T.rank_cycle_files(table(spark, edges + edges[:30])).collect()
    assert {(x.node, x.cycles) for x in got} == {(f"n{a:02d}", sum(comb(11, k) for k in range(1, 6))) for a in range(12)}


@pytest.mark.parametrize("length", [1, 2, 3, 7, 12])
def test_rank(spark, length):
    r = random.Random(length)
    edges = {(f"n{r.randrange(9)}é > {r.randrange(2)}", f"n{r.randrange(9)}é > {r.randrange(2)}") for _ in range(40)}
    want = Counter()
    for own in cycles_of(edges, min(length, 10)):
        want.update(own)
    assert {x.node: x.cycles for x in T.rank_cycle_files(table(spark, edges), length).collect()} == want


def cycles_of(edges, most):
    """The files of each cycle; paths here may hold the text that joins them."""
    names = sorted({x for e in edges for x in e})
    short = {x: f"{i:03d}" for i, x in enumerate(names)}
    found = simple_cycles({(short[a], short[b]) for a, b in edges if a != b}, most) if most > 1 else set()
    return [[names[int(x)] for x in c.split(" > ")] for _, c in found]


def test_list_without_stored_paths(spark, data):
    before = stored(spark)
    assert core()[0]["q_find_cycles"](spark, data).collect()
    assert stored(spark) == before


@pytest.mark.parametrize("length", [1, 2, 3, 7, 12])
def test_list(spark, length):
    r = random.Random(length)
    edges = {(f"n{r.randrange(9)}é > {r.randrange(2)}", f"n{r.randrange(9)}é > {r.randrange(2)}") for _ in range(40)}
    want = sorted(cycles_of(edges, min(length, 10)))
    rows = T.find_cycles(table(spark, edges), length).collect()
    assert sorted(x.path for x in rows) == want
    assert all(x.length == len(x.path) and x.cycle == " > ".join(x.path) for x in rows)


@pytest.mark.parametrize("block, dense", [(3, 0), (40, 1 << 20), (1 << 17, 0)])
def test_blocks_and_shares_change_nothing(monkeypatch, block, dense):
    monkeypatch.setattr(cycles, "BLOCK", block)
    monkeypatch.setattr(cycles, "DENSE", dense)
    monkeypatch.setattr(cycles, "EDGES_A_SHARE", 4)
    r = random.Random(block)
    edges = {(f"n{r.randrange(12):02d}", f"n{r.randrange(12):02d}") for _ in range(60)}
    shares = list(cycles.deal(pa.table({"source": [a for a, _ in edges], "target": [b for _, b in edges]}), 6))
    got = []
    for x in shares:
        names = x["files"].to_pylist()
        walker = cycles.Walker(np.frombuffer(x["first"], np.int64), np.frombuffer(x["targets"], np.int32), 6)
        got += [[names[i] for i in c] for y in walker.cycles(np.frombuffer(x["starts"], np.int64).reshape(-1, 3)) for c in y.T]
    assert len(shares) > 1 and sorted(got) == sorted(cycles_of(edges, 6))
