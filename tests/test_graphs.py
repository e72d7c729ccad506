"""Cycles against brute force, communities by their invariants."""

import random

import pytest

from codelode.functions.columns import keyword_terms
from codelode.operators import synthesis as S
from codelode.operators import tracing as T


def simple_cycles(edges, most):
    out = {}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)

    def go(path):
        for n in adj.get(path[-1], ()):
            if n == path[0] and len(path) > 1:
                k = tuple(sorted(path))
                out[k] = min(out.get(k, path), path)
            elif n > path[0] and n not in path and len(path) < most:
                go([*path, n])

    for a in sorted(adj):
        go([a])
    return {(len(p), " > ".join(p)) for p in out.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    r = random.Random(seed)
    edges = {(a, b) for a, b in ((f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(28)) if a != b}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, source string, target string")
    got = T.find_cycles(df, 5)
    assert {(x.length, x.cycle) for x in got.collect()} == simple_cycles(edges, 5)


def graph(seed, groups=4, size=12):
    r = random.Random(seed)
    adj = {}
    for g in range(groups):
        for i in range(size):
            for j in range(i):
                if r.random() < 0.5:
                    a, b = f"{g}-{i}", f"{g}-{j}"
                    adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = 1.0 + r.random()
    for _ in range(6):
        a, b = f"{r.randrange(groups)}-{r.randrange(size)}", f"{r.randrange(groups)}-{r.randrange(size)}"
        if a != b:
            adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = 0.3
    return adj


def test_louvain_finds_planted_groups_and_repeats():
    adj = graph(5)
    found = S.louvain(adj, 1.0)
    assert found == S.louvain(dict(reversed(adj.items())), 1.0)
    assert sorted(u for c in found for u in c) == sorted(adj)
    assert S.modularity(adj, found) >= S.modularity(adj, [{u} for u in adj])
    assert {frozenset(c) for c in found} == {frozenset(u for u in adj if u[0] == g) for g in "0123"}
    small = S.split_oversized(adj, found, 5, 1.0)
    assert sorted(u for c in small for u in c) == sorted(adj)


def test_contraction_keeps_every_node(spark):
    adj = graph(7)
    edges = spark.createDataFrame([("r", a, b, w) for a in adj for b, w in adj[a].items() if a < b], "repo string, a string, b string, weight double")
    got = S.communities(edges, 1.0, most_edges=30, split=False)
    assert sorted(r.node for r in got.collect()) == sorted(adj)
    whole = S.communities(edges, 1.0, split=False).collect()
    assert len({r.community for r in whole}) == 4


def test_keyword_terms():
    assert keyword_terms("How to configure the Code for retry_policy and retry_policy of HTTP clients with a timeout, queue, pool, cache, disk") == ["configure", "retry_policy", "http", "clients", "timeout", "queue"]
    assert keyword_terms("a of to") == []
