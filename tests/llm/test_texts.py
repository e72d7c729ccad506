"""Splitting, leaks, shared spans and packing against brute force, with the awkward cases."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import leaks as L
from codelode.llm import packing as P
from codelode.llm import spans as S
from codelode.llm import splitting as C

CODE = "def f(a):\n    x = 1; y = 2\n    return x\n\nclass B:\n    pass\r\n\n"


def pieces_are_sound(text, limits):
    out = C.split_text(text, limits)
    if not text:
        assert out == []
        return
    assert out[0][0] == 0 and out[-1][2] == len(text)
    for i, (s, cut, e) in enumerate(out):
        assert s <= cut < e and len(text[s:e]) <= limits.chars and len(text[s:e].split()) <= limits.words
        if i:
            assert cut == out[i - 1][2] and out[i - 1][0] < s <= cut and cut - s <= limits.overlap_chars
            if limits.overlap_chars and limits.overlap_lines:
                assert s < cut


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab {};\n\r\té漢", max_size=400), st.integers(4, 30), st.integers(8, 80), st.integers(0, 4))
def test_pieces(text, words, chars, lines):
    pieces_are_sound(text, C.Limits(words, chars, lines, chars // 4))


def test_cuts_prefer_strong_boundaries():
    text = ("    x = call(1)\n" * 6 + "\ndef g():\n") * 6
    out = C.split_text(text, C.Limits(512, 160, 0, 0))
    assert all(text[cut:].startswith("def g") or text[cut - 1] == "\n" for _, cut, _ in out[1:]) and any(text[cut:].startswith("def g") for _, cut, _ in out[1:])
    with pytest.raises(ValueError):
        C.Limits(overlap_chars=3000)


def test_split_rows(spark):
    long = CODE * 40
    rows = [(1, long, 11, "z"), (1, long, 11, "z"), (2, None, 1, "z"), (3, "", 1, "z"), (4, "short", 1, "z"), (5, "w" * 5000, None, "z"), (None, long, 1, "z")]
    df = spark.createDataFrame(rows, "id long, content string, start_line int, words string")
    got = C.split_oversized(df, C.Limits(50, 300, 2, 60)).collect()
    assert {r.id for r in got} == {1, 5, None}
    one = sorted({(r.piece_index, r.content, r.start_line, r.end_line, r.overlap_chars) for r in got if r.id == 1})
    lines = long.split("\n")
    assert "".join(c[o:] for _, c, _, _, o in one) == long and one[0][2] == 11
    for _, c, s, e, _ in one:
        assert c.rstrip("\n").split("\n")[0] in lines[s - 11] and e - s + 1 == len(c[: -1 if c.endswith("\n") else None].split("\n"))
    assert all(r.start_line is None for r in got if r.id == 5)
    assert C.split_oversized(df.limit(0)).count() == 0


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=70), st.lists(st.sampled_from("abc"), max_size=90))
def test_myers(p, t):
    assert L.myers(p, t)[0] == distance(p, t)


def test_leaks(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([5, 12, 13, 25, 40])))) for i in range(25)]
    docs = []
    for d in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randrange(60))).upper()
        own = items[r.randrange(25)][1].split()
        k = r.randrange(max(1, len(own) - 8))
        docs.append((d, text[:50] + " , " + " -\n".join(own[k : k + r.choice([11, 12, 14])]) + "; " + text[50:], "x"))
    docs += [(90, None, "x"), (91, "", "x"), (92, " \n", "x"), (None, items[0][1], "x"), docs[0]]
    items += [(70, None), (71, ""), items[3]]
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string, run string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=900).collect()
    want = set()
    norm = lambda t: L.normal(t or "").split()
    for d, t, _ in docs:
        grams = {tuple(norm(t)[i : i + 12]) for i in range(len(norm(t)) - 11)}
        for i, x in items:
            if d is not None and any(tuple(norm(x)[k : k + 12]) in grams for k in range(len(norm(x)) - 11)):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in got if r.passage_edits == 0} == want and want
    assert {(r.doc_id, r.item_id) for r in got if r.run >= 12} == want
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    text = {d: t for d, t, _ in docs}
    for d in text:
        for i, x in items:  # the whole within one edit in six words, by brute force
            n = len(norm(x))
            if d is not None and n >= 12:
                far = distance(norm(x), norm(text[d]))
                assert {r.distance for r in got if (r.doc_id, r.item_id) == (d, i)} - {None} == ({far} if far <= n // 6 else set()), (d, i)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.leaks(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert L.leaks(spark.createDataFrame(docs, "doc_id long, text string, run string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_spread_edits_are_found_and_repetition_stays_linear(spark):
    import time

    words = [f"w{i}" for i in range(30)]
    spread = [f"x{i}" if i % 6 == 3 else w for i, w in enumerate(words)]  # five edits, none of them beside another
    m = L.Matcher([(1, " ".join(words))])
    assert list(m.find("lead in " + " ".join(spread) + " and out")) == [(1, None, 5, 5, 6)]
    assert list(m.find(" ".join(words[:11] + ["y"] + words[12:18]))) == [(1, 1, None, 11, 0)]
    assert list(m.find(" ".join(words[:6] + ["y"] * 20 + words[24:]))) == []  # pieces alone are rejected by the distance
    assert list(m.find(" ".join(words[4:16]))) == [(1, 0, None, 12, 0)]
    r = L.Matcher([(1, "a b " * 20), (2, "a " * 40)])
    spent = []
    for n in (3_000, 12_000):
        began = time.perf_counter()
        assert {h[0] for h in r.find("a b " * n)} == {1} and {h[0] for h in r.find("a " * n)} == {2}
        spent.append(time.perf_counter() - began)
    assert spent[1] < 10 * spent[0] + 0.2


def shared(docs, least):
    from collections import defaultdict

    who = defaultdict(set)
    for d, t in docs:
        for i in range(len(t) - least + 1):
            who[t[i : i + least]].add(d)
    out = {}
    for d, t in docs:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if len(who[t[i : i + least]]) > 1:
                cover[i : i + least] = True
        if cover.any():
            out[d] = int(cover.sum())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans(spark, seed):
    r = random.Random(seed)
    alphabet = "abé漢 \n" if seed < 3 else "ab"
    block = ["".join(r.choice(alphabet) for _ in range(r.randrange(20, 90))) for _ in range(6)]
    docs = []
    for d in range(40):
        docs.append((d, "".join(r.choice(block)[r.randrange(8) :][: r.randrange(15, 90)] + "".join(r.choice(alphabet) for _ in range(r.randrange(12))) for _ in range(r.randrange(5)))))
    docs += [(100 + i, "same text " * 12) for i in range(15)] + [(200, "aaaa" * 30), (201, ""), (202, "short")]
    rows = [(d, t, 0) for d, t in docs] + [(300, None, 0), (None, docs[0][1], 0), (100, "same text " * 12, 0), (301, "aaaa" * 29, 0)]
    got = S.shared_chars(spark.createDataFrame(rows, "doc_id long, text string, anchor int"), least=24).collect()
    assert {x.doc_id: x.shared_chars for x in got} == shared(docs + [(301, "aaaa" * 29)], 24)


def test_stretches_are_merged(spark):
    docs = [(1, "x" * 5 + "abcdefghij" * 3 + "y"), (2, "abcdefghij" * 3)]
    got = {(r.doc_id, r.start, r.end) for r in S.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()}
    assert got == {(1, 5, 35), (2, 0, 30)}
    assert S.shared_chars(spark.createDataFrame([], "doc_id long, text string"), 12).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=60), st.text("abc", max_size=60))
def test_suffix_automaton(text, other):
    got = list(S.SuffixAutomaton(text).statistics(other))
    for end in range(1, len(other) + 1):
        best = max(n for n in range(end + 1) if other[end - n : end] in text)
        assert got[end - 1] == best


def test_spans_in_a_reference(spark):
    docs = spark.createDataFrame([(1, "zz" + "abcdefghijkl" + "zz"), (2, "abcdefg"), (3, None)], "doc_id long, text string")
    ref = spark.createDataFrame([("qqabcdefghijklq",), ("other text here",), (None,)], "text string")
    for chars in (5, 1000):
        assert [tuple(r) for r in S.spans_in_reference(docs, ref, 8, chars).collect()] == [(1, 2, 14)]


def test_packing(spark):
    r = random.Random(4)
    docs = [(i, " ".join("word" for _ in range(r.choice([0, 1, 3, 30, 90, 400])))) for i in range(300)]
    rows = [(d, t, 5) for d, t in docs] + [(900, None, 5), (None, "lost", 5), (0, docs[0][1], 5)]
    cap = P.Capacity(tokens=128, documents=9)
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, tokens int"), cap, group_tokens=4000).collect()
    enc = P.encoder()
    size = {d: len(enc.encode_ordinary(t or "")) for d, t, _ in rows if d is not None}
    per = {}
    for x in got:
        per.setdefault(x.doc_id, []).append(x)
    assert set(per) == set(size)
    for d, xs in per.items():
        assert sum(x.tokens for x in xs) == size[d] and sorted(x.piece for x in xs) == list(range(len(xs)))
        assert len(xs) == max(1, -(-size[d] // 128)) and all((x.container is None) == (size[d] == 0) for x in xs)
    boxes = {}
    for x in got:
        if x.container is not None:
            boxes.setdefault(x.container, []).append(x.tokens)
    assert all(sum(b) <= 128 and len(b) <= 9 for b in boxes.values())
    assert len(boxes) <= 1.25 * sum(size.values()) / 128 + 12
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_respects_every_capacity(rule):
    r = np.random.default_rng(1)
    sizes = r.integers(1, 60, 400)
    cap = P.Capacity(tokens=100, documents=6, cost=4000, rule=rule)
    at, n = P.pack(sizes, cap)
    for b in range(n):
        own = sizes[at == b]
        assert 0 < own.sum() <= 100 and len(own) <= 6 and (own**2).sum() <= 4000
    assert n <= 1.3 * max(sizes.sum() / 100, (sizes**2).sum() / 4000) + 2
    assert P.pack(np.array([], int), cap)[1] == 0


def test_whole_tables(spark, data):
    from codelode.llm.queries import ORACLE, QUERIES
    from codelode.sources.tables import TABLES
    from verify import rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, data)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall()), name
    docs = con.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
    assert {r.doc_id: r.shared_chars for r in QUERIES["p10_found"](spark, data).collect()} == shared(docs, 300)
