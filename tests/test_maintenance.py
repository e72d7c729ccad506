"""Maintenance, snapshots, streaming, walks and enrichment."""

import json
import random
import subprocess
from datetime import datetime

import pytest

from codelode.operators import enrichment as E
from codelode.operators import maintenance as M
from codelode.sources import repository as R
from codelode.streaming.watch import Watcher, tool_call_counts


def test_numbered_matches_one_window(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), i) for i in range(50)]
    got = sorted((x.g, x.v, x.n) for x in M.numbered(spark.createDataFrame(rows, "g string, v int"), ["g", "v"]).collect())
    assert [(g, v) for g, v, _ in got] == sorted(rows) and [n for *_, n in got] == list(range(1, 51))


def test_delete_needs_confirmation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, repo string")
    with pytest.raises(ValueError):
        M.delete_repository(df, "b")
    kept, n = M.delete_repository(df, "b", confirm=True)
    assert n == 2 and [r.id for r in kept.collect()] == [1]


def test_prefix_deletion_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a_b/x", "r"), ("axb/x", "r"), ("a_b", "r"), ("a_bc/x", "r")], "path string, repo string")
    assert sorted(r.path for r in M.delete_prefix(df, "a_b", "r").collect()) == ["a_bc/x", "axb/x"]


def test_snapshots_switch_all_tables_at_once(spark, tmp_path):
    s = M.Snapshots(spark, f"file://{tmp_path}/index")
    s.commit({"files": spark.range(3), "chunks": spark.range(5)})
    s.commit({"files": spark.range(4)})
    assert s.versions() == {"files": 2, "chunks": 1} and s.read("files").count() == 4 and s.read("chunks").count() == 5
    assert s.with_columns("files", role="unknown").columns == ["id", "role"] and s.with_columns("files", id=0).columns == ["id"]


def test_statuses_fold(spark):
    df = spark.createDataFrame([(1, "indexed"), (1, "weird"), (1, "deleted"), (2, None)], "run_id long, status string")
    got = {r.run_id: (r.indexed, r.skipped, r.deleted, r.errors) for r in M.fold_statuses(df, ["run_id"]).collect()}
    assert got == {1: (1, 0, 1, 1), 2: (0, 0, 0, 1)}


def feed(path, name, *events):
    (path / name).write_text("\n".join(json.dumps(e) for e in events))


def test_watching_applies_the_feed_once(spark, tmp_path):
    inbox = tmp_path / "feed"
    inbox.mkdir()
    w = Watcher(spark, f"file://{tmp_path}/state")
    base = {"repo": "r", "at": "2025-01-01T00:00:00"}
    feed(inbox, "1.json", base | {"op": "created", "path": "src/a.py", "content": "x = 1", "seq": 1}, base | {"op": "modified", "path": "src/a.py", "content": "x = 2\ny", "seq": 2},
         base | {"op": "created", "path": "b/c.go", "content": "package b", "seq": 3}, base | {"op": "created", "path": "node_modules/z.js", "content": "1", "seq": 4}, base | {"op": "created", "path": "note.txt", "content": "1", "seq": 5})
    w.start(str(inbox), once=True).awaitTermination()
    files = {r.path: r for r in w.files().collect()}
    assert set(files) == {"src/a.py", "b/c.go"} and files["src/a.py"].line_count == 2
    feed(inbox, "2.json", base | {"op": "moved", "path": "src/a.py", "to_path": "lib/a.py", "content": "x = 3", "seq": 6}, base | {"op": "deleted", "path": "b", "seq": 7}, base | {"op": "created", "path": "b/d.go", "content": "package d", "seq": 8})
    w.start(str(inbox), once=True).awaitTermination()
    assert {r.path for r in w.files().collect()} == {"lib/a.py", "b/d.go"}
    before = sorted(map(tuple, w.files().collect()))
    w.apply(spark.createDataFrame([("r", "deleted", "lib", None, None, 9, None)], "repo string, op string, path string, to_path string, content string, seq long, at timestamp"), w.last())
    assert sorted(map(tuple, w.files().collect())) == before  # a replayed batch changes nothing
    assert {r.status for r in w.statuses().collect()} == {"indexed", "deleted"} and w.counters().first().indexed == 4


def test_streamed_tool_calls(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{data}/events.parque*")
    q = tool_call_counts(stream).writeStream.outputMode("complete").format("memory").queryName("calls").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.calls for r in spark.table("calls").collect()) == spark.read.parquet(f"{data}/events.parquet").where("event_type <> ''").count()


def test_walk_and_ignored(spark, tmp_path):
    for p, t in (("a.py", b"x\ny"), ("node_modules/b.js", b"1"), ("lib/c.min.js", b"1"), ("lib/d.ts", b"\xff\n"), ("e.txt", b"")):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(t)
    got = {r.path: r for r in R.walk(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "lib/d.ts"} and got["a.py"].line_count == 2 and got["lib/d.ts"].content == "\ufffd\n"
    assert R.ignored_by_git(["a.py"], None) == set()
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("a.py\n")
    assert R.ignored_by_git(["a.py", "lib/d.ts"], str(tmp_path)) == {"a.py"}
    files = spark.createDataFrame([("a.py",), ("b.py",)], "path string")
    assert [r.path for r in R.without_ignored(files, spark.createDataFrame([("a.py",)], "path string")).collect()] == ["b.py"]


def test_settings_merge(tmp_path):
    (tmp_path / "a.toml").write_text('[ingestion]\nchunk_size = 10\nexclude = ["x"]\n[embedding]\ndimensions = 3\n')
    (tmp_path / "b.toml").write_text("[ingestion]\noverlap = 5\n")
    s = R.load_settings(tmp_path / "a.toml", tmp_path / "b.toml", tmp_path / "none.toml")
    assert (s.chunk_size, s.overlap, s.exclude, s.embedding_dimensions) == (10, 5, ("x",), 3)


def test_answers_are_repaired():
    assert E.parse_json('```json\n{"a": 1}\n```') == {"a": 1} and E.parse_json("no") is None
    assert E.repair([{"intent": "magic", "description": "d"}], 2) == [("utility", "d"), ("utility", "")]


def http(answer, dimensions=2, key="k"):
    calls = []

    def post(url, body, headers):
        calls.append((url, body, headers))
        out = answer(len(calls), body)
        if isinstance(out, Exception):
            raise out
        return out

    return E.Http("http://x/v1/", "m", dimensions, key, 8, post), calls


def test_embedding_service():
    model, calls = http(lambda n, b: {"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]})
    assert model.embed(["a" * 99, "b"]) == [[1, 2], [3, 4]] and calls[0][2]["Authorization"] == "Bearer k" and len(calls[0][1]["input"][0]) == 32
    model, _ = http(lambda n, b: {"data": [{"index": 0, "embedding": [1, 2, 3]}]})
    with pytest.raises(ValueError):
        model.embed(["a"])
    model, calls = http(lambda n, b: E.ContextTooLong("exceeds") if n == 1 else {"data": [{"embedding": [1, 2]}]})
    assert model.embed(["abcd"]) == [[1, 2]] and calls[1][1]["input"] == ["ab"]
    model, _ = http(lambda n, b: {"choices": [{"message": {"content": '```json\n[{"intent": "testing", "description": "t"}]\n```'}}]})
    assert model.classify(["a", "b"]) == [("testing", "t"), ("utility", "")]
    model, _ = http(lambda n, b: {"choices": [{"message": {"content": "sorry"}}]})
    assert model.analyze("t", "p") == ("", "unknown")


def test_failing_services_do_not_stop_a_run(spark):
    class Broken:
        def classify(self, chunks):
            raise RuntimeError("down")

        def analyze(self, text, path):
            raise RuntimeError("down")

    df = spark.createDataFrame([("a.py", "def x(): pass"), (None, None)], "path string, content string")
    got = E.classify(df, provider=Broken).collect()
    assert [(r.intent, r.intent_detail) for r in got] == [("utility", "")] * 2
    got = E.analyze_files(df, provider=Broken).collect()
    assert [(r.summary, r.role, r.warning) for r in got] == [("", "unknown", "down")] * 2
    vectors = E.embed(df, "content").collect()
    assert len(vectors[0].embedding) == 64 and vectors[1].embedding is None


def test_latest_event_wins_however_late(spark):
    rows = [("p", 2, "b"), ("p", 3, "c"), ("p", 1, "a"), ("q", 1, "z")]
    got = M.latest_events(spark.createDataFrame(rows, "path string, seq long, op string"), ["path"], ["seq"]).collect()
    assert {(r.path, r.seq, r.op) for r in got} == {("p", 3, "c"), ("q", 1, "z")}


def test_modules_are_replaced_by_key(spark):
    s = "repo string, module_path string, kind string, module_name string, updated_at timestamp"
    old = spark.createDataFrame([("r", "a", "directory", "old", datetime(2025, 1, 1)), ("r", "_logical/x", "logical", "keep", datetime(2025, 1, 1)), ("q", "a", "directory", "keep", datetime(2025, 1, 1))], s)
    new = spark.createDataFrame([("r", "b", "directory", "one", datetime(2025, 1, 2)), ("r", "b", "directory", "two", datetime(2025, 1, 3))], s)
    got = {(r.repo, r.module_path, r.module_name) for r in M.upsert_modules(old, new, "directory").collect()}
    assert got == {("r", "_logical/x", "keep"), ("q", "a", "keep"), ("r", "b", "two")}
    gone = {(r.repo, r.module_path) for r in M.upsert_modules(old, new.limit(0), "directory", spark.createDataFrame([("r",), ("s",)], "repo string")).collect()}
    assert gone == {("r", "_logical/x"), ("q", "a")}  # no module of the kind is left in r


def test_cascade_of_renewed_files_and_symbols(spark):
    tables = {
        "code_chunks": spark.createDataFrame([(1, 1), (2, 2)], "id long, file_id long"),
        "symbols": spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 1, 2), (4, 1, None)], "id long, file_id long, chunk_id long"),
        "symbol_references": spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, None), (4, 2, 2)], "id long, source_file_id long, source_chunk_id long"),
        "dependencies": spark.createDataFrame([(1, 1, 2, 1, None), (2, 1, 2, 1, 2), (3, 1, None, 2, None), (4, 2, 1, 2, 1), (5, 1, None, None, None), (6, 1, 9, None, None)], "id long, source_file_id long, target_file_id long, source_symbol_id long, target_symbol_id long"),
    }
    kept = spark.createDataFrame([(1,), (2,)], "id long")
    out = M.cascade(tables, kept, spark.createDataFrame([(2,)], "file_id long"))
    assert {r.id for r in out["code_chunks"].collect()} == {1}
    assert {r.id: r.chunk_id for r in out["symbols"].collect()} == {1: 1, 3: None, 4: None}
    assert {r.id for r in out["symbol_references"].collect()} == {1, 3} and {r.id for r in out["dependencies"].collect()} == {1, 5}
