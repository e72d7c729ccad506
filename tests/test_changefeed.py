"""Change capture: exactly the changes, whatever fails, is late or comes twice."""

import random
from datetime import datetime, timedelta

import pytest

from codelode.operators.changefeed import ChangeCapture, append, as_log, changed_records, duplicates_of_key, winners

SCANS = "scan_id long, run_id long, repo string, path string, hash string, scanned_at timestamp, received_at timestamp, note string"
FILES = "id long, repo string, path string, hash string, indexed_at timestamp"
T = datetime(2025, 1, 1)


def at(n):
    return T + timedelta(minutes=n)


def expected(scans, files):
    stored = {}
    for _, repo, path, h, t in files:
        if repo is None or path is None:
            continue
        k = (repo, norm(path))
        if k not in stored or (t is not None and (stored[k][1] is None or t > stored[k][1])):
            stored[k] = (clean(h), t)
    best = {}
    for s in scans:
        h = clean(s[4])
        if h is None or s[2] is None or s[3] is None or s[5] is None:
            continue
        k = (s[2], norm(s[3]))
        if k not in best or (s[5], s[0]) > best[k][:2]:
            best[k] = (s[5], s[0], h)
    return {sid for k, (t, sid, h) in best.items() if k not in stored or ((stored[k][0] is None or h != stored[k][0]) and (stored[k][1] is None or t > stored[k][1]))}


def norm(p):
    p = p.replace("\\", "/")
    while p.startswith("./"):
        p = p[2:].lstrip("/")
    return p


def clean(h):
    return (h or "").strip().lower() or None


def make(seed, n=300):
    r = random.Random(seed)
    repos = ["hot"] * 5 + ["a", "b", None]
    paths = ["x/a.py", "./x/a.py", "x\\a.py", "b.go", "c/d.rs", None]
    scans = [(i, r.choice([1, None]), r.choice(repos), r.choice(paths), r.choice(["AA", " aa", "bb", "cc\n", None, ""]), at(r.randrange(500)), at(r.randrange(900)), "extra") for i in range(n)]
    files = [(i, r.choice(repos), r.choice(paths), r.choice(["aa", "BB ", None]), r.choice([at(r.randrange(500)), None])) for i in range(8)]
    return scans + r.sample(scans, 20), files


class Log:
    """A log folder that tests append to."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, f"file://{folder}/log"

    def add(self, scans, files=1):
        append(self.spark.createDataFrame(scans, SCANS).coalesce(files), self.folder)
        return self

    def read(self):
        return self.spark.read.parquet(self.folder)


def ids(df):
    out = [r.scan_id for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_run_finds_exactly_the_changes(spark, tmp_path, seed):
    scans, files = make(seed)
    got = changed_records(Log(spark, tmp_path).add(scans, 3).read(), spark.createDataFrame(files, FILES), f"file://{tmp_path}/s")
    assert ids(got) == expected(scans, files)
    assert duplicates_of_key(got).isEmpty()


def test_runs_over_a_growing_log_end_where_one_run_ends(spark, tmp_path):
    scans, files = make(3)
    f, log = spark.createDataFrame(files, FILES), Log(spark, tmp_path)
    cap = ChangeCapture(spark, f"file://{tmp_path}/s", compact_every=3)
    seen, brought = [], []
    for begin, end in ((0, 100), (100, 180), (180, 180), (180, 240), (240, len(scans))):
        seen += scans[begin:end]
        if end > begin:
            log.add(scans[begin:end])
        brought.append(ids(cap.run(log.read(), f)))
        assert ids(cap.outstanding(f)) == expected(seen, files)
        assert ids(cap.outstanding(f)) <= set().union(*brought)
    assert brought[2] == set() and ids(cap.run(log.read(), f)) == set()  # nothing new
    kept = [sorted(p.name for p in (tmp_path / "s" / "winners" / kind).iterdir()) for kind in ("kind=base", "kind=delta")]
    assert kept == [["batch=2"], ["batch=3"]]
    assert set(brought[-1]) <= {s[0] for s in scans[240:]}


def test_records_that_come_late_are_read_once(spark, tmp_path):
    f, log = spark.createDataFrame([], FILES), Log(spark, tmp_path)
    cap = ChangeCapture(spark, f"file://{tmp_path}/s")
    log.add([(50, 1, "r", "a", "h", at(100), at(100), ""), (60, 1, "r", "b", "h", at(90), None, "")])
    assert ids(cap.run(log.read(), f)) == {50, 60} and ids(cap.run(log.read(), f)) == set()
    log.add([(40, 1, "r", "c", "h", at(5), None, ""), (41, 1, "r", "d", "h", at(5), at(6), "")])  # made, numbered and received before all that was committed
    assert ids(cap.run(log.read(), f)) == {40, 41}
    log.add([(40, 1, "r", "c", "h", at(5), None, ""), (39, 1, "r", "a", "x", at(99), at(999), ""), (61, 1, "r", "b", "y", at(90), None, "")])  # a repeat, an older scan of a key, one that ties by time
    assert ids(cap.run(log.read(), f)) == {61}
    assert ids(cap.outstanding(f)) == {50, 61, 40, 41} and ids(cap.changes()) == {50, 60, 40, 41, 61}


def test_a_failed_run_is_replayed_not_skipped(spark, tmp_path):
    scans, files = make(4, 120)
    f, log = spark.createDataFrame(files, FILES), Log(spark, tmp_path).add(scans)
    cap = ChangeCapture(spark, f"file://{tmp_path}/s")
    cap.process(log.read(), f, cap.plan(log.read()))  # and then the driver dies before the commit
    log.add([(999, 1, "new", "z.py", "ff", at(1), at(2000), "")])
    again = ChangeCapture(spark, f"file://{tmp_path}/s")
    plan = again.plan(log.read())
    assert [x["stop"] for x in plan["files"]] == [len(scans)]  # the old plan, though more has arrived
    assert ids(again.run(log.read(), f)) == expected(scans, files) | {999}


def test_a_batch_is_committed_only_when_its_sink_has_it(spark, tmp_path):
    files, log = spark.createDataFrame([], FILES), Log(spark, tmp_path)
    log.add([(1, 1, "r", "a", "h", at(1), None, "")]).add([(2, 1, "r", "b", "h", at(1), None, "")])
    cap = ChangeCapture(spark, f"file://{tmp_path}/s", most_files=1)
    got = {}

    def sink(changes, batch):
        if batch == 1 and not got.get("failed"):
            got["failed"] = True
            raise OSError("consumer died")
        got[batch] = ids(changes)

    with pytest.raises(OSError):
        cap.run(log.read(), files, sink)
    assert set(got) == {0, "failed"}
    assert cap.run(log.read(), files, sink).isEmpty()
    assert got[0] | got[1] == {1, 2} and len(got[0]) == len(got[1]) == 1
    cap.run(log.read(), files, sink)
    assert set(got) == {0, 1, "failed"}


def test_only_new_files_are_read_and_files_may_grow(spark, tmp_path):
    files, log = spark.createDataFrame([], FILES), Log(spark, tmp_path).add([(i, 1, "r", f"p{i}", "h", at(1), None, "") for i in range(30)])
    cap = ChangeCapture(spark, f"file://{tmp_path}/s")
    cap.run(log.read(), files)
    log.add([(99, 1, "r", "q", "h", at(1), None, "")])
    plan = cap.plan(log.read())
    assert [(x["start"], x["stop"]) for x in plan["files"]] == [(0, 1)]
    assert cap._slice(log.read(), plan).count() == 1
    assert ids(cap.run(log.read(), files)) == {99}


def test_empty_tables(spark, tmp_path):
    none, files = Log(spark, tmp_path / "none").add([]).read(), spark.createDataFrame([], FILES)
    assert changed_records(none, files, f"file://{tmp_path}/a").count() == 0
    one = Log(spark, tmp_path).add([(1, 1, "r", "p", "h", at(0), None, "")]).read()
    assert ids(changed_records(one, files, f"file://{tmp_path}/b")) == {1}
    assert winners(as_log(none)).count() == 0
    with pytest.raises(ValueError):
        changed_records(spark.createDataFrame([], SCANS), files, f"file://{tmp_path}/c")
