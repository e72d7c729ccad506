"""Golden cases and properties of the extraction operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codelode.operators import extraction as X
from codelode.operators.chunking import Scanner, chunk_text, fallback_chunks

CHUNKS = "id long, file_id long, content string, start_line int, end_line int, symbol_name string, symbol_type string, parent_symbol string"


def test_fallback_chunks():
    assert fallback_chunks("alpha beta\ngamma delta", 2, 0) == [("alpha beta", 1, 1), ("gamma delta", 2, 2)]
    text = "\n".join(f"w{i} x" for i in range(20))
    parts = fallback_chunks(text, 8, 20)
    assert parts[0] == ("w0 x\nw1 x\nw2 x\nw3 x", 1, 4) and parts[1][1] == 3 and parts[-1][2] == 20
    r = random.Random(1)
    for _ in range(50):
        text = "\n".join(" ".join("w" * r.randrange(3)) for _ in range(r.randrange(30)))
        parts = fallback_chunks(text, 5, r.choice([0, 10, 30]))
        for c, s, e in parts:
            assert c == "\n".join(text.split("\n")[s - 1 : e])
        assert not parts or parts[-1][2] == text.count("\n") + 1


def test_imports(spark):
    rows = [
        (1, "swift", "import Foundation\nimport MapKit\nlet value = 1"), (2, "unknown", "import nowhere"),
        (3, "csharp", 'using System;\nusing static System.Math;\nglobal using Demo.Core;\nusing Alias = Demo.Services;\nConsole.WriteLine("ok");'), (4, None, "import x"), (5, "python", None), (6, "python", "  from a.b import c\nx = 1"),
    ]
    got = X.imports(spark.createDataFrame(rows, "file_id long, language string, content string")).orderBy("file_id", "line_no").collect()
    assert [(r.file_id, r.module) for r in got] == [(1, "Foundation"), (1, "MapKit"), (3, "System"), (3, "System.Math"), (3, "Demo.Core"), (3, "Demo.Services"), (6, "a.b")]
    assert got[0].raw == "import Foundation" and got[-1].raw == "from a.b import c"


def brute(content, start, own):
    out = set()
    for i, line in enumerate(content.split("\n")):
        for rx, kind in ((r"\b([A-Z][A-Za-z0-9_]*)\b", "type_reference"), (r"(?<![.\w])([a-z_][A-Za-z0-9_]*)\s*\(", "call"), (r"\.([A-Za-z_][A-Za-z0-9_]*)\s*\(", "member_call")):
            out |= {(start + i, m[1], kind) for m in re.finditer(rx, line) if m[1] not in X.NO_NAMES and m[1] != own}
    return out


def test_references_against_brute_force(spark):
    texts = ["Foo(bar(baz(1)), x.y(Z.q (2)))\nif (a) { self.run(run(b)) }", "Straße(Größe) été(a)\nfoo.bar(foo(\n", "", "return func(x)"]
    rows = [(i, 1, t, 10, 12, own, "function", None) for i, (t, own) in enumerate(zip(texts, ("bar", None, "", "q")))]
    got = X.references(spark.createDataFrame(rows, CHUNKS)).collect()
    for i, t in enumerate(texts):
        mine = [(r.line_no, r.target_name, r.reference_kind) for r in got if r.chunk_id == i]
        assert len(mine) == len(set(mine)) and set(mine) == brute(t, 10, rows[i][5])


def test_service_edges(spark):
    text = "class AppCoordinator {\n  let auth: AuthService\n  var log: Logger\n  init(store: Core.UserStore<Int>?) {\n  }\n  func go() {\n    auth.login()\n    log.write()\n  }\n}"
    chunks = [(1, 7, "", 1, 10, "AppCoordinator", "class", None), (2, 7, "", 6, 9, "go", "method", "AppCoordinator")]
    got = X.service_edges(spark.createDataFrame([(7, text)], "file_id long, content string"), spark.createDataFrame(chunks, CHUNKS)).collect()
    assert {(r.source_symbol_name, r.target_name, r.kind, r.line_no) for r in got} == {
        ("AppCoordinator", "AuthService", "type_reference", 2), ("AppCoordinator", "UserStore", "injection", 4), ("AppCoordinator", "AuthService", "service_usage", 7)
    }


def test_clean_type_and_separators(spark):
    df = spark.createDataFrame([("Core.Box<Item>?", "/*****/\n// ----\nx\n  // -- y\n")], "t string, s string")
    r = df.select(X.clean_type(F.col("t")).alias("t"), X.strip_separators(F.col("s")).alias("s")).first()
    assert r.t == "Box" and r.s == "x\n  // -- y\n"


def test_enclosing_chunk_is_the_smallest(spark):
    lines = spark.createDataFrame([(1, 9, 5), (2, 9, 50), (3, 8, 5)], "id long, file_id long, line_no int")
    chunks = spark.createDataFrame([(1, 9, "", 1, 20, None, None, None), (2, 9, "", 4, 6, None, None, None), (3, 9, "", 4, 6, None, None, None)], CHUNKS)
    got = {r.id: r.enclosing_chunk_id for r in X.enclosing_chunks(lines, chunks, ["id"]).collect()}
    assert got == {1: 2, 2: None, 3: None}


CASES = {
    "csharp": ("using System;\nnamespace Demo.Services;\n\npublic class Greeter\n{\n    public string SayHello(string name)\n    {\n        return $\"Hello {name}\";\n    }\n}", [("Greeter", "class", 4, 10, ["SayHello"])]),
    "python": ("import x\n\n@dec\ndef f(a):\n    '''doc'''\n    return 1\n\nclass C:\n    def g(self):\n        s = \"def no(): {\"\n\n    async def _h(self): pass\n\nX = 1\n", [("f", "function", 3, 6, []), ("C", "class", 8, 12, ["g", "_h"])]),
    "typescript": ("import a from 'b';\nexport class A {\n  private x = 1;\n  run(a: number): void {\n    if (a) { b(); }\n  }\n}\nexport interface I { a: string }\nconst f = (x) => x;\n", [("A", "class", 2, 7, ["run"]), ("I", "interface", 8, 8, []), ("f", "variable", 9, 9, [])]),
    "go": ("package a\n\nfunc (t *T) Run(x int) int {\n\treturn x\n}\n\ntype T struct {\n\ta int\n}\n", [("Run", "function", 3, 5, []), ("T", "type", 7, 9, [])]),
    "rust": ("use a::b;\n/// Doc.\npub fn f(a: &str) -> i64 {\n    let s = \"}\";\n    1\n}\nimpl A {\n    fn g(&self) {}\n}\n", [("f", "function", 3, 6, []), ("A", "impl", 7, 9, ["g"])]),
    "swift": ("import X\npublic final class A: B {\n  init(a: Int) { }\n  func go() { }\n}\nextension A { func h() { } }\n", [("A", "class", 2, 5, ["init", "go"]), ("A", "extension", 6, 6, ["h"])]),
    "java": ("package a;\n\npublic class A {\n    private int f(String s) {\n        return 1;\n    }\n}\n", [("A", "class", 3, 7, ["f"])]),
    "c": ("#include \"a.h\"\n\nstatic int f(int a) {\n    if (a > 1) {\n        g(a);\n    }\n    return a;\n}\n", [("f", "function", 3, 8, [])]),
}


def test_declarations():
    for language, (text, want) in CASES.items():
        got = [(d.name, d.kind, d.start, d.end, [m.name for m in d.members]) for d in Scanner(text, language).declarations()]
        assert got == want, language


def test_chunks_cover_the_file_and_know_their_symbols():
    text, _ = CASES["csharp"]
    chunks = chunk_text(text, "csharp", "Greeter.cs")
    own = next(c for c in chunks if c.get("symbol_name") == "Greeter")
    assert own["visibility"] == "public" and own["is_exported"] is True and own["members"][0][0] == "SayHello"
    assert chunks[0]["content"].startswith("using System;")
    big = "class A:\n" + "\n".join(f"    def m{i}(self):\n        return 'a b c d e f'" for i in range(60))
    parts = chunk_text(big, "python", "a.py", 40)
    assert parts[0]["content"] == "class A:" and len(parts) == 61 and parts[1]["parent_symbol"] == "A"
    assert chunk_text("", "python", "a.py") == [{"content": "", "start_line": 1, "end_line": 1}]
    for broken in ("class {{{", "def", "}}}}", "\x00", "/* never"):
        for language in CASES:
            chunk_text(broken, language, "x")


def test_declarations_of_any_length_and_in_linear_time():
    import time

    from codelode.operators.chunking import Scanner

    long = "int many(" + ",\n    ".join(f"int argument_{i}" for i in range(400)) + ")\n{\n    return 0;\n}\n\nint next(int a)\n{\n    return a;\n}\n"
    assert [(d.name, d.start, d.end) for d in Scanner(long, "c").declarations()] == [("many", 1, 403), ("next", 405, 408)]
    spent = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        assert len(Scanner("package a\n" + "func F(a int) int {\n\treturn a\n}\n" * n, "go").declarations()) == n
        assert len(Scanner("def f(a):\n    return a\n\n" * n, "python").declarations()) == n
        spent.append(time.perf_counter() - began)
    assert spent[1] < 9 * spent[0] + 0.2


def test_single_items_and_questions():
    from codelode.operators.enrichment import Offline, analyze_one, classify_one, embed_query

    class Broken(Offline):
        def classify(self, chunks):
            raise RuntimeError("down")

        analyze = None

    assert classify_one("assert mock(spec)") == ("testing", "") and classify_one(None) == ("utility", "") and classify_one("x", Broken) == ("utility", "")
    assert analyze_one("# Sorts rows.\nx = 1", "a/test_b.py") == ("Sorts rows.", "test suite") and analyze_one("x", "y", Broken) == ("", "unknown")
    assert embed_query("normalise row") == Offline().embed(["normalise row"])[0]
    with pytest.raises(ValueError):
        embed_query("  ")


def test_scalars_for_display(spark):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from codelode.functions.columns import date_only, escaped_html, iso_time

    df = spark.createDataFrame([("<a href=\"x\">'&amp;'</a>", datetime(2025, 3, 4, 5, 6, 7, 891000, tzinfo=timezone.utc)), (None, None), ("", None)], "t string, at timestamp")
    got = [tuple(r) for r in df.select(escaped_html(F.col("t")), iso_time(F.col("at")), date_only(F.col("at"))).collect()]
    assert got == [("&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;&#39;&lt;/a&gt;", "2025-03-04T05:06:07.891Z", "2025-03-04"), (None, None, None), ("", None, None)]
