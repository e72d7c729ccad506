"""Python functions of any layout, against the interpreter's own parser."""

import ast
import textwrap

from codelode.llm import docpairs as D

DOC = '"""Drops rows older than the limit."""'
TEXT = f'''
def several(
    a: int,  # a comment with ( and :
    b=lambda x: {{"k": (1, 2)}},
    *rest: str,
) -> dict[str, int]:
    {DOC}
    return a

def commented(a):  # keeps (this
    # and this

    {DOC}
    x = [
1, 2,
]
    return x

def generic[T: (int, str)](a: T) -> T:
    r\'\'\'Keeps at most three
copies alive: def no():
    \'\'\'
    return a
if True:
     def five(a): \\
          return 1
     class K:
            def twelve(self, q="):"):
                   "Waits until the lock is free again."
                   def deepest():
                                      {DOC}
                                      return """
def fake():
"""

                   return deepest

            async def last(self): "Counts how often a row was touched."; return 2
x = 1
def joined():
    "Drops rows older than " + "the limit of it"

# the end
'''


def functions(text):
    return {(n.name, n.lineno, n.end_lineno, bool(ast.get_docstring(n))) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}


def test_layouts(spark):
    damaged = f"def a(x:\n    {DOC}\n    y = (1,\n\ndef b(x):\n    {DOC}\n    return x\n"
    texts = [(1, TEXT), (2, TEXT.replace("\n", "\r\n")), (3, damaged), (4, ""), (5, "def")]
    df = spark.createDataFrame([(i, "python", t) for i, t in texts], "file_id long, language string, content string")
    rows = D.indent_functions(df).collect()
    want = functions(TEXT)
    assert len(want) == 8
    for i in (1, 2):
        got = {(r.name, r.start_line, r.end_line, bool(r.docstring)) for r in rows if r.file_id == i}
        # a comment in column 0 after the last statement counts as the end of what stands above it, as for other files
        assert {g if g[0] != "joined" else (*g[:2], 41, g[3]) for g in got} == {w if w[0] != "joined" else (*w[:2], 41, w[3]) for w in want}
    assert {(r.name, r.start_line, r.end_line) for r in rows if r.file_id == 3} == {("b", 5, 7)}
    pairs = {r.name: (r.signature, r.description) for r in D.source_pairs(df.where("file_id = 1")).collect()}
    assert set(pairs) == {"several", "commented", "generic", "twelve", "deepest", "last"}
    assert pairs["commented"] == ("def commented(a):", "Drops rows older than the limit.") and pairs["last"][1] == "Counts how often a row was touched."
    assert pairs["generic"] == ("def generic[T: (int, str)](a: T) -> T:", "Keeps at most three\ncopies alive: def no():")
    assert " ".join(pairs["several"][0].split()).startswith("def several( a: int, b=lambda x:")


def test_library_against_its_own_parser(spark):
    sources = [open(m.__file__).read() for m in (ast, textwrap, __import__("argparse"), __import__("dataclasses"), __import__("typing"), __import__("subprocess"))]
    df = spark.createDataFrame([(i, "python", t) for i, t in enumerate(sources)], "file_id long, language string, content string")
    got = {(r.file_id, r.name, r.start_line, bool(r.docstring)) for r in D.indent_functions(df).collect()}
    assert got == {(i, n, s, d) for i, t in enumerate(sources) for n, s, _, d in functions(t)}
