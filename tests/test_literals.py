"""Braces and comment marks inside literals are text, by the rules of each language."""

import pytest

from codelode.operators.chunking import Scanner, _blanked, chunk_text

SCRIPT = """function load() {
  fetch('https://api.example.com/v1', {a: 1}, () => { go(); });
  done();
}
function warn() {
  log('unexpected token { here');
}
function last() {
  return s.replace(/'/g, "{").replace(/[/'{]/, 'it\\'s { fine');
}
class Box {
  open() { log('a closing brace } alone'); }
  shut() { }
}
"""
TSX = """function Page() {
  return <p>{name}'s {list.map(x => 'y')} Don't {a} stop, it's </p>;
}
function Next() { return <b>Bob</b>; }
"""
CASES = [
    *[(k, SCRIPT, [("load", 1, 4), ("warn", 5, 7), ("last", 8, 10), ("Box", 11, 14)]) for k in ("javascript", "typescript", "tsx")],
    ("tsx", TSX, [("Page", 1, 3), ("Next", 4, 4)]),
    ("rust", "fn f<'a>(x: &'a str) -> char {\n    let q = '\\u{7b}'; let s = \"one \\\n line {\"; let r = r#\"a \" {\"#;\n    '{'\n}\nfn g<'a, 'b>(x: &'a T<'b>) { }\n", [("f", 1, 5), ("g", 6, 6)]),
    ("java", "class A {\n    char c = '{'; char d = '\\''; char e = '\\u007b'; String s = \"//{\";\n}\nclass B { }\n", [("A", 1, 3), ("B", 4, 4)]),
    ("csharp", "class A {\n    char c = '}'; string s = @\"C:\\\"; string t = @\"a \"\"{\"\" b\";\n}\nclass B { }\n", [("A", 1, 3), ("B", 4, 4)]),
    ("go", "func f() {\n\ta := '{'; b := `\\`; c := \"//{\"\n}\nfunc g() { }\n", [("f", 1, 3), ("g", 4, 4)]),
    ("c", "int f(int a) {\n    int b = '{', c = 'ab}', d = '\\x7b', e = 1'000'000;\n    return b;\n}\nint g(int a) { return L'{'; }\n", [("f", 1, 4), ("g", 5, 5)]),
    ("swift", "func f() {\n  let a = #\"a \" {\"#\n  let b = \"it's {\"\n}\nfunc g() { }\n", [("f", 1, 4), ("g", 5, 5)]),
]


@pytest.mark.parametrize("language,text,want", CASES)
def test_declarations_around_literals(language, text, want):
    assert [(d.name, d.start, d.end) for d in Scanner(text, language).declarations()] == want
    assert {c["symbol_name"] for c in chunk_text(text, language, "x") if c.get("symbol_name")} == {n for n, _, _ in want}
    assert len(_blanked(text, language)) == len(text)


@pytest.mark.parametrize("language", ["javascript", "typescript", "tsx"])
def test_members_around_long_literals(language):
    box = Scanner(SCRIPT, language).declarations()[-1]
    assert [(m.name, m.start, m.end) for m in box.members] == [("open", 12, 12), ("shut", 13, 13)]
