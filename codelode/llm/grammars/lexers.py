"""Lexers: texts to kinds, values, places and line breaks of tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


class LexicalError(ValueError):
    """A place no token can begin, or a literal that does not end."""

    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    lines: list[bool] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def add(self, kind: str, value: str, broken: bool, at: int) -> None:
        self.kinds.append(kind)
        self.values.append(value)
        self.lines.append(broken)
        self.places.append(at)


_OPENERS = ("\"\"\"", "'''", "\"", "'", "`", "/*", "r#", "@\"", "$\"")


class Lexer:
    """A lexer from one regular expression with the groups skip, name, number, string and op (each optional).

    ``classes`` maps operator texts to kinds shared by several; ``semicolons`` inserts them at line ends after tokens
    that can end a statement; ``regex`` allows regular expression literals where an operand is due.
    """

    def __init__(self, *, skip: str, name: str, number: str, string: str, ops: str, keywords: str, classes: dict[str, str] | None = None, semicolons: bool = False, regex: bool = False):
        self.keywords = frozenset(keywords.split())
        self.ops = sorted(ops.split(), key=len, reverse=True)
        self.classes = {op: kind for kind, group in (classes or {}).items() for op in group.split()}
        self.semicolons, self.regex = semicolons, regex
        op = "|".join(map(re.escape, self.ops))
        rx = r"|(?P<regex>/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)" if regex else ""
        self.pattern = re.compile(rf"(?P<skip>{skip})|(?P<name>{name})|(?P<number>{number})|(?P<string>{string}){rx}|(?P<bad>/\*)|(?P<op>{op})")
        self.fixed = self.keywords | frozenset(self.ops) | frozenset(self.classes.values()) | {";"}

    back = "STR"  # the kind of a literal between back quotes
    _ENDS = frozenset(("NAME", "NUM", "STR", ")", "]", "}", "return", "break", "continue", "fallthrough", "INC"))

    def tokens(self, text: str) -> Tokens:
        out = Tokens()
        at, n, broken = 0, len(text), False
        match, keywords, classes = self.pattern.match, self.keywords, self.classes
        kinds, values, lines, places = out.kinds, out.values, out.lines, out.places
        if text.startswith("﻿"):
            at = 1
        while at < n:
            m = match(text, at)
            if m is None:
                raise LexicalError(at, "unterminated literal" if text.startswith(_OPENERS, at) else "illegal character")
            group, value = m.lastgroup, m.group()
            end = m.end()
            if group == "bad":
                raise LexicalError(at, "unterminated comment")
            if group == "skip":
                if "\n" in value:
                    broken = True
                    if self.semicolons and kinds and kinds[-1] in self._ENDS:
                        out.add(";", "\n", False, at)
                at = end
                continue
            if group == "name":
                kind = value if value in keywords else "NAME"
            elif group == "number":
                kind = "NUM"
                if end < n and (text[end].isalnum() or text[end] == "_"):
                    raise LexicalError(end, "illegal number")
            elif group == "string":
                kind = self.back if value[0] == "`" else "LIFE" if value[0] == "'" and (value[-1] != "'" or len(value) == 1) else "STR"
            elif group == "regex":
                if kinds and (kinds[-1] in ("NAME", "NUM", "STR", ")", "]", "}", "this", "super", "null", "true", "false", "TPL")):
                    value = "/=" if text.startswith("/=", at) else "/"
                    end, kind = at + len(value), classes.get(value, value)
                else:
                    kind = "REGEX"
            else:
                kind = classes.get(value, value)
            kinds.append(kind)
            values.append(value)
            lines.append(broken)
            places.append(at)
            broken = False
            at = end
        if self.semicolons and kinds and kinds[-1] in self._ENDS:
            out.add(";", "\n", False, n)
        out.add("EOF", "", True, n)
        return out


_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


class TemplateLexer(Lexer):
    """Adds literals between back quotes with ``${`` expressions ``}`` inside."""

    back = "TPL"

    def tokens(self, text: str) -> Tokens:
        if "${" not in text:
            return super().tokens(text)
        out = Tokens()
        at, n, broken = 0, len(text), False
        depth: list[int] = []
        match, kinds = self.pattern.match, out.kinds

        def chunk(start: int, first: bool) -> int:
            """Lex a template's text from ``start`` on; True expressions follow as tokens."""
            m = _TEMPLATE.match(text, start)
            end = m.end()
            if text.startswith("`", end):
                out.add("TPL" if first else "TPLT", "`", broken, start)
                return end + 1
            if text.startswith("${", end):
                out.add("TPLH" if first else "TPLM", "`", broken, start)
                depth.append(0)
                return end + 2
            raise LexicalError(start, "unterminated literal")

        while at < n:
            if text[at] == "`":
                at = chunk(at + 1, True)
                broken = False
                continue
            if text[at] == "}" and depth and depth[-1] == 0:
                depth.pop()
                at = chunk(at + 1, False)
                continue
            m = match(text, at)
            if m is None:
                raise LexicalError(at, "unterminated literal" if text.startswith(_OPENERS, at) else "illegal character")
            group, value, end = m.lastgroup, m.group(), m.end()
            if group == "bad":
                raise LexicalError(at, "unterminated comment")
            if group == "skip":
                broken = broken or "\n" in value
                at = end
                continue
            if group == "name":
                kind = value if value in self.keywords else "NAME"
            elif group == "number":
                kind = "NUM"
                if end < n and (text[end].isalnum() or text[end] == "_"):
                    raise LexicalError(end, "illegal number")
            elif group == "string":
                kind = "STR"
            elif group == "regex":
                if kinds and kinds[-1] in ("NAME", "NUM", "STR", ")", "]", "}", "this", "super", "null", "true", "false", "TPL", "TPLT"):
                    value = "/=" if text.startswith("/=", at) else "/"
                    end, kind = at + len(value), self.classes.get(value, value)
                else:
                    kind = "REGEX"
            else:
                kind = self.classes.get(value, value)
            if depth and kind in "{}":
                depth[-1] += 1 if kind == "{" else -1
            out.add(kind, value, broken, at)
            broken = False
            at = end
        if depth:
            raise LexicalError(n, "unterminated literal")
        out.add("EOF", "", True, n)
        return out


_PY = re.compile(
    r"(?P<skip>[ \t\f]+|\\\r?\n|#[^\n]*)|(?P<nl>\r?\n)"
    # a replacement field may hold literals in the quotes of the literal around it
    r"|(?P<string>(?i:f|fr|rf)(?:\"(?!\"\")(?>[^\"\\\n{]|\\[\s\S]|\{\{|\{(?>[^{}\n\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\})*+\"|'(?!'')(?>[^'\\\n{]|\\[\s\S]|\{\{|\{(?>[^{}\n\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\})*+')"
    r"|(?i:[rbfu]|br|rb|fr|rf)?(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%&|^@:=!<>]=|->|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
_PY_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_CLASSES = {op: "AUG" for op in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()} | {op: "CMP" for op in "== != < > <= >=".split()} | {
    op: "BIN" for op in "/ // % & | ^ << >>".split()
} | {"+": "PM", "-": "PM"}


class PythonLexer:
    """Layout by indentation: tokens NEWLINE, INDENT and DEDENT."""

    fixed = _PY_KEYWORDS | frozenset("( ) [ ] { } , : . ; = -> := * ** ~ @ ... AUG CMP BIN PM".split())

    def tokens(self, text: str) -> Tokens:
        out = Tokens()
        at, n, depth, fresh = (1 if text.startswith("﻿") else 0), len(text), 0, True
        levels = [0]
        match, kinds = _PY.match, out.kinds
        while at < n:
            if fresh and not depth:
                end = at
                while end < n and text[end] in " \t\f":
                    end += 1
                if end < n and text[end] not in "\r\n#":
                    width = len(text[at:end].expandtabs(8))
                    if width > levels[-1]:
                        levels.append(width)
                        out.add("INDENT", "", False, end)
                    while width < levels[-1]:
                        levels.pop()
                        out.add("DEDENT", "", False, end)
                    if width != levels[-1]:
                        raise LexicalError(end, "inconsistent indentation")
                fresh, at = False, end
                continue
            m = match(text, at)
            if m is None:
                raise LexicalError(at, "unterminated literal" if text[at] in "\"'" else "illegal character")
            group, value, end = m.lastgroup, m.group(), m.end()
            if group == "nl":
                if not depth:
                    if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                        out.add("NEWLINE", "\n", False, at)
                    fresh = True
            elif group != "skip":
                if group == "name":
                    kind = value if value in _PY_KEYWORDS else "NAME"
                elif group == "string":
                    kind = "STR"
                elif group == "number":
                    kind = "NUM"
                    if end < n and (text[end].isalnum() or text[end] == "_") and not re.match(r"(?:and|or|if|else|in|is|for|not)\b", text[end:]):
                        raise LexicalError(end, "illegal number")
                    if value[0] == "0" and value.isdigit() and value.strip("0"):
                        raise LexicalError(at, "illegal number")
                else:
                    kind = _PY_CLASSES.get(value, value)
                    depth += (value in "([{") - (value in ")]}")
                    depth = max(depth, 0)
                out.add(kind, value, False, at)
            at = end
        if depth == 0 and kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
            out.add("NEWLINE", "", False, n)
        for _ in levels[1:]:
            out.add("DEDENT", "", False, n)
        out.add("EOF", "", False, n)
        return out


def line_column(text: str, at: int) -> tuple[int, int]:
    """Line and column of a place, from 1."""
    before = text.count("\n", 0, at)
    return before + 1, at - (text.rfind("\n", 0, at) + 1) + 1


def line_of(starts: list[int], at: int) -> int:
    return bisect_right(starts, at)
