"""Splitting source files into chunks along their declarations, with symbols and members.

A scanner blanks out comments and literals, measures nesting by braces (by indentation in Python) and recognises
declarations by the head of their line. Each top-level declaration becomes a chunk; all lines outside make one more, which
comes first; a container of more than 1.5 times the chunk size becomes its head and one chunk a member. Files without
declarations are cut greedily by words, each piece carrying the last lines of the one before.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINERS = ("class", "struct", "extension", "protocol", "interface")
SCHEMA = (
    "file_id long, chunk_index int, content string, start_line int, end_line int, symbol_name string, symbol_type string, parent_symbol string, docstring string, signature string, "
    "qualified_name string, container_symbol string, visibility string, is_exported boolean, declared_in_extension boolean, is_primary_declaration boolean, "
    "members array<struct<name:string,kind:string,signature:string,docstring:string,start_line:int,end_line:int,container:string,visibility:string,is_exported:boolean,declared_in_extension:boolean>>"
)

_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r"\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\""
_CHARACTER = r"'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|(?:u+|[xU])[0-9A-Fa-f]+|[0-7]{1,3}|[^\n]))'"
_TEXT_BLOCK = r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)"
# JavaScript and TypeScript: no string begins right after a name, a brace or a tag (there it is an apostrophe in the text between tags), and a slash
# after an operator opens a regular expression.
_PATTERN = r"\s*+(?P<%s>/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/)"
_SCRIPT = (
    r"`(?:[^`\\]|\\[\s\S])*`|'(?:(?<![\w$}]')(?<![\w/]>')|(?<=\breturn')|(?<=\bcase')|(?<=\bfrom')|(?<=\bimport')|(?<=\btypeof')|(?<=\bin')|(?<=\bof')|(?<=\belse')|(?<=\bdefault'))[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    r"|[=(,:;!&|?{\[>](?:(?<!>)|(?<==>))" + _PATTERN % "after_sign" + r"|[rtc](?:(?<=\br)eturn|(?<=\bt)ypeof|(?<=\bc)ase)" + _PATTERN % "after_word"
)
_LITERALS = {
    "javascript": [_QUOTED, _SCRIPT],
    "java": [_TEXT_BLOCK, _QUOTED, _CHARACTER],
    "csharp": [r"(?P<quotes>\"{3,})[\s\S]*?(?:(?P=quotes)|\Z)", r"(?:@\$?|\$@)\"(?:[^\"]|\"\")*+\"", _QUOTED, _CHARACTER],
    "go": [r"`[^`]*`", _QUOTED, _CHARACTER],
    "rust": [r"\br(?P<hashes>#*)\"[\s\S]*?\"(?P=hashes)", r"\bbr(?P<marks>#*)\"[\s\S]*?\"(?P=marks)", _QUOTED, _CHARACTER],
    "c": [r"\b(?:u8|[uUL])?R\"(?P<delimiter>[^\s()\\\"]{0,16})\([\s\S]*?\)(?P=delimiter)\"", _QUOTED, r"(?:(?<!\w)|(?<=\b[uUL])|(?<=\bu8))" + _CHARACTER.replace("))'", ")){1,4}'")],
    "swift": [r"(?P<hashes>#+)(?P<quotes>\"\"\"|\")[\s\S]*?(?P=quotes)(?P=hashes)", _TEXT_BLOCK, _QUOTED],
}
_LITERALS |= {"typescript": _LITERALS["javascript"], "tsx": _LITERALS["javascript"], "cpp": _LITERALS["c"]}
_BLANK = {language: re.compile("|".join([_COMMENT, *rules])) for language, rules in _LITERALS.items()}
_BLANK_PY = re.compile(r"#[^\n]*|(?i:[rbfu]{0,2})(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')")
_MODIFIERS = r"(?:(?:public|private|protected|internal|open|fileprivate|static|final|abstract|sealed|partial|async|override|virtual|export|default|declare|readonly|unsafe|extern|inline|const|mutating|required|convenience|lazy|weak|new|native|synchronized|file|pub(?:\([^)]*\))?|@\w+(?:\([^)]*\))?)\s+)*"
_HEADS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("function", r"function\*?\s+(?P<name>[\w$]+)"), ("class", r"class\s+(?P<name>[\w$]+)"), ("variable", r"(?:const|let|var)\s+(?P<name>[\w$]+)\s*[=:]")],
    "java": [("class", r"(?:class|record)\s+(?P<name>\w+)"), ("interface", r"@?interface\s+(?P<name>\w+)"), ("enum", r"enum\s+(?P<name>\w+)")],
    "csharp": [("class", r"(?:class|record(?:\s+struct)?)\s+(?P<name>\w+)"), ("struct", r"struct\s+(?P<name>\w+)"), ("interface", r"interface\s+(?P<name>\w+)"), ("enum", r"enum\s+(?P<name>\w+)"), ("function", r"delegate\s+[\w<>\[\],.? ]+?\s+(?P<name>\w+)\s*[(<]")],
    "go": [("function", r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)"), ("type", r"type\s+(?P<name>\w+)")],
    "rust": [("function", r"(?:unsafe\s+|async\s+|const\s+|extern\s+(?:\"\s*\w*\s*\"\s+)?)*fn\s+(?P<name>\w+)"), ("class", r"struct\s+(?P<name>\w+)"), ("enum", r"enum\s+(?P<name>\w+)"), ("impl", r"impl(?:\s*<[^{]*?>)?\s+(?:[\w:<>', ]+?\s+for\s+)?(?P<name>\w+)"), ("interface", r"(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("type", r"type\s+(?P<name>\w+)")],
    "c": [("class", r"struct\s+(?P<name>\w+)\s*\{"), ("enum", r"enum\s+(?P<name>\w+)\s*\{"), ("type", r"typedef\b[^;{]*?(?P<name>\w+)\s*;"), ("function", r"(?!return\b|else\b|typedef\b)[A-Za-z_][\w\s*]*?[\s*](?P<name>\w+)\s*\([^;{}]*\)\s*\{")],
    "swift": [("function", r"func\s+(?P<name>\w+|[^\s\w(]+)"), ("class", r"(?:class|actor)\s+(?!func\b|var\b|let\b)(?P<name>\w+)"), ("struct", r"struct\s+(?P<name>\w+)"), ("extension", r"extension\s+(?P<name>[\w.]+)"), ("protocol", r"protocol\s+(?P<name>\w+)"), ("enum", r"(?:indirect\s+)?enum\s+(?P<name>\w+)")],
}
_HEADS["typescript"] = [*_HEADS["javascript"], ("interface", r"interface\s+(?P<name>[\w$]+)"), ("type", r"type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*="), ("enum", r"(?:const\s+)?enum\s+(?P<name>[\w$]+)")]
_HEADS["tsx"] = _HEADS["typescript"]
_HEADS["cpp"] = [*_HEADS["c"], ("class", r"class\s+(?P<name>\w+)"), ("namespace", r"namespace\s+(?P<name>\w+)")]
_MEMBER_HEADS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("method", r"(?:get\s+|set\s+|async\s+|\*\s*)*(?P<name>#?[\w$]+)\s*\([^;{}]*\)[^;{}=]*\{")],
    "java": [("method", r"(?:<[^>]+>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<name>\w+)\s*\([^;{}]*\)[^;{}=]*[{;]")],
    "csharp": [("method", r"(?:[\w<>\[\],.?]+\s+)?(?P<name>\w+|operator\s*\S+|this)\s*[(\[][^;{}]*[)\]][^;{}=]*(?:[{;]|=>)"), ("property", r"[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:\{|=>)")],
    "swift": [("method", r"(?:func\s+(?P<name>\w+|[^\s\w(]+)|(?P<fixed>init|deinit|subscript)\b)"), ("property", r"(?:var|let)\s+(?P<name>\w+)\s*[:=]")],
    "rust": [("method", r"(?:unsafe\s+|async\s+|const\s+)*fn\s+(?P<name>\w+)")],
}
_MEMBER_HEADS["typescript"] = [("method", r"(?:get\s+|set\s+|async\s+|\*\s*)*(?P<name>#?[\w$]+)\s*(?:<[^>(]*>)?\s*\([^;{}]*\)[^;{}=]*\{")]
_MEMBER_HEADS["tsx"] = _MEMBER_HEADS["typescript"]
_CONTROL = frozenset("if for while switch catch return foreach using lock do else try new throw guard match sizeof await".split())
_INDENTED = re.compile(r"^(?P<indent>[ \t]*)(?:async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)", re.M)


_DOC = re.compile(r"[^\n]*:[ \t]*(?:#[^\n]*)?\n(?:[ \t]*\n)*[ \t]+[rRuU]?(\"\"\"|''')([\s\S]*?)\1")


@dataclass
class Declaration:
    name: str
    kind: str
    start: int  # first line from 1, decorators included
    end: int
    head: int  # the line of the head itself
    text_start: int = 0
    docstring: str | None = None
    signature: str = ""
    visibility: str = "public"
    exported: bool = False
    extension: bool = False
    members: list["Declaration"] = field(default_factory=list)


def _blanked(text: str, language: str) -> str:
    def blank(m: re.Match) -> str:
        begin = max(m.start(), *(m.start(k) for k in rx.groupindex if k.startswith("after_")), -1)
        return text[m.start() : begin] + re.sub(r"[^\n]", " ", text[begin : m.end()])

    rx = _BLANK_PY if language == "python" else _BLANK.get(language)
    return rx.sub(blank, text) if rx else text


def visibility_of(language: str, name: str, head: str, container: str | None = None) -> str:
    """Visibility by modifiers, names or the language's default."""
    if language == "python":
        return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") and not name.startswith("__") else "public"
    words = set(re.findall(r"[A-Za-z]+", head.split("(")[0].split("{")[0]))
    if language == "swift":
        return next((w for w in ("open", "public", "fileprivate", "private", "internal") if w in words), "internal")
    if language == "csharp":
        for pair in (("private", "protected"), ("protected", "internal")):
            if set(pair) <= words:
                return " ".join(pair)
        own = next((w for w in ("public", "private", "protected", "internal", "file") if w in words), None)
        return own or ("public" if container == "interface" else "private" if container else "internal")
    if language in ("javascript", "typescript", "tsx"):
        return "private" if name.startswith("#") else next((w for w in ("private", "protected", "public") if w in words), "public")
    return next((w for w in ("private", "protected", "public") if w in words), "public")


def is_exported(language: str, head: str, visibility: str) -> bool:
    if language == "swift":
        return visibility in ("public", "open")
    if language == "csharp":
        return visibility in ("public", "protected", "protected internal")
    return language in ("javascript", "typescript", "tsx") and bool(re.match(r"\s*export\b", head))


def _doc_before(lines: list[str], at: int) -> str | None:
    """The documentation comment right above line ``at`` (from 1), attributes between skipped."""
    i = at - 2
    while i >= 0 and re.match(r"\s*(?:@\w|\[\w)", lines[i]):
        i -= 1
    if i >= 0 and lines[i].rstrip().endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        return "\n".join(lines[max(j, 0) : i + 1]).strip() if j >= 0 and "/**" in lines[j] else None
    j = i
    while j >= 0 and lines[j].lstrip().startswith("///"):
        j -= 1
    return "\n".join(x.strip() for x in lines[j + 1 : i + 1]) or None


class Scanner:
    """The declarations of one text."""

    def __init__(self, text: str, language: str):
        self.language, self.lines = language, text.split("\n")
        self.code = _blanked(text, language)
        self.starts = [0]
        for m in re.finditer("\n", self.code):
            self.starts.append(m.end())
        self.text = text
        # every brace with its partner in one pass, and where statements end or bodies open
        self.marks = [m.start() for m in re.finditer(r"[{};]", self.code)]
        self.partner: dict[int, int] = {}
        opened: list[int] = []
        for at in self.marks:
            if self.code[at] == "{":
                opened.append(at)
            elif self.code[at] == "}" and opened:
                self.partner[opened.pop()] = at

    def _line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def _close(self, opened: int) -> int:
        """The place of the brace that closes the one at ``opened``."""
        return self.partner.get(opened, len(self.code) - 1)

    def _line_end(self, at: int) -> int:
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end

    def _scan(self, begin: int, end: int, heads: list[tuple[str, str]], container: Declaration | None) -> list[Declaration]:
        rules = [(kind, re.compile(r"[ \t]*" + _MODIFIERS + rx)) for kind, rx in heads]
        out, at = [], begin
        while at < end:
            stop = self.code.find("\n", at, end)
            stop = end if stop < 0 else stop
            if self.code[at:stop].strip():
                found = self._head(at, end, rules)
                if found:
                    kind, name, m = found
                    decl, at = self._declare(kind, name, m, end, container)
                    out.append(decl)
                    continue
                opened = self.code.find("{", at, stop)
                if opened >= 0:
                    scope = re.match(r"\s*(?:namespace\b|extern\b)", self.code[at:stop])
                    if scope and not container:
                        at = opened + 1
                        continue
                    at = self._close(opened) + 1
                    continue
            at = stop + 1
        return out

    def _head(self, at: int, end: int, rules):
        mark = bisect_left(self.marks, at)
        if mark < len(self.marks):  # a head reaches no further than the first brace or semicolon
            end = min(end, self.marks[mark] + 1)
        elif self.language in ("c", "cpp"):
            return None
        for kind, rx in rules:
            m = rx.match(self.code, at, end)
            if m:
                name = m.groupdict().get("name") or m.groupdict().get("fixed")
                if name and name not in _CONTROL and self.code[at : m.end()].split("(")[0].split()[0] not in _CONTROL:
                    return kind, name, m
        return None

    def _declare(self, kind: str, name: str, m: re.Match, end: int, container: Declaration | None) -> tuple[Declaration, int]:
        lead = len(m.group()) - len(m.group().lstrip())
        begin = m.start() + lead
        here = re.compile(r"[{;]").search(self.code, max(begin, m.end() - 1), end)
        newline = self.code.find("\n", m.end())
        one_line = kind in ("variable", "type", "property") and (here is None or (newline >= 0 and here.start() > newline))
        if one_line or here is None:
            last = newline if newline >= 0 else len(self.code)
        elif here.group() == ";":
            last = here.start() + 1
        else:
            last = self._close(here.start()) + 1
        head = self.text[begin : self._line_end(begin)].strip()
        row = self._line(begin)
        visibility = visibility_of(self.language, name, head, container.kind if container else None)
        extension = self.language == "swift" and (kind == "extension" or bool(container and container.extension))
        d = Declaration(name, kind, row, self._line(max(begin, last - 1)), row, begin, _doc_before(self.lines, row), head, visibility, is_exported(self.language, head, visibility), extension)
        if kind in (*CONTAINERS, "impl") and here is not None and here.group() == "{":
            heads = _MEMBER_HEADS.get(self.language, [])
            d.members = self._scan(here.start() + 1, last - 1, heads, d) if heads else []
        after = self.code.find("\n", last)
        return d, (len(self.code) if after < 0 else after + 1)

    def _indented(self) -> list[Declaration]:
        found, code_lines = [], self.code.split("\n")
        for m in _INDENTED.finditer(self.code):
            width = len(m["indent"].expandtabs(8))
            row = self._line(m.start())
            end = row
            for i in range(row, len(self.lines)):
                line = code_lines[i] if i < len(code_lines) else ""
                raw = self.lines[i]
                if line.strip() and len(line) - len(line.lstrip()) <= width and i + 1 > row and not re.match(r"\s*[)\]}]", line):
                    break
                if raw.strip():
                    end = i + 1
            start = row
            while start > 1 and self.lines[start - 2].strip().startswith("@") and len(self.lines[start - 2]) - len(self.lines[start - 2].lstrip()) == len(m["indent"]):
                start -= 1
            doc = _DOC.match(self.text, m.end()) if ":" in self.text[m.end() : self._line_end(m.end())] else None
            name = m["name"]
            d = Declaration(name, "class" if m["kind"] == "class" else "function", start, end, row, m.start(), doc[2].strip() if doc else None, self.lines[row - 1].strip(), visibility_of("python", name, ""))
            found.append((width, d))
        top: list[Declaration] = []
        stack: list[tuple[int, Declaration]] = []
        for width, d in found:
            while stack and stack[-1][0] >= width:
                stack.pop()
            if not stack and width == 0:
                top.append(d)
            elif stack and stack[-1][1].kind == "class" and len(stack) == 1:
                d.kind = "method" if d.kind == "function" else d.kind
                stack[-1][1].members.append(d)
            stack.append((width, d))
        return top

    def declarations(self) -> list[Declaration]:
        """Top-level declarations in order, with the members of containers."""
        if self.language == "python":
            return self._indented()
        heads = _HEADS.get(self.language)
        return self._scan(0, len(self.code), heads, None) if heads else []


def fallback_chunks(text: str, size: int = 512, overlap: int = 64) -> list[tuple[str, int, int]]:
    """(content, first line, last line): lines gathered until they hold ``size`` words; the next piece repeats the last
    ``overlap // 10`` lines. What is left at the end makes a piece of its own.
    """
    lines, out, first, words = text.split("\n"), [], 0, 0
    counts = [len(x.split()) for x in lines]
    for i, n in enumerate(counts):
        words += n
        if words >= size:
            out.append(("\n".join(lines[first : i + 1]), first + 1, i + 1))
            kept = min(overlap // 10, i + 1 - first) if overlap >= 10 else 0
            first = i + 1 - kept
            words = sum(counts[first : i + 1])
    if first < len(lines):
        out.append(("\n".join(lines[first:]), first + 1, len(lines)))
    return out


def chunk_text(text: str, language: str | None, path: str, size: int = 512, overlap: int = 64) -> list[dict]:
    """The chunks of one file as dictionaries in the order of ``SCHEMA`` without file_id and index."""
    declarations = Scanner(text, language).declarations() if language else []
    if not declarations:
        return [{"content": c, "start_line": s, "end_line": e} for c, s, e in fallback_chunks(text, size, overlap)]
    lines, out = text.split("\n"), []
    covered = set()
    for d in declarations:
        covered.update(range(d.start, d.end + 1))
    rest = [i for i in range(1, len(lines) + 1) if i not in covered]
    glue = "\n".join(lines[i - 1] for i in rest).strip()
    if glue:
        out.append({"content": glue, "start_line": rest[0], "end_line": rest[0] + len(rest) - 1})
    for d in declarations:
        own = {
            "symbol_name": d.name, "symbol_type": d.kind, "parent_symbol": None, "docstring": d.docstring, "signature": d.signature, "qualified_name": f"{path}:{d.name}", "container_symbol": None,
            "visibility": d.visibility, "is_exported": d.exported, "declared_in_extension": d.extension, "is_primary_declaration": not d.extension,
        }
        body = "\n".join(lines[d.start - 1 : d.end])
        members = [
            (x.name, x.kind, x.signature, x.docstring, x.start, x.end, d.name, x.visibility, x.exported, x.extension) for x in d.members
        ] if d.kind in CONTAINERS else []
        if len(body.split()) > 1.5 * size and d.kind in CONTAINERS and d.members:
            out.append(own | {"content": d.signature, "start_line": d.start, "end_line": d.head, "members": members})
            for x in d.members:
                out.append({
                    "content": "\n".join(lines[x.start - 1 : x.end]), "start_line": x.start, "end_line": x.end, "symbol_name": x.name, "symbol_type": x.kind, "parent_symbol": d.name, "docstring": x.docstring,
                    "signature": x.signature, "qualified_name": f"{path}:{d.name}.{x.name}", "container_symbol": d.name, "visibility": x.visibility, "is_exported": x.exported,
                    "declared_in_extension": x.extension, "is_primary_declaration": False,
                })
        else:
            out.append(own | {"content": body, "start_line": d.start, "end_line": d.end, "members": members})
    return out


def chunk_files(texts: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of every text, see ``SCHEMA``; ``texts`` has file_id, path, language and content. A narrow pass."""
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file_id, path, language, text in zip(pdf["file_id"], pdf["path"], pdf["language"], pdf["content"]):
                for n, c in enumerate(chunk_text(text, language, path or "", size, overlap)):
                    out.append([file_id, n, *[c.get(k) for k in names[2:]]])
            frame = pd.DataFrame(out, columns=names)
            for b in ("is_exported", "declared_in_extension", "is_primary_declaration"):
                frame[b] = frame[b].astype("object")
            yield frame

    return texts.where("content is not null").select("file_id", "path", "language", "content").mapInPandas(run, SCHEMA)


def chunk_symbols(chunks: DataFrame) -> DataFrame:
    """One row per declared symbol and per member, as the index stores them; members point to their container by name."""
    own = chunks.where("symbol_name is not null and parent_symbol is null").select(
        "file_id", "chunk_index", F.col("symbol_name").alias("name"), "qualified_name", F.col("symbol_type").alias("kind"), "signature", "docstring", "start_line", "end_line", "container_symbol", "visibility",
        "is_exported", "declared_in_extension", "is_primary_declaration",
    )
    rows = chunks.where("size(members) > 0").select("file_id", "chunk_index", "qualified_name", F.explode("members").alias("m"))
    members = rows.select(
        "file_id", "chunk_index", F.col("m.name").alias("name"), F.concat("qualified_name", F.lit("."), "m.name").alias("qualified_name"), F.col("m.kind").alias("kind"), "m.signature", "m.docstring",
        "m.start_line", "m.end_line", F.col("m.container").alias("container_symbol"), "m.visibility", "m.is_exported", "m.declared_in_extension", F.lit(False).alias("is_primary_declaration"),
    )
    return own.unionByName(members)
