"""Source files that do not parse (problem 5).

Every text is lexed and parsed by the packrat grammar of its language (``grammars``), which must consume all of it. For
a text that fails, a second parse records the furthest token looked at in vain. The cause is told from the text: markers
of an unresolved merge, a text cut off, a literal that does not end, a character no token has, another language whose
grammar takes all of it, or else an unexpected token.

Defined cases: null texts and languages without a grammar are not judged; empty texts are judged like any other (Go
wants a package clause); texts nested deeper than the recursion limit count as not judged (``valid`` is null), never as
wrong; repeated ids give one row. Line ends may be CRLF, and a byte order mark is no fault.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_id long, language string, valid boolean, line int, column int, cause string"
DEPTH = 40_000
_CONFLICT = re.compile(r"(?m)^(?:<{7}(?: |\r?$)|={7}\r?$|>{7}(?: |\r?$)|\|{7}(?: |\r?$))")
#: How often languages are taken for each other: tried in this order when a text fails.
_OTHERS = ("python", "javascript", "java", "go", "c", "csharp", "rust", "swift", "typescript")


def _attempt(language: str, text: str) -> tuple[bool, int, str]:
    """(whether all of the text parses, place of failure, cause by the lexer or '')."""
    from codelode.llm.grammars import parser
    from codelode.llm.grammars.lexers import LexicalError

    p = parser(language)
    try:
        tokens = p.lexer.tokens(text)
    except LexicalError as e:
        return False, e.at, e.cause
    if p.fast.run(tokens.kinds, tokens.values, tokens.lines) >= 0:
        return True, -1, ""
    p.slow.run(tokens.kinds, tokens.values, tokens.lines)
    at = min(p.slow.furthest, len(tokens.places) - 1)
    return False, tokens.places[at], "end" if tokens.kinds[at] == "EOF" else ""


def check(language: str, text: str) -> tuple[bool | None, int | None, int | None, str | None]:
    """(valid, line, column, cause) of one text."""
    from codelode.llm.grammars.lexers import line_column

    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    try:
        good, at, cause = _attempt(language, text)
        if good:
            return True, None, None, None
        line, column = line_column(text, at)
        mark = _CONFLICT.search(text)
        if mark and text.count("\n", 0, mark.start()) <= line:
            cause = "merge conflict"
        elif cause == "end" or (cause in ("unterminated literal", "unterminated comment") and "\n" not in text[at:].rstrip() and at > 0):
            cause = "truncated"
        else:
            other = next((o for o in _OTHERS if o != language and text.strip() and _attempt(o, text)[0]), None)
            cause = f"other language: {other}" if other else "markup" if text.lstrip()[:1] == "<" else cause
        return False, line, column, cause or "unexpected token"
    except RecursionError:
        return None, None, None, "too deep"


def parse_files(texts: DataFrame) -> DataFrame:
    """The verdict on every text, see ``SCHEMA``; ``texts`` has file_id, language and content.

    A narrow pass; only the ids of repeated rows are compared afterwards.
    """
    from codelode.llm.grammars import LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_id", "language", "valid", "line", "column", "cause"]
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            ids, languages = b.column(0), b.column(1)
            out = [check(lang, t) for lang, t in zip(languages.to_pylist(), b.column(2).to_pylist())]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, languages, *[pa.array(c, k) for c, k in zip(cols, kinds[2:])]], names)

    rows = texts.where(F.col("file_id").isNotNull() & F.col("content").isNotNull() & F.lower("language").isin(*LANGUAGES))
    # texts are bulky and few: more, smaller tasks than the scan gives keep every core busy
    rows = rows.select("file_id", F.lower("language").alias("language"), "content")
    return rows.mapInArrow(run, SCHEMA).dropDuplicates(["file_id"])


def parse_rates(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, language, judged, invalid, rate) from the verdicts and the files' repositories (id, repo)."""
    both = verdicts.join(files.select(F.col("id").alias("file_id"), "repo"), "file_id").where("valid is not null")
    invalid = F.sum((~F.col("valid")).cast("long"))
    return both.groupBy("repo", "language").agg(F.count("*").alias("judged"), invalid.alias("invalid"), F.round(invalid / F.count("*"), 6).alias("rate"))
