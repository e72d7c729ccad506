"""Splitting oversized items at natural boundaries (problem 1).

Balanced targets: the least number of pieces that could satisfy the limits gives equally spaced targets; each target
snaps to the strongest boundary near it, nearest first among equals; while any piece, its overlap included, breaks a
limit, one more piece is tried. Rows under the limits never leave the JVM.

Defined cases: null or empty content gives no piece; a null ``start_line`` gives null lines; text without any boundary
is cut between characters; repeated rows give repeated pieces (deduplicate by id before or after); extra columns are
ignored, ``key`` names the id column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, piece_index int, n_pieces int, content string, start_line int, end_line int, start_char int, overlap_chars int, words int, chars int"


@dataclass(frozen=True)
class Limits:
    """A piece has at most ``words`` runs of non-white-space and ``chars`` characters, overlap included.

    Consecutive pieces share up to ``overlap_lines`` whole lines that fit into ``overlap_chars``; where the line before
    is longer than that, the last ``overlap_chars`` of it.
    """

    words: int = 512
    chars: int = 4000
    overlap_lines: int = 6
    overlap_chars: int = 400

    def __post_init__(self):
        if not 0 <= self.overlap_chars <= self.chars // 4 or self.words < 4 or self.chars < 8:
            raise ValueError("the overlap must be at most a quarter of the size limit")


_BREAK = re.compile(r"\n+|(?<=[;,{}()\[\]])|(?<=\s)(?=\S)")
_OPENER = re.compile(r"[ \t]*(?:///?|/\*\*|#|@|export |public |private |protected |static |async |pub |fn |func |function |def |class |interface |struct |enum |impl |type )")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Possible cuts as positions in the text and their strengths.

    6 a blank line before a declaration or comment at the margin, 5 a blank line, 4 a line end before a less indented
    line or declaration, 3 a line end, 2 after punctuation, 1 before a word.
    """
    at, strength, n = [], [], len(text)
    for m in _BREAK.finditer(text):
        p = m.end()
        if not 0 < p < n:
            continue
        if m.group():
            end = text.find("\n", p)
            after = text[p : end if end >= 0 else n]
            indent = len(after) - len(after.lstrip(" \t"))
            blank = m.end() - m.start() > 1 or not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
            opener = bool(_OPENER.match(after))
            if blank:
                s = 6 if opener and indent <= 4 else 5
            else:
                start = text.rfind("\n", 0, m.start()) + 1
                before = text[start : m.start()]
                s = 4 if opener or indent < len(before) - len(before.lstrip(" \t")) else 3
        else:
            s = 1 if text[p - 1].isspace() else 2
        if at and at[-1] == p:
            strength[-1] = max(strength[-1], s)
        else:
            at.append(p)
            strength.append(s)
    return at, strength


def _overlap_start(text: str, cut: int, limits: Limits) -> int:
    """Where the piece that begins at ``cut`` starts with its overlap."""
    floor = max(0, cut - limits.overlap_chars)
    start = cut
    for _ in range(limits.overlap_lines):
        line = text.rfind("\n", 0, max(0, start - 1)) + 1
        if line < floor or line >= start:
            break
        start = line
    if start == cut:  # the line before is too long, or the cut is inside a line
        start = floor
        inside = re.compile(r"(?<=\s)(?=\S)").search(text, floor, cut)
        if inside:
            start = inside.start()
    return start


def split_text(text: str, limits: Limits) -> list[tuple[int, int, int]]:
    """Pieces as (start with overlap, cut, end); one piece if the text is within the limits."""
    n = len(text)
    total_words = len(text.split())
    if n <= limits.chars and total_words <= limits.words:
        return [(0, 0, n)] if n else []
    at, strength = boundaries(text)
    by_words = total_words * limits.chars > n * limits.words  # targets are equal in what binds
    words = [m.start() for m in re.finditer(r"\S+", text)] if by_words else []
    least = max(2, -(-n // limits.chars), -(-total_words // limits.words))
    most = total_words if by_words else n

    def attempt(pieces: int) -> list[tuple[int, int, int]] | None:
        """The split with so many targets, if it is within the limits."""
        targets = [words[i * total_words // pieces] if by_words else round(i * n / pieces) for i in range(1, pieces)]
        cuts = [0]
        for i, target in enumerate(targets):
            slack = ((targets[i + 1] if i + 1 < len(targets) else n) - (targets[i - 1] if i else 0)) / 8  # a quarter of a piece
            lo, hi = bisect_left(at, target - slack), bisect_left(at, target + slack + 1)
            best = max(range(lo, hi), key=lambda k: (strength[k], -abs(at[k] - target)), default=None)
            cut = target if best is None else at[best]
            if cut > cuts[-1]:
                cuts.append(cut)
        cuts.append(n)
        out: list[tuple[int, int, int]] = []
        for i in range(len(cuts) - 1):
            start = _overlap_start(text, cuts[i], limits) if i else 0
            out.append((max(start, out[-1][0] + 1) if out else 0, cuts[i], cuts[i + 1]))
        return out if all(e - s <= limits.chars and len(text[s:e].split()) <= limits.words for s, _, e in out) else None

    # pieces are added until no limit fails: in growing steps, then back to the fewest between the last two counts
    low, step = least - 1, 1
    while (found := attempt(min(low + step, most))) is None:
        if low + step >= most:
            return _hard(text, limits)
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        if (fewer := attempt(middle)) is None:
            low = middle
        else:
            found, high = fewer, middle
    return found


def _hard(text: str, limits: Limits) -> list[tuple[int, int, int]]:
    """The last resort, where overlap and boundaries leave no split: cuts at the limits, without overlap."""
    out, at, ends = [], 0, [m.end() for m in re.finditer(r"\S+", text)]
    while at < len(text):
        word = bisect_left(ends, at + 1) + limits.words - 1
        end = min(len(text), at + limits.chars, ends[word] if word < len(ends) else len(text))
        out.append((at, at, end))
        at = end
    return out


def split_oversized(df: DataFrame, limits: Limits | None = None, key: str = "id", content: str = "content", line: str | None = "start_line") -> DataFrame:
    """Pieces of the rows of ``df`` that exceed the limits, as ``SCHEMA`` (``id`` holds ``key``).

    A filter in the JVM keeps rows that cannot be oversized (w words need 2w-1 characters) away from Python;
    no shuffle, each row is split by itself.
    """
    limits = limits or Limits()
    at_least = min(limits.chars, 2 * limits.words) + 1
    rows = df.select(F.col(key).alias("id"), F.col(content).alias("content"), (F.col(line) if line else F.lit(1)).cast("int").alias("line"))
    rows = rows.where(F.length("content") >= at_least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, text, first in zip(pdf["id"], pdf["content"], pdf["line"]):
                pieces = split_text(text, limits)
                if len(pieces) < 2:
                    continue
                lines, done = 0, 0
                for i, (s, cut, e) in enumerate(pieces):
                    lines += text.count("\n", done, s)
                    done = s
                    body = text[s:e]
                    begin = None if pd.isna(first) else int(first) + lines
                    end = None if begin is None else begin + body.count("\n") - body.endswith("\n")
                    out.append((id_, i, len(pieces), body, begin, end, s, cut - s, len(body.split()), len(body)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return rows.mapInPandas(run, SCHEMA)
