"""A compiler from parsing-expression grammars over tokens to packrat parsers.

Notation: ``rule <- a / b`` with memory of results, ``rule <= a / b`` without; ``'text'`` a token by its text, ``NAME``
and other capitals a token by its kind, ``@x`` a test of the lexer's state, ``* + ?`` repetition, ``& !`` lookahead.
Every rule becomes one Python function from a token's index to the index behind the match, or -1. Alternatives are
entered only if the next token can begin them. A second build of the same grammar records the furthest token looked at
in vain; it runs only on texts that failed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_META = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:(?P<def>[a-z_]\w*)\s*(?P<kind><-|<=)|(?P<lit>'[^']+')|(?P<test>@\w+)|(?P<tok>[A-Z][A-Z0-9_]*)|(?P<rule>[a-z_]\w*)|(?P<op>[/()*+?&!]))")


def _read(source: str) -> dict[str, tuple[bool, tuple]]:
    """Rules as {name: (memory, expression)}; expressions are tuples headed by their kind."""
    items, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _META.match(source, at)
        if not m:
            if not source[at:].strip() or source[at:].strip().startswith("#"):
                break
            raise ValueError(f"cannot read grammar at {source[at:at + 40]!r}")
        items.append((m.lastgroup if m.lastgroup != "kind" else "def", m.group(m.lastgroup) if m.lastgroup != "kind" else (m["def"], m["kind"])))
        at = m.end()
    pos = 0

    def peek():
        return items[pos] if pos < len(items) else ("end", "")

    def choice():
        nonlocal pos
        alts = [seq()]
        while peek() == ("op", "/"):
            pos += 1
            alts.append(seq())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def seq():
        parts = []
        while peek()[0] not in ("end", "def") and peek() not in (("op", "/"), ("op", ")")):
            parts.append(prefix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefix():
        nonlocal pos
        if peek() in (("op", "&"), ("op", "!")):
            mark = peek()[1]
            pos += 1
            return ("and" if mark == "&" else "not", suffix())
        return suffix()

    def suffix():
        nonlocal pos
        x = primary()
        while peek()[0] == "op" and peek()[1] in "*+?":
            x = ({"*": "star", "+": "plus", "?": "opt"}[peek()[1]], x)
            pos += 1
        return x

    def primary():
        nonlocal pos
        kind, value = peek()
        pos += 1
        if kind == "op" and value == "(":
            x = choice()
            if peek() != ("op", ")"):
                raise ValueError("missing )")
            pos += 1
            return x
        return {"lit": ("lit", value.strip("'")), "tok": ("tok", value), "rule": ("rule", value), "test": ("test", value[1:])}[kind]

    rules = {}
    while pos < len(items):
        kind, value = items[pos]
        if kind != "def":
            raise ValueError(f"expected a rule, found {value!r}")
        pos += 1
        rules[value[0]] = (value[1] == "<-", choice())
    return rules


@dataclass(frozen=True)
class Grammar:
    """``fixed``: texts the lexer gives as kinds of their own (keywords, punctuation); other literals are names."""

    source: str
    fixed: frozenset[str]
    start: str = "program"


class Compiled:
    """A parser of one grammar; ``run`` gives the end of the longest program, ``furthest`` where it failed."""

    def __init__(self, grammar: Grammar, tracking: bool):
        self.rules = _read(grammar.source)
        self.fixed, self.tracking, self.count = grammar.fixed, tracking, 0
        self.first: dict[str, set | None] = {}
        self.empty: dict[str, bool] = {}
        for name, (_, x) in self.rules.items():
            for r in self._names(x):
                if r not in self.rules:
                    raise ValueError(f"{name} uses unknown rule {r}")
        self._analyse()
        self.space: dict = {"K": [], "V": [], "N": [], "FAR": [0]}
        out = ["def T(i):", "    if i > FAR[0]: FAR[0] = i", "    return False"] if tracking else []
        for name, (memory, x) in self.rules.items():
            out += self._function(name, memory, x)
        exec(compile("\n".join(out), "<grammar>", "exec"), self.space)  # noqa: S102 - our own grammars only
        self.entry = self.space[f"p_{grammar.start}"]
        self.memories = [self.space[f"M_{n}"] for n, (memory, _) in self.rules.items() if memory]

    def _names(self, x):
        if x[0] == "rule":
            yield x[1]
        elif x[0] in ("seq", "choice"):
            for y in x[1]:
                yield from self._names(y)
        elif x[0] in ("star", "plus", "opt", "and", "not"):
            yield from self._names(x[1])

    def _empty(self, x) -> bool:
        k = x[0]
        if k in ("star", "opt", "and", "not", "test"):
            return True
        if k == "seq":
            return all(self._empty(y) for y in x[1])
        if k == "choice":
            return any(self._empty(y) for y in x[1])
        if k == "plus":
            return self._empty(x[1])
        return self.empty[x[1]] if k == "rule" else False

    def _first(self, x) -> set | None:
        """Kinds that can begin x, None for any."""
        k = x[0]
        if k == "lit":
            return {x[1]} if x[1] in self.fixed else {"NAME"}
        if k == "tok":
            return None if x[1] in ("WORD", "ANY") else {x[1]}
        if k == "rule":
            return self.first[x[1]]
        if k == "choice":
            sets = [self._first(y) for y in x[1]]
            return None if any(s is None for s in sets) else set().union(*sets)
        if k in ("star", "plus", "opt"):
            return self._first(x[1])
        if k == "seq":
            out: set = set()
            for y in x[1]:
                if y[0] in ("and", "not", "test"):
                    if y[0] == "test":
                        return None
                    continue
                s = self._first(y)
                if s is None:
                    return None
                out |= s
                if not self._empty(y):
                    return out
            return out
        return None

    def _analyse(self) -> None:
        self.empty = dict.fromkeys(self.rules, False)
        self.first = {n: set() for n in self.rules}
        for _ in range(len(self.rules) + 2):
            before = (dict(self.empty), {n: None if s is None else set(s) for n, s in self.first.items()})
            for n, (_, x) in self.rules.items():
                self.empty[n] = self._empty(x)
                self.first[n] = self._first(x)
            if before == (self.empty, self.first):
                break

    def _new(self) -> str:
        self.count += 1
        return f"t{self.count}"

    def _function(self, name: str, memory: bool, x) -> list[str]:
        self.count = 0
        body = [f"def p_{name}(i):"]
        if memory:
            body += [f"    r = M_{name}.get(i)", "    if r is not None: return r"]
        body += self._emit(x, "i", "r", "    ")
        if memory:
            body.append(f"    M_{name}[i] = r")
        body.append("    return r")
        return ([f"M_{name} = {{}}"] if memory else []) + body

    def _test(self, x, at: str) -> str | None:
        """A Python condition for a single token, None if x is more."""
        if x[0] == "lit":
            return f"K[{at}] == {x[1]!r}" if x[1] in self.fixed else f"(V[{at}] == {x[1]!r} and K[{at}] == 'NAME')"
        if x == ("tok", "ANY"):
            return f"K[{at}] != 'EOF'"
        if x[0] == "tok":
            return f"(K[{at}] == 'NAME' or K[{at}][0].isalpha() and K[{at}].islower())" if x[1] == "WORD" else f"K[{at}] == {x[1]!r}"
        if x[0] == "choice":
            plain = [y for y in x[1] if y[0] == "tok" and y[1] not in ("WORD", "ANY") or y[0] == "lit" and y[1] in self.fixed]
            if len(plain) == len(x[1]):
                kinds = tuple(dict.fromkeys(y[1] for y in plain))
                return f"K[{at}] in {{{', '.join(map(repr, kinds))}}}"
        return None

    def _emit(self, x, at: str, out: str, pad: str) -> list[str]:
        k = x[0]
        test = self._test(x, at)
        if test:
            miss = f" or T({at})" if self.tracking else ""
            return [f"{pad}{out} = {at} + 1 if {test}{miss} else -1"]
        if k == "rule":
            return [f"{pad}{out} = p_{x[1]}({at})"]
        if k == "test":
            return [f"{pad}{out} = {at} if {TESTS[x[1]].replace('$', at)} else -1"]
        if k == "seq":
            code, inner, here = [f"{pad}{out} = -1"], pad, at
            for y in x[1]:
                t = self._new()
                code += self._emit(y, here, t, inner)
                code.append(f"{inner}if {t} >= 0:")
                inner += " "
                here = t
            return [*code, f"{inner}{out} = {here}"]
        if k == "choice":
            code, t = [f"{pad}{out} = -1"], pad
            for n, y in enumerate(x[1]):
                if n:
                    code.append(f"{t}if {out} < 0:")
                    t += " "
                first = None if self._empty(y) else self._first(y)
                if first is not None and y[0] != "lit" and y[0] != "tok":
                    kinds = ", ".join(sorted(map(repr, first)))
                    miss = f" or T({at})" if self.tracking else ""
                    code.append(f"{t}if K[{at}] in {{{kinds}}}{miss}:" if first else f"{t}if False:")
                    code += self._emit(y, at, out, t + " ")
                else:
                    code += self._emit(y, at, out, t)
            return code
        if k in ("star", "plus"):
            t = self._new()
            code = [f"{pad}{out} = {at}", f"{pad}while True:", *self._emit(x[1], out, t, pad + " "), f"{pad} if {t} <= {out}: break", f"{pad} {out} = {t}"]
            return code if k == "star" else [*code, f"{pad}if {out} == {at}: {out} = -1"]
        if k == "opt":
            t = self._new()
            first = None if self._empty(x[1]) else self._first(x[1])
            if first and not self.tracking:
                kinds = ", ".join(sorted(map(repr, first)))
                return [f"{pad}{out} = {at}", f"{pad}if K[{at}] in {{{kinds}}}:", *self._emit(x[1], at, t, pad + " "), f"{pad} if {t} >= 0: {out} = {t}"]
            return [*self._emit(x[1], at, t, pad), f"{pad}{out} = {t} if {t} >= 0 else {at}"]
        t = self._new()
        return [*self._emit(x[1], at, t, pad), f"{pad}{out} = {at} if {t} {'>=' if k == 'and' else '<'} 0 else -1"]

    def run(self, kinds: list[str], values: list[str], lines: list[bool]) -> int:
        """The end of the program in tokens; ``lines`` says which tokens have a line break before them."""
        self.space["K"], self.space["V"], self.space["N"] = kinds, values, lines
        self.space["FAR"][0] = 0
        try:
            return self.entry(0)
        finally:
            for m in self.memories:
                m.clear()

    @property
    def furthest(self) -> int:
        return self.space["FAR"][0]


#: Tests of the lexer's state at token $: end of a statement without semicolon, same line, line break, behind a call, none.
TESTS = {
    "eos": "K[$] == ';' or N[$] or K[$] == '}' or K[$] == 'EOF'",
    "same": "not N[$]",
    "newline": "N[$]",
    "closed": "K[$ - 1] in (')', '}', 'INC')",
    "eps": "True",
}
