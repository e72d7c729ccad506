"""Packrat parsing-expression grammars of programming languages."""

from codelode.llm.grammars.languages import LANGUAGES, parser

__all__ = ["LANGUAGES", "parser"]
