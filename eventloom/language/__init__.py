"""The selection language: source text to syntax tree to resolved model."""

from .model import Analysis, LanguageError
from .parser import parse
from .resolver import resolve

__all__ = ["Analysis", "LanguageError", "parse", "resolve", "analyse"]


def analyse(source: str) -> Analysis:
    """Parse and resolve; raises ``LanguageError`` with every error found."""
    a = resolve(parse(source))
    if a.errors:
        raise LanguageError(a.errors)
    return a
