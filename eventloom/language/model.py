"""Data that the stages of the language share.

Resolved nodes are hashable tuples ``(kind, ...)``, so equal quantities are equal keys and
one structure serves as identity, cache key and input of every back end.

Collections
    ``base n`` | ``filter src predicate`` | ``union (members)`` | ``sort src key descending`` |
    ``slice src from to`` | ``combine distinct ((binder, src)..) ((name, particle)..) predicate`` |
    ``project combination member`` | ``nothing reason``
Particles
    ``elem coll index`` | ``met`` | ``this`` | ``item`` (a reducer's element) | ``binder name`` |
    ``sum (particles)`` | ``whole coll``
Numbers
    ``num text`` | ``scalar n`` | ``met_prop p`` | ``trigger n`` | ``size coll`` |
    ``prop particle p`` | ``angle fn a b`` | ``pair fn a b`` (least over whole collections) |
    ``arith op a b`` | ``neg a`` | ``abs a`` | ``fn name a`` | ``least|greatest (args)`` |
    ``choose g a b`` | ``fold kind coll body`` | ``truth b`` | ``defined a`` |
    ``external name (args)`` | ``bad reason``
Predicates
    ``cmp op a b`` | ``band inside a lo hi`` | ``and (..)`` | ``or (..)`` | ``not b`` | ``if g a b`` |
    ``const v`` | ``region n`` | ``any|all coll body`` | ``pairs fn a b op c`` | ``nonzero a`` |
    ``bad reason``
"""

from __future__ import annotations

from dataclasses import dataclass, field

PREDICATES = {"cmp", "band", "and", "or", "not", "if", "const", "region", "any", "all", "pairs", "nonzero"}


class LanguageError(ValueError):
    def __init__(self, errors: list[Diagnostic]):
        self.errors = errors
        super().__init__("; ".join(map(str, errors)))


@dataclass(frozen=True)
class Diagnostic:
    line: int
    text: str
    level: str = "error"

    def __str__(self) -> str:
        return f"line {self.line}: {self.text}"


@dataclass
class Step:
    """A statement of a region: kind is all, select, reject, inherit, trigger, weight, bins, bin or histo."""

    kind: str
    label: str
    node: tuple | None = None
    line: int = 0
    edges: tuple[float, ...] = ()
    name: str = ""
    histo: Histo | None = None


@dataclass
class Histo:
    name: str
    title: str
    kind: str  # h1, h1var, h2 or bad
    axes: tuple = ()  # (n, lo, hi) for each axis, or the edges
    exprs: tuple = ()
    reason: str = ""


@dataclass
class Region:
    name: str
    steps: list[Step] = field(default_factory=list)
    line: int = 0


@dataclass
class Analysis:
    objects: dict[str, tuple] = field(default_factory=dict)
    defines: dict[str, tuple] = field(default_factory=dict)
    regions: dict[str, Region] = field(default_factory=dict)
    info: dict[str, dict[str, str]] = field(default_factory=dict)
    tables: dict[str, dict] = field(default_factory=dict)
    counts: dict[str, list] = field(default_factory=dict)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    spelling: dict[str, str] = field(default_factory=dict)  # lower-case name to its spelling

    @property
    def errors(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.level == "error"]

    def collection(self, name: str) -> tuple:
        return self.objects[name.lower()]

    def define(self, name: str) -> tuple:
        return self.defines[name.lower()]

    def region(self, name: str) -> Region:
        return self.regions[name.lower()]


def walk(node):
    """Every tuple node within a node, itself first."""
    if isinstance(node, tuple):
        if node and isinstance(node[0], str):
            yield node
        for x in node:
            yield from walk(x)


def is_predicate(node: tuple) -> bool:
    return node[0] in PREDICATES
