"""External functions: names that the language may call and that a user supplies.

``register("fht", fn)`` takes a builder of a Column (``column``) from the compiled arguments
(numbers as Columns, whole collections as array Columns, particles as struct Columns) and,
for row-wise evaluation, a plain function (``plain``) of the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class External:
    column: Callable[..., Column]
    plain: Callable[..., float | None] | None = None


REGISTRY: dict[str, External] = {}


def register(name: str, column: Callable[..., Column], plain: Callable[..., float | None] | None = None) -> None:
    REGISTRY[name.lower()] = External(column, plain)


def unregister(name: str) -> None:
    REGISTRY.pop(name.lower(), None)


def lookup(table: dict) -> External:
    """An efficiency table as a function: the row whose ranges hold the arguments."""
    n, skip = table["nvars"], 1 + 2 * table["errors"]
    rows = [(r[0], [(r[skip + 2 * i], r[skip + 2 * i + 1]) for i in range(n)]) for r in table["rows"] if len(r) >= skip + 2 * n]

    def column(*args: Column) -> Column:
        out = F.lit(None).cast("double")
        for value, ranges in reversed(rows):
            test = F.lit(True)
            for a, (lo, hi) in zip(args, ranges, strict=True):
                test = test & (a >= lo) & (a < hi)
            out = F.when(test, F.lit(value)).otherwise(out)
        return out

    def plain(*args):
        return next((v for v, rs in rows if all(a is not None and lo <= a < hi for a, (lo, hi) in zip(args, rs, strict=True))), None)

    return External(column, plain)
