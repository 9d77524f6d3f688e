"""Sums of doubles that don't depend on the order of their rows.

A weight is an integer of 53 bits times a power of two. Rows of one exponent are summed as integers, in three
pieces of 18 bits that a long can hold for 10^13 rows; weights' squares are scaled by the same exponent twice. These sums are
exact, so partial ones may meet in any order, in batches too. At last the few exponents of a sum are added up from the
least one on, with the rounding errors carried along. So a sum is the same, bit by bit, at any number of
partitions, and close to the exactly rounded one. All of it is built-in expressions.

Weights that aren't finite, or are beyond 2^500 in size, have no exponent here and are summed as doubles; zeros have exponent 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 18
LIMIT = 500
#: Partial sums of weights (a) and of their squares (b), by pieces, and as doubles where a weight has no exponent.
PIECES = ("a2", "a1", "a0", "b2", "b1", "b0", "odd", "odd2")


def exponent(w: Column) -> Column:
    """The power of two of a weight's leading bit; null where it is too large, too small or not finite."""
    size = F.abs(w)
    guess = F.floor(F.log2(size)).cast("int")
    near = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    return F.when(size == 0, F.lit(0)).when((size < F.lit(2.0**LIMIT)) & (size >= F.lit(2.0**-LIMIT)), near)


def pieces(w: Column, e: Column) -> list[Column]:
    """A weight's terms of the partial sums, from its exponent."""
    up = F.pow(F.lit(2.0), -e)
    a, b = (w * up * F.lit(2.0**52)).cast("long"), (w * w * up * up * F.lit(2.0**52)).cast("long")
    low = F.lit((1 << BITS) - 1).cast("long")
    cut = lambda m: (F.shiftright(m, 2 * BITS), F.shiftright(m, BITS).bitwiseAND(low), m.bitwiseAND(low))
    return [*cut(a), *cut(b), F.when(e.isNull(), w), F.when(e.isNull(), w * w)]


def summed(w: str = "w", e: str = "e") -> list[Column]:
    """The aggregates of partial sums, of rows with columns for a weight and its exponent."""
    return [F.sum(x).alias(n) for n, x in zip(PIECES, pieces(F.col(w), F.col(e)), strict=True)]


def added() -> list[Column]:
    """The aggregates that add partial sums of one exponent."""
    return [F.sum(n).alias(n) for n in PIECES]


def gathered() -> Column:
    """The aggregate that brings a sum's exponents together: at most one row for each."""
    return F.sort_array(F.collect_list(F.struct("e", *PIECES)))


def _whole(x: Column, kind: str) -> Column:
    d = lambda n: x[f"{kind}{n}"].cast("decimal(20,0)")
    k = F.lit(1 << BITS).cast("decimal(6,0)")
    return (d(2) * k + d(1)) * k + d(0)


def _folded(parts: Column, kind: str, odd: str, times: int) -> Column:
    """The sum over exponents, from the least, with what rounding loses added at the end."""
    term = lambda x: _whole(x, kind).cast("double") * F.pow(F.lit(2.0), F.lit(times) * x["e"]) * F.lit(2.0**-52)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, v: Column) -> Column:
        s = acc["s"] + v
        lost = F.when(F.abs(acc["s"]) >= F.abs(v), (acc["s"] - s) + v).otherwise((v - s) + acc["s"])
        return F.struct(s.alias("s"), (acc["c"] + lost).alias("c"))

    known = F.filter(parts, lambda x: x["e"].isNotNull())
    beyond = F.aggregate(F.filter(parts, lambda x: x["e"].isNull()), F.lit(0.0), lambda acc, x: acc + F.coalesce(x[odd], F.lit(0.0)))
    return F.aggregate(F.transform(known, term), zero, step, lambda acc: acc["s"] + acc["c"]) + beyond


def totals(parts: Column) -> tuple[Column, Column]:
    """The sums of weights and of their squares, from ``gathered`` partial sums."""
    return _folded(parts, "a", "odd", 1), _folded(parts, "b", "odd2", 2)
