"""Histograms of all regions in one pass.

Each accepting region makes one row a histogram with the cell that the event falls in; rows
combine on the map side into at most one a cell, so what is shuffled is the histograms.
Contents and their errors (sumw, sumw2) are exact sums until the end, as in ``exactsum``; the moments of values are plain sums.
Uniform axes have cells 0 (under), 1..n, n+1 (over); the upper edge is over. A 2-D cell is
``x + (nx + 2) * y``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..language.model import Histo, Step
from ..plans.planner import Plan, weight_before
from .exactsum import PIECES, added, exponent, gathered, summed, totals

MOMENTS = ("sumw", "sumw2", "sumwx", "sumwx2", "sumwy", "sumwy2", "sumwxy")


def uniform(v: Column, n: int, lo: float, hi: float) -> Column:
    k = F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1).cast("long")) + 1
    return F.when(v < lo, F.lit(0).cast("long")).when(v >= hi, F.lit(n + 1).cast("long")).otherwise(k)


def by_edges(v: Column, edges: tuple[float, ...]) -> Column:
    e = F.array(*[F.lit(x) for x in edges])
    return F.size(F.filter(e, lambda x: x <= v)).cast("long")


def fills(p: Plan) -> list[tuple[str, Step, Histo]]:
    return [(low, s, s.histo) for low, r in p.analysis.regions.items() for s in r.steps if s.histo]


def cell_parts(p: Plan) -> DataFrame:
    """Additive partial results ``hist, cell, e, entries``, pieces of sums and moments; cell -1 counts non-values and -2 errors."""
    rows = []
    for k, (low, s, h) in enumerate(fills(p)):
        f = F.lit(weight_before(p.analysis.regions[low].steps, s)[0])
        p_ = F.col(f"_p{p.index(low)}")
        if h.kind == "bad":
            continue
        got = [p.compiler.number(e, {}) for e in h.exprs]
        values = [v for v, _ in got]
        errors = [e for _, e in got if e is not None]
        if h.kind == "h1":
            cell, y = uniform(values[0], *h.axes[0]), F.lit(None).cast("double")
            inside = (cell >= 1) & (cell <= h.axes[0][0])
        elif h.kind == "h1var":
            cell, y = by_edges(values[0], h.axes[0]), F.lit(None).cast("double")
            inside = (cell >= 1) & (cell < len(h.axes[0]))
        else:
            (nx, *_), (ny, *_) = h.axes
            cx, cy = uniform(values[0], *h.axes[0]), uniform(values[1], *h.axes[1])
            cell, y, inside = cx + (nx + 2) * cy, values[1], (cx >= 1) & (cx <= nx) & (cy >= 1) & (cy <= ny)
        missing = values[0].isNull() if len(values) == 1 else values[0].isNull() | values[1].isNull()
        cell = F.when(missing, F.lit(-1).cast("long")).otherwise(cell)
        if errors:
            cell = F.when(F.coalesce(*errors).isNotNull(), F.lit(-2).cast("long")).otherwise(cell)
        rows.append(F.struct(F.lit(k).alias("hist"), p_.alias("p"), cell.alias("cell"), f.alias("f"), F.when(inside, values[0]).alias("x"), F.when(inside, y).alias("y")))
    if not rows:
        return p.events.sparkSession.createDataFrame([], "hist int, cell long, e int, entries long, " + ", ".join(f"{n} {'double' if n.startswith('odd') else 'long'}" for n in PIECES) + ", " + ", ".join(f"{m} double" for m in MOMENTS[2:]))
    x = p.events.select(p.weight.alias("w"), F.inline(F.filter(F.array(*rows), lambda s: s["p"])))
    x = x.withColumn("w", F.col("w") * F.col("f")).withColumn("e", exponent(F.col("w")))
    w, u, v = F.col("w"), F.col("x"), F.col("y")
    sums = {"sumwx": w * u, "sumwx2": w * u * u, "sumwy": w * v, "sumwy2": w * v * v, "sumwxy": w * u * v}
    return x.groupBy("hist", "cell", "e").agg(F.count("*").alias("entries"), *summed(), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()])


def from_parts(parts: DataFrame) -> DataFrame:
    """``hist, cell, entries`` and moments of partial results, of one run or several batches."""
    rest = lambda: (F.sum("entries").alias("entries"), *[F.sum(m).alias(m) for m in MOMENTS[2:]])
    x = parts.groupBy("hist", "cell", "e").agg(*rest(), *added()).groupBy("hist", "cell").agg(*rest(), gathered().alias("_parts"))
    sumw, sumw2 = totals(F.col("_parts"))
    return x.select("hist", "cell", "entries", sumw.alias("sumw"), sumw2.alias("sumw2"), *MOMENTS[2:])


def cells(p: Plan) -> DataFrame:
    """``hist, cell, entries`` and moments; cell -1 counts non-values and -2 errors."""
    return from_parts(cell_parts(p))


def histograms(p: Plan) -> DataFrame:
    """``region, histogram, cell, entries`` and moments of every cell that was filled."""
    names = [(k, p.analysis.regions[low].name, h.name, h.kind) for k, (low, _, h) in enumerate(fills(p))]
    known = p.events.sparkSession.createDataFrame(names or [], "hist int, region string, histogram string, kind string")
    return cells(p).join(F.broadcast(known), "hist").drop("hist")


def documents(p: Plan, rows: list | None = None) -> list[dict]:
    """Each histogram as a plain dict (version 2 of the JSON form)."""
    got: dict[int, list] = {}
    for r in rows if rows is not None else cells(p).collect():
        got.setdefault(r["hist"], []).append(r)
    out = []
    for k, (low, s, h) in enumerate(fills(p)):
        d: dict = {"name": h.name, "title": h.title, "region": p.analysis.regions[low].name, "type": h.kind}
        if h.kind == "bad":
            out.append(d | {"unsupported": h.reason})
            continue
        mine = {r["cell"]: r for r in got.get(k, [])}
        kept = [r for c, r in mine.items() if c >= 0]
        total = lambda m, rs: math.fsum(r[m] for r in rs)
        if h.kind == "h2":
            (nx, xlo, xhi), (ny, ylo, yhi) = h.axes
            n = (nx + 2) * (ny + 2)
            inner = [r for c, r in mine.items() if c >= 0 and 1 <= c % (nx + 2) <= nx and 1 <= c // (nx + 2) <= ny]
            d |= {"nx": nx, "xlo": xlo, "xhi": xhi, "ny": ny, "ylo": ylo, "yhi": yhi} | {m: [mine[c][m] if c in mine else 0.0 for c in range(n)] for m in ("sumw", "sumw2")}
            d |= {f"t{m}": total(m, inner) for m in MOMENTS}
        else:
            n = h.axes[0][0] if h.kind == "h1" else len(h.axes[0]) - 1
            d |= dict(zip(("nbins", "lo", "hi"), h.axes[0], strict=True)) if h.kind == "h1" else {"nbins": n, "edges": list(h.axes[0])}
            inner = [r for c, r in mine.items() if 1 <= c <= n]
            d |= {m: [mine[c][m] if c in mine else 0.0 for c in range(1, n + 1)] for m in ("sumw", "sumw2")}
            d |= {"underflow": mine[0]["sumw"] if 0 in mine else 0.0, "overflow": mine[n + 1]["sumw"] if n + 1 in mine else 0.0} | {f"t{m}": total(m, inner) for m in MOMENTS[:4]}
        d |= {"entries": sum(r["entries"] for r in kept), "valueless": mine[-1]["entries"] if -1 in mine else 0, "errors": mine[-2]["entries"] if -2 in mine else 0, "weighted_incomplete": weight_before(p.analysis.regions[low].steps, s)[1]}
        out.append(d)
    return out
