"""Events at the edge of cuts: what a region says just below, at and just above each constant.

A relation between regions that holds in a sample may still break where a value lies exactly on a cut. Every event of a
table explodes to copies in which one value that a cut compares with a constant is the constant, or the double beside it; the regions
are evaluated over all copies in one pass, and folded to a few counts a cut. Copies that the loader would refuse (a jet
that no longer falls in pt, a negative pt) are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..language.model import Analysis, walk
from ..plans.planner import CUTS, error_of, plan
from ..sources.validate import load_error

SIDES = ("below", "at", "above")


def spare(events: DataFrame, name: str) -> str:
    have = {c.lower() for c in events.columns}
    while name in have:
        name += "_"
    return name


def cut_points(a: Analysis) -> list[tuple[tuple, float]]:
    """The values that cuts compare with a constant, with these: missing momentum, event scalars and properties of single
    elements of base collections. Elements of derived collections have no value of their own to set."""
    found: dict[tuple[tuple, float], None] = {}
    for r in a.regions.values():
        for s in r.steps:
            for n in walk(s.node or ()) if s.kind in CUTS else ():
                sides = [(n[2], n[3]), (n[3], n[2])] if n[0] == "cmp" else [(n[2], n[3]), (n[2], n[4])] if n[0] == "band" else []
                for value, constant in sides:
                    if constant[0] == "num" and (value[0] in ("met_prop", "scalar") or value[0] == "prop" and value[1][0] == "elem" and value[1][1][0] == "base" and value[1][2] >= 0):
                        found[value, float(constant[1])] = None
    return list(found)


def written(value: tuple) -> str:
    if value[0] == "prop":
        return f"{value[1][1][1]}[{value[1][2]}].{value[2]}"
    return value[1] if value[0] == "scalar" else f"met.{value[1]}"


def _column(events: DataFrame, value: tuple) -> str:
    name = "met" if value[0] == "met_prop" else value[1] if value[0] == "scalar" else value[1][1][1]
    return next((f.name for f in events.schema.fields if f.name.lower() == name), "")


def _field(events: DataFrame, column: str, prop: str) -> str | None:
    kind = events.schema[column].dataType
    fields = getattr(getattr(kind, "elementType", kind), "fields", [])
    return next((f.name for f in fields if f.name.lower() == prop), None)


def _there(events: DataFrame, value: tuple) -> Column | None:
    """Whether an event has the value; None where no event can."""
    c = _column(events, value)
    if not c or value[0] == "scalar":
        return F.col(c).isNotNull() if c else None
    prop = value[1] if value[0] == "met_prop" else value[2]
    if (f := _field(events, c, prop)) is None:
        return F.col(c).isNotNull() if value == ("met_prop", "pt") else None
    return (F.col(c)[f] if value[0] == "met_prop" else F.get(F.col(c), value[1][2])[f]).isNotNull()


def _set(events: DataFrame, value: tuple, to: Column) -> Column:
    c = _column(events, value)
    if value[0] == "scalar":
        return to.cast(events.schema[c].dataType)
    prop = value[1] if value[0] == "met_prop" else value[2]
    f = _field(events, c, prop)
    if value[0] == "met_prop":
        return F.col(c).withField(f, to) if f else to
    return F.transform(F.col(c), lambda x, i: F.when(i == value[1][2], x.withField(f, to)).otherwise(x))


def _part(events: DataFrame, value: tuple) -> tuple[str, str | None]:
    """What a copy changes: a column, of a collection one property."""
    return _column(events, value), _field(events, _column(events, value), value[2]) if value[0] == "prop" else None


def _parts(schema: T.StructType) -> dict[tuple[str, str | None], Column]:
    """The loader's check by columns, that of collections by properties, no two of which it reads together."""
    found = {}
    for f in schema.fields:
        kind = f.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found |= {(f.name, p.name): load_error(T.StructType([T.StructField(f.name, T.ArrayType(T.StructType([p])))])) for p in kind.elementType.fields}
        else:
            found[f.name, None] = load_error(T.StructType([f]))
    return found


def copies(a: Analysis, events: DataFrame) -> tuple[DataFrame, list[tuple[tuple, float]]]:
    """The events' copies, with ``_cut`` (a number) and ``_side``, and the cuts that these name."""
    points = [(v, k) for v, k in cut_points(a) if _there(events, v) is not None]
    beside = lambda k: (math.nextafter(k, -math.inf), k, math.nextafter(k, math.inf))
    # A copy is sound if what it keeps of its event is, which is checked once an event, and if what it changes is.
    parts, changes = _parts(events.schema), {i: _part(events, v) for i, (v, _) in enumerate(points)}
    own = {p: spare(events, f"_b{k}") for k, p in enumerate(dict.fromkeys(changes.values()))}
    rest = [e.isNotNull().cast("int") for p, e in parts.items() if p not in own]
    bad = spare(events, "_bad")
    kept = lambda i: F.col(bad) + sum((F.col(b) for p, b in own.items() if p != changes[i]), F.lit(0)) == 0
    marks = [F.when(_there(events, v) & kept(i), F.struct(F.lit(i).alias("cut"), F.lit(side).alias("side"), F.lit(x).alias("x"))) for i, (v, k) in enumerate(points) for side, x in zip(SIDES, beside(k), strict=True)]
    if not marks:
        return events.limit(0).withColumns({"_cut": F.lit(0), "_side": F.lit("")}), []
    x = events.withColumns({bad: sum(rest, F.lit(0)), **{b: parts[p].isNotNull().cast("int") for p, b in own.items()}})
    x = x.withColumn("_m", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    changed: dict[str, Column] = {}
    for i, (v, _) in enumerate(points):
        c = _column(events, v)
        changed[c] = F.when(F.col("_m.cut") == i, _set(events, v, F.col("_m.x"))).otherwise(changed.get(c, F.col(c)))
    x = x.withColumns({**changed, "_cut": F.col("_m.cut"), "_side": F.col("_m.side")}).drop("_m", bad, *own.values())
    unsound = F.lit(False)
    for p in own:
        unsound = F.when(F.col("_cut").isin([i for i, q in changes.items() if q == p]), parts[p].isNotNull()).otherwise(unsound)
    return x.where(~unsound), points


def boundary_flips(a: Analysis, events: DataFrame) -> DataFrame:
    """``cut, region, n, below, at, above``: for each cut and region, how many events have sound copies at the cut, and how many of
    their copies below, at and above it the region accepts. One pass over the copies; what is shuffled is counts."""
    x, points = copies(a, events)
    p = plan(a, x)
    passed = lambda k, low: F.col(f"_p{k}") & error_of(p, low).isNull()
    sides = [F.count_if((F.col("_side") == s) & passed(k, low)).alias(f"{s}{k}") for k, low in enumerate(a.regions) for s in SIDES]
    y = p.events.groupBy("_cut").agg(F.count_if(F.col("_side") == "at").alias("n"), *sides)
    rows = [F.struct(F.lit(r.name).alias("region"), *[F.col(f"{s}{k}").alias(s) for s in SIDES]) for k, r in enumerate(a.regions.values())]
    y = y.select("_cut", "n", F.inline(F.array(*rows)))
    label = F.array(*[F.lit(f"{written(v)} {k:g}") for v, k in points]) if points else F.array(F.lit(""))
    return y.select(F.get(label, F.col("_cut")).alias("cut"), "region", "n", *SIDES)
