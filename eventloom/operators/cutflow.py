"""Cutflows of all regions in one pass.

An event contributes one row for each region: how deep it got, and whether an error stopped it. These
combine on the map side into at most (cuts + 1) * 2 rows a region and exponent of weights, so the shuffle doesn't grow with
the events. Sums of weights are exact until the end, so they are equal bit by bit however the events are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Plan, error_of, weight_before
from .exactsum import PIECES, added, exponent, gathered, pieces, totals


def depths(p: Plan) -> DataFrame:
    """Additive partial results: ``region, depth, failed, e, n`` and pieces of sums (event weights only)."""
    rows = [F.struct(F.lit(low).alias("region"), F.col(f"_d{r}").alias("depth"), error_of(p, low).isNotNull().alias("failed")) for r, low in enumerate(p.analysis.regions)]
    x = p.events.withColumns({"_w": p.weight, "_we": exponent(p.weight)})
    x = x.select(F.col("_we").alias("e"), *[c.alias(n) for n, c in zip(PIECES, pieces(F.col("_w"), F.col("_we")), strict=True)], F.inline(F.array(*rows)))
    return x.groupBy("region", "depth", "failed", "e").agg(F.count("*").alias("n"), *added())


def from_depths(p: Plan, d: DataFrame) -> DataFrame:
    """``region, step, kind, label, raw, sumw, sumw2, errors, weighted_incomplete``; step 0 holds all events.
    Sums are taken over partial results, whose number depends on the file alone."""
    steps = []
    for low, region in p.analysis.regions.items():
        steps.append((low, region.name, 0, "all", "all events", 1.0, False))
        for k, s in enumerate(p.cuts(low), 1):
            w, part = weight_before(region.steps, s)
            steps.append((low, region.name, k, s.kind, s.label, w, part))
    known = d.sparkSession.createDataFrame(steps, "low string, region string, step int, kind string, label string, factor double, weighted_incomplete boolean")
    reached = d.select("region", "e", "n", *PIECES, F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("step")).groupBy("region", "step", "e").agg(F.sum("n").alias("n"), *added())
    reached = reached.groupBy("region", "step").agg(F.sum("n").alias("n"), gathered().alias("_parts"))
    sumw, sumw2 = totals(F.col("_parts"))
    reached = reached.select("region", "step", "n", sumw.alias("sumw"), sumw2.alias("sumw2"))
    failed = d.where("failed").groupBy("region", (F.col("depth") + 1).alias("step")).agg(F.sum("n").alias("errors"))
    x = known.join(reached.withColumnRenamed("region", "low"), ["low", "step"], "left").join(failed.withColumnRenamed("region", "low"), ["low", "step"], "left")
    f = F.col("factor")
    return x.select("region", "step", "kind", "label", F.coalesce("n", F.lit(0)).alias("raw"), F.coalesce(F.col("sumw") * f, F.lit(0.0)).alias("sumw"), F.coalesce(F.col("sumw2") * f * f, F.lit(0.0)).alias("sumw2"), F.coalesce("errors", F.lit(0)).alias("errors"), "weighted_incomplete")


def cutflow(p: Plan) -> DataFrame:
    return from_depths(p, depths(p))


def document(p: Plan, flow: list, bins: list) -> dict:
    """A plain dict of collected cutflow and bin flow rows: ``total`` of all events, and for each region its steps and
    bin statements, whose empty slots count 0."""
    counts = lambda r: {"raw": r["raw"], "sumw": r["sumw"], "sumw2": r["sumw2"]} if r is not None else {"raw": 0, "sumw": 0.0, "sumw2": 0.0}
    marked = lambda d, part: d | {"weighted_incomplete": True} if part else d
    steps = {(r["region"], r["step"]): r for r in flow}
    slots = {(r["region"], r["statement"], r["slot"]): r for r in bins}
    out = {"version": 1, "total": counts(next((r for r in flow if r["step"] == 0), None)), "regions": []}
    for region in p.analysis.regions.values():
        mine = [steps[region.name, k] for k in range(sum(r == region.name for r, _ in steps))]
        one = {"name": region.name, "steps": [marked({"kind": r["kind"], "label": r["label"], **counts(r), "errors": r["errors"]}, r["weighted_incomplete"]) for r in mine], "bins": []}
        for k, s in enumerate(x for x in region.steps if x.kind in ("bins", "bin")):
            slot = lambda name: slots.get((region.name, k, name))  # noqa: B023, E731
            failed = slot("failed")["raw"] if slot("failed") is not None else 0
            if s.kind == "bins":
                d = {"kind": "boundary", "label": s.label, "edges": list(s.edges), "bins": [counts(slot(str(i))) for i in range(len(s.edges))], "out": counts(slot("out")), "failed": failed}
            else:
                d = {"kind": "cond", "label": s.label, "true": counts(slot("yes")), "false": counts(slot("no")), "failed": failed}
            one["bins"].append(marked(d, weight_before(region.steps, s)[1]))
        out["regions"].append(one)
    return out
