"""Bin flows: how a region's accepted events spread over its bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Plan, binned, weight_before
from .exactsum import PIECES, added, exponent, gathered, summed, totals


KEYS = ("region", "statement", "label", "slot")


def flow_parts(p: Plan) -> DataFrame:
    """Additive partial results: ``region, statement, label, slot, e, raw`` and pieces of sums."""
    rows = []
    for r, (low, region) in enumerate(p.analysis.regions.items()):
        for k, (s, b, e) in enumerate(binned(p, low)):
            slot = F.coalesce(b.cast("string"), F.lit("out")) if s.kind == "bins" else F.when(b == 1, F.lit("yes")).otherwise(F.lit("no"))
            f = F.lit(weight_before(region.steps, s)[0])
            rows.append(F.struct(F.lit(region.name).alias("region"), F.lit(k).alias("statement"), F.lit(s.label).alias("label"), F.col(f"_p{r}").alias("p"), F.when(e.isNotNull(), F.lit("failed")).otherwise(slot).alias("slot"), f.alias("f")))
    if not rows:
        return p.events.sparkSession.createDataFrame([], "region string, statement int, label string, slot string, e int, raw long, " + ", ".join(f"{n} {'double' if n.startswith('odd') else 'long'}" for n in PIECES))
    x = p.events.select(p.weight.alias("w"), F.inline(F.filter(F.array(*rows), lambda s: s["p"])))
    x = x.withColumn("w", F.col("w") * F.col("f")).withColumn("e", exponent(F.col("w")))
    return x.groupBy(*KEYS, "e").agg(F.count("*").alias("raw"), *summed())


def from_parts(parts: DataFrame) -> DataFrame:
    """``region, statement, label, slot, raw, sumw, sumw2`` of partial results, of one run or several batches."""
    x = parts.groupBy(*KEYS, "e").agg(F.sum("raw").alias("raw"), *added()).groupBy(*KEYS).agg(F.sum("raw").alias("raw"), gathered().alias("_parts"))
    sumw, sumw2 = totals(F.col("_parts"))
    return x.select(*KEYS, "raw", sumw.alias("sumw"), sumw2.alias("sumw2"))


def bin_flow(p: Plan) -> DataFrame:
    """``region, statement, label, slot, raw, sumw, sumw2``. Slots of a boundary statement are its
    bins ``0..``, ``out`` and ``failed``; of a boolean one ``yes``, ``no`` and ``failed``. Empty slots
    are left out."""
    return from_parts(flow_parts(p))
