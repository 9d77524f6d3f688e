"""Which events each region accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Plan, binned, error_of
from .exactsum import exponent, gathered, summed, totals


def results(p: Plan, key: str = "event") -> DataFrame:
    """A row for each event: ``event`` and ``regions``, an array of ``region, pass`` (null where it fails
    with an error), ``error`` and ``bins`` (of an accepting region, by statement)."""
    rows = []
    for r, (low, region) in enumerate(p.analysis.regions.items()):
        e = error_of(p, low)
        bins = [F.struct(F.lit(s.label).alias("label"), k.alias("bin"), err.alias("error")) for s, k, err in binned(p, low)]
        none = F.array().cast("array<struct<label:string,bin:int,error:string>>")
        rows.append(F.struct(F.lit(region.name).alias("region"), F.when(e.isNull(), F.col(f"_p{r}")).alias("pass"), e.alias("error"), (F.when(F.col(f"_p{r}"), F.array(*bins).cast(none_type())).otherwise(none) if bins else none).alias("bins")))
    return p.events.select(F.col(key).alias("event"), F.array(*rows).alias("regions"))


def membership(p: Plan, key: str = "event") -> DataFrame:
    """``results`` as a row for each event and region."""
    return results(p, key).select("event", F.inline("regions"))


def none_type() -> str:
    return "array<struct<label:string,bin:int,error:string>>"


def accepted(p: Plan, region: str) -> DataFrame:
    """The events, with their own columns, that a region accepts."""
    r = p.index(region.lower())
    return p.events.where(F.col(f"_p{r}")).select(*[f.name for f in p.compiler.columns.values()])


def counts(p: Plan) -> DataFrame:
    """Accepted events of each region, with the sum of weights, in one pass."""
    rows = [F.struct(F.lit(region.name).alias("region"), F.col(f"_p{r}").alias("p"), error_of(p, low).isNotNull().alias("e")) for r, (low, region) in enumerate(p.analysis.regions.items())]
    x = p.events.withColumns({"_w": p.weight, "_we": exponent(p.weight)}).select("_w", "_we", F.inline(F.array(*rows)))
    x = x.select("region", "p", F.col("e").alias("failed"), F.when(F.col("p"), F.col("_w")).otherwise(0.0).alias("w"), F.when(F.col("p"), F.col("_we")).otherwise(0).alias("e"))
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    x = x.groupBy("region", "e").agg(n("p"), n("failed"), *summed()).groupBy("region").agg(n("p"), n("failed"), gathered().alias("_parts"))
    return x.select("region", F.col("p").alias("passed"), totals(F.col("_parts"))[0].alias("sumw"), F.col("failed").alias("errors"))
