"""Running sums over an integer key, by levels of windows of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _levels(spread: int, width: int) -> int:
    """How often a key's range is divided by the width until one chunk holds it."""
    n = 0
    while spread > 0:
        spread, n = spread // width, n + 1
    return n


def prefix_sums(df: DataFrame, key: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows with a lesser ``key``, which is an integer; null keys get null.
    Rows with equal keys get the same sum.

    Rows are summed by chunks of ``width`` keys, chunks by chunks of chunks, and so on; within each a window adds up what comes
    before. So no task orders more keys than ``width`` at once, however many rows there are, and the levels above the first
    have a ``width``-th of the rows each. The number of levels comes from the keys' range, which is read first."""
    r = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if r["a"] is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    names = {c.lower() for c in df.columns} | {out.lower()}
    fresh = lambda n: n if n not in names else fresh(n + "_")
    chunk, own = fresh("chunk"), fresh("own")
    base = F.col(key).cast("long") - F.lit(r["a"])
    by_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).cast("long").alias(own))
    before = _before(by_key.select(key, base.alias(chunk), own), chunk, own, _levels(r["b"] - r["a"], width), width)
    return df.join(before.select(key, F.col("_before").alias(out)), key, "left")


def _before(x: DataFrame, at: str, own: str, levels: int, width: int) -> DataFrame:
    """Rows of distinct places with ``_before``, the sum of what is at lesser ones."""
    up = F.floor(F.col(at) / width).cast("long")
    w = Window.partitionBy("_up").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_up", up).withColumn("_in", F.coalesce(F.sum(own).over(w), F.lit(0).cast("long")))
    if levels <= 1:
        return x.withColumn("_before", F.col("_in")).drop("_up", "_in")
    above = _before(x.groupBy("_up").agg(F.sum(own).alias("_own")).withColumnRenamed("_up", "_place"), "_place", "_own", levels - 1, width)
    above = above.select(F.col("_place").alias("_up"), F.col("_before").alias("_above"))
    return x.join(above, "_up").withColumn("_before", F.col("_in") + F.col("_above")).drop("_up", "_in", "_above")
