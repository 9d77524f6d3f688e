"""Toy events for trying analyses out, made by executors: event k is the same at any number of events and partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How many objects an event has at most, and ranges of their properties.
JETS, LEPTONS = 6, 2
JET_PT, LEADING_PT, LEPTON_PT, MET_PT = (30.0, 400.0), (180.0, 600.0), (5.0, 150.0), (0.0, 500.0)
JET_ETA, LEPTON_ETA, PHI = 3.0, 2.5, 3.141
BOOSTED, TAGGED = 0.6, 0.4


def toy_events(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``event, jet, electron, muon, met``, sound by every check of a loader. Values are hashes of seed, event and place."""

    def draw(*place: str | Column) -> Column:
        """A number from 0 up to 1."""
        h = F.xxhash64(F.lit(seed), F.col("event"), *[F.lit(p) if isinstance(p, str) else p for p in place])
        return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))

    def within(lo: float, hi: float, *place: str | Column) -> Column:
        return F.round(lo + (hi - lo) * draw(*place), 3)

    def objects(kind: str, most: int, eta: float, pt: Column | None, span: tuple[float, float], *more) -> Column:
        number = F.floor(draw(kind) * (most + 1)).cast("int")
        places = F.slice(F.array(*[F.lit(i) for i in range(most)]), F.lit(1), number)
        first = lambda i, own: own if pt is None else F.when((i == 0) & (draw(kind, "boost") < BOOSTED), pt).otherwise(own)
        made = F.transform(places, lambda i: F.struct((-first(i, within(*span, "pt", kind, i))).alias("k"), within(-eta, eta, "eta", kind, i).alias("eta"), within(-PHI, PHI, "phi", kind, i).alias("phi"), *[f(i) for f in more]))
        return F.transform(F.sort_array(made), lambda x: F.struct((-x["k"]).alias("pt"), x["eta"].alias("eta"), x["phi"].alias("phi"), *([x["btag"].alias("btag")] if more else [])))

    tag = lambda i: (draw("btag", i) < TAGGED).cast("int").cast("double").alias("btag")
    met = F.struct(within(*MET_PT, "met").alias("pt"), within(-math.pi, math.pi, "met phi").alias("phi"))
    x = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).select(F.col("id").alias("event"))
    return x.select("event", objects("jet", JETS, JET_ETA, within(*LEADING_PT, "lead"), JET_PT, tag).alias("jet"), objects("electron", LEPTONS, LEPTON_ETA, None, LEPTON_PT).alias("electron"), objects("muon", LEPTONS, LEPTON_ETA, None, LEPTON_PT).alias("muon"), met.alias("met"))
