"""Connected components by alternating large-star and small-star rounds.

Edges stay in DataFrames throughout; a round is a few grouped minima and joins, and
its result is written to the shared folder. Rounds needed grow with the logarithm of
a component's size; stars need none, and no round is run to see that nothing changes. The minima combine on the map side, and the joins back to them have one row per
node on one side, so the rows of a hub can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PATHS, discard, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, root)``, root the least node of the component, for every
    node that has an edge to another. Repeated edges and loops are allowed; an empty
    table of edges gives an empty result. ``discard`` deletes its table; those of earlier rounds go with each round."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        old, e = e, stored(_small(_large(e)), "edges")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
    PATHS[out] = PATHS.pop(e)
    return out


def _large(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows."""
    both = e.union(e.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    up = both.where("v > u").select("u", F.col("v").alias("w"))
    return up.join(least, "u").select(F.col("w").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether each node has one edge down at most and none leads on from where it ends. No edge joins two such stars, so each
    is a whole component; as every edge leads down, its end is the least node."""
    ends = e.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down + up > 1").isEmpty()
