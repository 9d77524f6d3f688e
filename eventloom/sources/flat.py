"""Flat leaves and their counters, cut into one list an event.

A columnar file may hold a collection as a counter (how many objects an event has) and one long column a leaf, with all events'
objects end to end. The counters say where an event's objects begin: their running sum. Values are packed into blocks of
consecutive positions, an event is sent to the blocks that its range touches, and its list is sliced out of them.
What is shuffled is the values, once, as whole blocks, and the counters; only events that lie across a block's end meet again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sums

BLOCK = 4096


class CounterError(ValueError):
    """Counters and leaves that disagree. Nothing is guessed or dropped."""


def _check(counts: DataFrame, leaves: dict[str, DataFrame], entry: str, n: str) -> int:
    c = counts.agg(F.sum(n).alias("total"), F.min(F.when((F.col(n) < 0) | F.col(n).isNull(), F.col(entry))).alias("bad"), F.count("*").alias("rows"), F.count_distinct(entry).alias("entries")).first()
    if c["bad"] is not None:
        raise CounterError(f"the counter of entry {c['bad']} is missing or negative")
    if c["rows"] != c["entries"]:
        raise CounterError("an entry has two counters, or none has a number")
    total = c["total"] or 0
    for name, leaf in leaves.items():
        got = leaf.agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"), F.count("position").alias("k")).first()
        if got["n"] != total:
            raise CounterError(f"leaf {name} has {got['n']} values where its counters say {total}")
        if total and (got["k"] != total or got["a"] != 0 or got["b"] != total - 1):
            raise CounterError(f"leaf {name} has positions from {got['a']} to {got['b']}, not from 0 to {total - 1}")
    return total


def rechunked(counts: DataFrame, leaves: dict[str, DataFrame], entry: str = "entry", n: str = "n", block: int = BLOCK) -> DataFrame:
    """``entry, start, n`` and an array for each leaf, an event a row. ``counts`` has an integer ``entry``, in whose order
    events come, and its counter; each leaf has ``position`` (0, 1, .. over all events) and ``value``. Counters that are
    negative or missing, leaves of another length than the counters' sum, and positions that are missing or there twice raise.

    An event of no objects has empty lists. An event of very many is cut over its blocks and put together again, so its
    list is what one row holds at last. Empty tables give an empty result; columns but those named are ignored."""
    total = _check(counts, leaves, entry, n)
    x = prefix_sums(counts.select(F.col(entry).alias("entry"), F.col(n).cast("long").alias("n")), "entry", F.col("n"), "start")
    width = F.lit(block)
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width)
    touched = x.where("n > 0").select("entry", "start", "n", F.explode(F.sequence(first, last)).alias("b"))
    touched = touched.withColumn("lo", F.greatest("start", F.col("b") * width)).withColumn("hi", F.least(F.col("start") + F.col("n"), (F.col("b") + 1) * width))
    names = [f"_l{k}" for k in range(len(leaves))]
    blocks = None
    for name, leaf in zip(names, leaves.values(), strict=True):
        packed = leaf.select(F.col("position").cast("long").alias("p"), "value").groupBy(F.floor(F.col("p") / width).alias("b")).agg(F.array_sort(F.collect_list(F.struct("p", "value"))).alias("a"))
        right = F.least(width.cast("long"), F.lit(total) - F.col("b") * width)
        sound = (F.size("a") == right) & (F.size(F.array_distinct(F.transform("a", lambda e: e["p"]))) == right)
        said = F.raise_error(F.concat(F.lit("positions are missing or there twice in block "), F.col("b").cast("string")))
        packed = packed.select("b", F.when(sound, F.transform("a", lambda e: e["value"])).otherwise(said).alias(name))
        blocks = packed if blocks is None else blocks.join(packed, "b", "full")
    # Blocks meet each other first, then events: lists are sliced where a block is met, so no block is copied beside each event.
    if blocks is not None:
        touched = touched.join(blocks, "b", "left")
    cut = lambda c: F.slice(c, (F.col("lo") - F.col("b") * width + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias(c)
    parts = touched.select("entry", "start", "n", "b", *map(cut, names), (F.col("hi") - F.col("lo") == F.col("n")).alias("whole"))
    across = parts.where("not whole").groupBy("entry", "start", "n").agg(F.array_sort(F.collect_list(F.struct("b", *names))).alias("a"))
    across = across.select("entry", "start", "n", *[F.flatten(F.col(f"a.{c}")).alias(c) for c in names])
    kind = {c: leaf.schema["value"].dataType.simpleString() for c, leaf in zip(names, leaves.values(), strict=True)}
    none = x.where("n = 0").select("entry", "start", "n", *[F.array().cast(f"array<{kind[c]}>").alias(c) for c in names])
    out = parts.where("whole").select("entry", "start", "n", *names).unionByName(across).unionByName(none)
    return out.select("entry", "start", "n", *[F.col(c).alias(name) for c, name in zip(names, leaves, strict=True)])
