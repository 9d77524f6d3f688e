"""Mixing sources to target weights.

Each source's words are packed, document after document, into blocks of a fixed number of
words. Output shards draw multinomial counts of blocks for each source; slot k of a source
maps through pseudorandom permutations of that source's block indices (a new one for each
pass over the source), and blocks join slots by index.

Totals are settled exactly: where the draws of a source exceed its quota, a pseudorandom
subset of its slots, of the size of the excess, goes to sources that were drawn short. So
every source gets its quota, no block is used more than once more than another, and
since a target is at most twice a source's size no document is used more than twice.

Packing runs in groups of about ``GROUP`` documents of one source, so a source that holds
a third of all rows is packed by many tasks. The table of sources is collected: a mixture
names its sources, of which there may be ``MAX_SOURCES``, else it raises. Draws depend only on
``seed``, shard and source, so reruns agree.

Null sources form a source of their own, null and empty texts have no words and are never
taken, repeated rows count each (of rows that tie in every column either may be the one that is
taken more often), extra columns are ignored, an empty table gives an empty result. A very long
text spans many blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, rows_at_most, stored, words

BLOCK = 128
SHARD = 8192
GROUP = 4000
MAX_SOURCES = 100_000
WEIGHTS = (3, 1, 2)
BROADCAST_GROUPS = 1_000_000
#: Texts and MB of them that a Python worker gets at once.
ROWS, BATCH_MB = 500, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to weights that sum to ``share`` of all sizes, none above
    ``most`` times its size; what is cut off is shared again by weight."""
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 at x, elementwise: a four-round Feistel network over the
    next even power of two, walked until it lands below n."""
    n = n.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), x.astype(np.uint64), np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
            a, b = out[todo] >> h, out[todo] & m
            for r in range(4):
                f = (b + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k
                f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                a, b = b, a ^ ((f ^ (f >> np.uint64(31))) & m)
            out[todo] = (a << h) | b
            todo = out >= n
    return out.astype(np.int64)


def _key(seed: int, *parts: object) -> int:
    return xxhash.xxh64_intdigest(repr((seed, *parts)).encode("utf-8", "surrogatepass"))


def packed(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Column]:
    """Documents with their size, pack group and first word's place in the group; the
    groups with the index that their first block has within their source; and a document's group."""
    n, h = F.size(words(F.col("text"))).cast("long"), F.xxhash64("doc_id", "text")
    sized = stored(docs.select("doc_id", "source", n.alias("size"), h.alias("h")), "sizes")
    groups = max(1, -(-sized.count() // GROUP))
    g = F.pmod(F.col("h"), F.lit(groups)).alias("grp")
    w = Window.partitionBy("source", "grp").orderBy("doc_id", "h", "size")
    placed = sized.select("doc_id", "source", "size", "h", g).select("*", F.row_number().over(w).alias("rn"), (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    placed = stored(placed.drop("h"), "packed")
    per = placed.groupBy("source", "grp").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    per = per.withColumn("blocks", F.ceil(F.col("words") / block))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    return placed, stored(per.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "groups"), F.pmod(h, F.lit(groups))


def targets(groups: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[dict]:
    """For each source, nulls last, its size, number of blocks, weight (``weights`` repeat) and target."""
    rows = groups.groupBy("source").agg(F.sum("words").alias("size"), F.sum("blocks").alias("blocks")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    w = [float(weights[i % len(weights)]) for i in range(len(rows))]
    return [{"sid": i, "source": r["source"], "size": r["size"], "blocks": r["blocks"], "weight": w[i], "target": t} for i, (r, t) in enumerate(zip(rows, water_fill(sizes, w, share, most), strict=True))]


def slots(spark, plan: list[dict], seed: int = 0, shard: int = SHARD) -> DataFrame:
    """``shard, slot, sid, block``: which block of which source stands in each slot."""
    blocks = np.array([p["blocks"] for p in plan], np.int64)
    size, target = np.array([p["size"] for p in plan], float), np.array([p["target"] for p in plan])
    quota = np.where(size > 0, np.rint(target / np.maximum(size, 1) * blocks), 0).astype(np.int64)
    quota = np.minimum(quota, 2 * blocks)
    total = int(quota.sum())
    schema = "shard long, slot int, sid int, block long"
    if not total:
        return spark.createDataFrame([], schema)
    p, shards = quota / total, -(-total // shard)
    length = lambda s: min(shard, total - s * shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                got = np.random.default_rng(_key(seed, "draw", int(s))).multinomial(length(int(s)), p)
                at = np.nonzero(got)[0]
                yield pd.DataFrame({"shard": int(s), "sid": at.astype(np.int32), "n": got[at], "place": np.cumsum(got)[at] - got[at]})

    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    drawn = stored(spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, sid int, n long, place long"), "draws")
    w = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    got = np.zeros(len(plan), np.int64)
    for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect():
        got[r["sid"]] = r["n"]
    over, short = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    over_at, short_ends = np.cumsum(over) - over, np.cumsum(short)
    keys = np.array([_key(seed, "settle", i) for i in range(len(plan))], np.uint64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, sid, n, at, before in b[["shard", "sid", "n", "place", "before"]].itertuples(index=False):
                k = permute(before + np.arange(n), np.full(n, got[sid]), np.full(n, keys[sid]))
                src = np.full(n, sid)
                if over[sid]:
                    late = k >= quota[sid]
                    e = over_at[sid] + k[late] - quota[sid]
                    to = np.searchsorted(short_ends, e, "right")
                    src[late], k[late] = to, got[to] + e - (short_ends[to] - short[to])
                turn, index = k // blocks[src], k % blocks[src]
                by = np.array([_key(seed, "pass", int(i), int(t)) for i, t in zip(*np.unique(np.stack([src, turn]), axis=1), strict=True)], np.uint64)
                inv = np.unique(np.stack([src, turn]), axis=1, return_inverse=True)[1].ravel()
                m = length(int(s))
                slot = permute(at + np.arange(n), np.full(n, m), np.full(n, _key(seed, "slot", int(s)), np.uint64))
                yield pd.DataFrame({"shard": s, "slot": slot.astype(np.int32), "sid": src.astype(np.int32), "block": permute(index, blocks[src], by[inv])})

    # A row of the draws becomes hundreds of slots, so the rows are dealt out however few they are.
    return drawn.repartition(tasks, "shard").mapInPandas(place, schema)


def mix(docs: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The mix as segments ``shard, slot, source, block, grp, rn, doc_id, from_word, n_words``
    (a block's segments, by from_word's document order, are its words), the placed documents, and the plan
    of sources."""
    spark = docs.sparkSession
    placed, groups, _ = packed(docs, block)
    plan = targets(groups)
    ids = spark.createDataFrame([(p["sid"], p["source"]) for p in plan], "sid int, source string")
    taken = slots(spark, plan, seed, shard)
    end = F.col("start") + F.col("size")
    d = placed.where("size > 0").join(groups.select("source", "grp", "first"), placed.source.eqNullSafe(groups.source) & (placed.grp == groups.grp)).select(placed.source, placed.grp, "rn", "doc_id", "size", "start", "first")
    d = d.join(F.broadcast(ids), d.source.eqNullSafe(ids.source)).select("sid", d.source, "grp", "rn", "doc_id", "size", "start", "first")
    d = d.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    lo, hi = F.greatest("start", F.col("b") * block), F.least(end, (F.col("b") + 1) * block)
    seg = d.select("sid", "source", (F.col("first") + F.col("b")).alias("block"), "grp", "rn", "doc_id", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"))
    # Spark takes slots for as small as the draws they come from, and would broadcast them.
    return taken.hint("merge").join(seg, ["sid", "block"]).drop("sid"), placed, plan


def _assembled(block: int):
    """Blocks of a group's words, from its documents in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ids, b = None, [], [], 0
        for batch in batches:
            out = []
            for source, grp, i, text in batch[["source", "grp", "doc_id", "text"]].itertuples(index=False):
                if at != (source, grp):
                    if held:
                        out.append((*at, b, ids, " ".join(held)))
                    at, held, ids, b = (source, grp), [], [], 0
                ws, k = WORD.findall(text), 0
                while k < len(ws):
                    take = min(block - len(held), len(ws) - k)
                    held += ws[k : k + take]
                    ids.append(i)
                    k += take
                    if len(held) == block:
                        out.append((*at, b, ids, " ".join(held)))
                        held, ids, b = [], [], b + 1
            yield pd.DataFrame(out, columns=["source", "grp", "b", "doc_ids", "text"])
        if held:
            yield pd.DataFrame([(*at, b, ids, " ".join(held))], columns=["source", "grp", "b", "doc_ids", "text"])
        give_back()

    return run


def shards(docs: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix itself: ``shard, slot, source, doc_ids, text``, the block of words that stands in each
    slot of each output shard and the documents that it is from, in order. Texts move to their pack group, and
    finished blocks to the slots that hold them."""
    spark = docs.sparkSession
    _, groups, group = packed(docs, block)
    plan = targets(groups)
    ids = F.broadcast(spark.createDataFrame([(p["sid"], p["source"]) for p in plan], "sid int, of string"))
    # The order within a group is that of packed(); rows that tie there are equal.
    texts = docs.where(F.col("text").isNotNull()).select(F.col("source").cast("string").alias("source"), group.alias("grp"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").alias("o"))
    texts = texts.repartition("source", "grp").sortWithinPartitions("source", "grp", "o", "h").drop("o", "h")
    made = stored(texts.mapInPandas(_assembled(block), "source string, grp long, b long, doc_ids array<string>, text string"), "blocks", ROWS, BATCH_MB)
    first = groups.join(ids, F.col("source").eqNullSafe(F.col("of"))).select("sid", "grp", "first")
    if rows_at_most(first, BROADCAST_GROUPS):
        first = F.broadcast(first)
    made = made.join(ids, F.col("source").eqNullSafe(F.col("of"))).join(first, ["sid", "grp"])
    made = made.select("sid", (F.col("first") + F.col("b")).alias("block"), "source", F.col("doc_ids").cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>").alias("doc_ids"), "text")
    return slots(spark, plan, seed, shard).hint("merge").join(made, ["sid", "block"]).select("shard", "slot", "source", "doc_ids", "text")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    segments, placed, plan = mix(docs, seed)
    spark = docs.sparkSession
    took = segments.groupBy("source", "grp", "rn").agg(F.sum("n_words").alias("taken"))
    took = took.select(F.col("source").alias("_s"), F.col("grp").alias("_g"), F.col("rn").alias("_r"), "taken")
    x = placed.join(took, placed.source.eqNullSafe(took._s) & (placed.grp == took._g) & (placed.rn == took._r), "left")
    by = spark.createDataFrame([(p["source"], int(p["size"]), float(p["target"])) for p in plan], "_source string, source_size long, target double")
    x = x.join(F.broadcast(by), x.source.eqNullSafe(by._source))
    return x.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def planned(docs: DataFrame) -> DataFrame:
    """``source, size, weight, target`` of every source."""
    rows = [(p["source"], int(p["size"]), float(p["weight"]), round(float(p["target"]), 4)) for p in targets(packed(docs)[1])]
    return docs.sparkSession.createDataFrame(rows, "source string, size long, weight double, target double")


#: Sizes and targets for DuckDB; a round caps all sources that are above their limit.
TARGET_ORACLE = r"""
with recursive s as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as size from documents group by 1),
w as (select source, size::double as size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, 1.5 * sum(size) over () as all_ from s),
t as (select 0 as k, source, size, weight, all_, false as capped from w
      union all
      select k + 1, source, size, weight, all_, capped or coalesce((all_ - sum(case when capped then 2 * size else 0 end) over ()) * weight / nullif(sum(case when capped then 0 else weight end) over (), 0) > 2 * size, false) from t where k < 60)
select source, size::bigint as size, weight, round(case when capped then 2 * size else (all_ - sum(case when capped then 2 * size else 0 end) over ()) * weight / nullif(sum(case when capped then 0 else weight end) over (), 0) end, 4) as target
from t where k = 60
"""
