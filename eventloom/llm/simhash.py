"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bit is the majority bit of the XXH64 hashes of the text's word
shingles. Two fingerprints that differ in at most 2 of 64 bits agree on at least 3 of 5
blocks, so each distinct fingerprint is keyed by its ten choices of three blocks; pairs
under a key are verified by Hamming distance. Copies of one fingerprint count once.

A key that more than ``PAIRS_UP_TO`` distinct fingerprints share makes no pairs. There the
members are keyed again by every fingerprint at distance 0 or 1 that keeps the shared
blocks: two members are within 2 bits exactly if they share such a key, so linking each
to the least member under it gives the same components with rows in proportion to the
members.

Null and empty texts, and texts without a word, have fingerprint zero and link like any
other; rows repeated with one doc_id each stay in the result; extra columns are ignored;
a null doc_id never names a component that has another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare, stored
from .components import components

BLOCKS = (13, 13, 13, 13, 12)
SAME = 3
DISTANCE = 2
PAIRS_UP_TO = 64
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    flat = memoryview(b" ".join(ws))
    n = max(1, len(ws) - size + 1)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    ends = ends[min(size, len(ws)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer, for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fps})

    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    out = kept.mapInPandas(run, "doc_id string, text_hash long, fp long")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text_hash", "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints (column ``fp``) that join all those
    within 2 bits: each edge is a true link, and all links lie within its components."""
    masks, at = [], 0
    for b in BLOCKS:
        masks.append(((1 << b) - 1) << at)
        at += b
    chosen = [sum(c) for c in combinations(masks, SAME)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    keyed = fps.select("fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("k", "part"))
    sizes = keyed.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["k", "part"]).select("k", "part", "fp", "n"), "blocks")

    few = shared.where(F.col("n") <= PAIRS_UP_TO).groupBy("k", "part").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    near = lambda a, m: F.transform(F.filter(m, lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)), lambda b: F.struct(a.alias("u"), b.alias("v")))
    pairs = few.select(F.explode(F.flatten(F.transform("m", lambda a: near(a, F.col("m"))))).alias("e")).select("e.u", "e.v")

    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    free = F.element_at(F.array([F.array([F.lit(bits[i]).cast("long") for i in range(64) if not m >> i & 1]) for m in chosen]), F.col("k") + 1)
    balls = shared.where(F.col("n") > PAIRS_UP_TO).select("k", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("flip"))
    balls = balls.select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("ball"))
    least = balls.groupBy("k", "ball").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u <> top").select("k", "ball", "u")
    stars = balls.join(least, ["k", "ball"]).where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` for every row: component_id is the smallest
    doc_id reachable over links, the row's own included."""
    fps = stored(fingerprints(docs), "fingerprints", 1000)
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp")))
    of = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    label = stored(of.join(ids, "root").select("fp", "component_id"), "labels")
    return fps.join(label, "fp").select("doc_id", "text_hash", "fp", "component_id")


def deduplicated(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """One document of each component, with all of its columns: the one with the least
    doc_id (of rows that share it the one with the least text hash, then any one copy).
    Documents without a doc_id form components by fingerprint alone and one stays."""
    seen = groups(docs)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    keep = seen.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min(first).alias("k"))
    # Equal keys on both sides, so that one exchange serves the join and what follows: texts move once.
    key = [spare(docs, k) for k in ("none", "id", "hash")]
    keyed = lambda i, h: [i.isNull().alias(key[0]), F.coalesce(i.cast("string"), F.lit("")).alias(key[1]), h.alias(key[2])]
    text = docs.select("*", *keyed(F.col("doc_id"), F.xxhash64("text")))
    return text.join(keep.select(*keyed(F.col("k.doc_id"), F.col("k.text_hash"))), key, "left_semi").dropDuplicates(key).select(*docs.columns)
