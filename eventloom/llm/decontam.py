"""Benchmark decontamination by spaced seeds.

A token is a lower-cased run of letters or digits. A seed hashes the tokens at the kept
positions of a fixed mask, so a substituted token at an ignored position doesn't hide a
hit. Seeds of the documents meet those of the benchmark by hash; a hit fixes how the item
lies along the document, and the aligned tokens are compared: an overlap is a window of
``window`` tokens (the whole item if that is shorter) of which at least ``similarity``
agree.

Hashes of benchmark items are broadcast only if they are at most ``BROADCAST_SEEDS``
rows: then a document's tokens never leave its task, only the slice that a hit aligns with the item does, once for each
alignment. Else the join is shuffled by hash: seeds travel as hash, document and position, and the documents that have
an alignment send their tokens after these, once each. A hash that very many documents share is split by AQE's skew join.

An item shorter than ``MIN_TOKENS`` tokens is hashed whole, and where four fifths of it leave a
token free, also without each of its tokens in turn; documents get such seeds only of the
lengths that the benchmark has. So no overlap is missed at any length. ``decontaminated`` takes
items of fewer than ``EVIDENCE`` tokens for no evidence.

Null and empty texts have no tokens and no overlap. Repeated document or item rows give the
pair once, and so do several alignments: the best counts, of equal ones the first in the document.
An empty table gives an empty result; extra columns are ignored. A very long text has a
seed a position and mask, and is joined by them, never by pairs of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_at_most, spare

#: Kept positions of each mask: five tokens within seven, eight and six. Together they hit
#: whichever tokens of an item of ``MIN_TOKENS`` to 20, at most a fifth, are substituted.
MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 5, 7), (0, 1, 2, 4, 5))
MIN_TOKENS = 8
EVIDENCE = 5
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def masks_of(n: int) -> list[tuple[int, ...]]:
    """The kept positions that find an item of ``n`` < ``MIN_TOKENS`` tokens."""
    return [tuple(range(n))] if n < 5 else [tuple(k for k in range(n) if k != free) for free in range(n)]


def seeds(h: Column, mask: int, kept: tuple[int, ...]) -> Column:
    """The hash of each position's seed under a mask, whose first kept position is 0."""
    starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - kept[-1], F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(F.lit(mask), x, *[F.get(h, i + k) for k in kept[1:]]))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct alignments ``doc_id, item_id, diag, win``: token j of the item faces token
    diag + j of the document; win has those tokens' hashes from token max(diag, 0) on."""
    bench = items.select("item_id", hashed(F.col("text")).alias("ih")).withColumn("n", F.size("ih"))
    short = sorted(r["n"] for r in bench.where((F.col("n") > 0) & (F.col("n") < MIN_TOKENS)).select("n").distinct().collect())
    # A mask from its first kept position on; of a short item, with that position and the item's length.
    masks = [(kept, None, None) for kept in MASKS] + [(tuple(k - kept[0] for k in kept), kept[0], n) for n in short for kept in masks_of(n)]
    marks = None
    for m, (kept, at, n) in enumerate(masks):
        if n is None:
            one = bench.where(F.col("n") >= MIN_TOKENS).select("item_id", "n", F.lit(m).alias("mask"), F.posexplode(seeds(F.col("ih"), m, kept)).alias("at", "seed"))
        else:
            one = bench.where(F.col("n") == n).select("item_id", "n", F.lit(m).alias("mask"), F.lit(at).alias("at"), F.get(seeds(F.slice("ih", at + 1, n), m, kept), F.lit(0)).alias("seed"))
        marks = one if marks is None else marks.union(one)
    marks = marks.distinct()
    few = rows_at_most(marks, BROADCAST_SEEDS)

    # No filter on h or s, and an outer explode: a filter would be pushed below and tokenise anew.
    text = F.xxhash64("text").alias("k")  # with doc_id, names a text
    h = docs.select("doc_id", text, hashed(F.col("text")).alias("h"))
    h = h.select("doc_id", "k", "h", F.size("h").alias("len"), F.concat(*[seeds(F.col("h"), m, kept) for m, (kept, _, _) in enumerate(masks)]).alias("s"))
    start, first = F.lit(0), F.lit(0)  # where a mask's seeds begin among those of all
    for m in range(1, len(masks)):
        first = first + F.greatest(F.col("len") - masks[m - 1][0][-1], F.lit(0))
        start = F.when(F.col("mask") == m, first).otherwise(start)
    diag = (F.col("p") - start - F.col("at")).cast("int").alias("diag")
    if few:
        found = h.select("doc_id", "h", "len", F.posexplode_outer("s").alias("p", "seed")).join(F.broadcast(marks), "seed").select("doc_id", "h", "len", "item_id", "n", diag)
    else:
        at = h.select("doc_id", "k", "len", F.posexplode_outer("s").alias("p", "seed")).join(marks, "seed").select("doc_id", "k", "item_id", "n", diag).distinct()
        tokens_ = docs.select(F.col("doc_id").alias("_id"), text.alias("_k"), hashed(F.col("text")).alias("h")).select("_id", "_k", "h", F.size("h").alias("len"))
        found = at.join(tokens_.hint("merge"), (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    from_ = F.greatest(F.col("diag"), F.lit(0))
    win = F.slice("h", from_ + 1, F.least(F.col("n") + F.least(F.col("diag"), F.lit(0)), F.col("len") - from_))
    return found.select("doc_id", "item_id", "diag", win.alias("win")).distinct()


def overlaps(docs: DataFrame, items: DataFrame, similarity: float = 0.8, window: int = 20) -> DataFrame:
    """One row for each document and item that overlap: ``doc_id, item_id, item_words,
    n_equal`` (tokens that agree along the best alignment), ``best`` (the largest share
    that agrees in a window), ``doc_start`` (the document token that faces the item's
    first, of the best alignment) and ``contaminated`` (true)."""
    bench = items.select("item_id", hashed(F.col("text")).alias("ih")).where(F.size("ih") > 0).distinct()
    if rows_at_most(bench, BROADCAST_SEEDS // 100):
        bench = F.broadcast(bench)
    x = hits(docs, items).join(bench, "item_id")
    m = F.size("ih")
    skip = F.greatest(-F.col("diag"), F.lit(0))
    agree = F.transform("win", lambda w, j: (w == F.get(F.col("ih"), j + skip)).cast("int"))
    x = x.select("doc_id", "item_id", "diag", m.alias("m"), agree.alias("a"), F.least(m, F.lit(window)).alias("w"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    spans = F.sequence(F.lit(0), F.greatest(F.size("a") - F.col("w"), F.lit(0)))
    best = F.array_max(F.transform(spans, lambda i: total(F.slice(F.col("a"), i + 1, F.col("w")))))
    x = x.select("doc_id", "item_id", "diag", "m", total(F.col("a")).alias("n_equal"), (best / F.col("w")).alias("best"))
    top = F.max(F.struct("best", "n_equal", (-F.col("diag")).alias("d"), "m")).alias("t")
    x = x.groupBy("doc_id", "item_id").agg(top).where(F.col("t.best") >= similarity)
    return x.select("doc_id", "item_id", F.col("t.m").cast("long").alias("item_words"), F.col("t.n_equal").cast("long").alias("n_equal"), F.col("t.best").alias("best"), (-F.col("t.d")).cast("long").alias("doc_start"), F.lit(True).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """The documents, all columns and rows, that overlap no item of ``evidence`` tokens or more. A
    null doc_id is judged like any other value."""
    name = spare(docs, "hit")
    hit = overlaps(docs, items).where(F.col("item_words") >= evidence).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
