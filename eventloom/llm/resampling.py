"""Importance resampling of raw documents toward a target distribution of hashed n-grams.

The raw documents become a sparse matrix of documents by buckets, stored once as blocks in compressed sparse
row form: a row of the stored table is one block, with its documents' ids and lengths, ``indptr``, ``indices`` and
``counts``. Column sums of the raw and the target matrix give two smoothed bucket distributions, whose log ratio in
thousandths is a bucket's gain; the product of the matrix with the gains gives every document's weight. Adding
Gumbel noise from a keyed hash of the id and taking the highest scores draws without replacement in proportion to
the exponentiated weights.

What grows: the matrix, with the documents. A block holds at most ``BLOCK_DOCS`` documents, and at most ``BLOCK_CELLS``
cells beyond its last document, whose cells are at most the buckets; a task writes and reads a few MB of blocks at once
(``GROUP``), however many documents it has. Both column sums and gains have an entry a
bucket. A task sends each bucket once. Ranks come from one range partitioning of what can be drawn (an id and
two numbers a document), so no task sees them all; a text is tokenised in pieces of ``PIECE`` words.

Null and empty texts have no words, weight 0, and are never drawn. A null doc_id counts as the empty string in the
hash and comes last among ties. Repeated rows are documents of their own; where they tie, any of them may be
the one drawn. Empty tables give empty results, an empty target a flat target distribution. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, give_back, stored

BUCKETS = 10_000
MIN_WORDS = 20
RATE = 10
SEED = 2024
BLOCK_DOCS, BLOCK_CELLS = 256, 1 << 16
PIECE = 1 << 18
KNOWN = 1 << 16
#: Parquet's row groups of blocks: their encoded bytes (a sixth of those in memory), and after how many blocks the writer looks at these first.
GROUP = {"parquet.block.size": str(2 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4"}
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Runs of digits, letters and bytes of other scripts, in lower-cased UTF-8.
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK = pa.schema([("doc_ids", pa.list_(pa.string())), ("n_words", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("indptr", pa.list_(pa.int32())), ("indices", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
BLOCK_DDL = "doc_ids array<string>, n_words array<long>, n_features array<long>, indptr array<int>, indices array<int>, counts array<long>"


class Buckets(dict):
    """A feature's bucket, remembered; forgets all when ``KNOWN`` are held."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        got = self[feature] = zlib.crc32(feature) % self.buckets
        return got


def pieces(text: bytes, most: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """New words of a text and, with up to ``most - 1`` words before them, their context, piece by piece."""
    found, before = (m.group() for m in WORD.finditer(text.translate(LOWER))), []
    while ws := list(islice(found, PIECE)):
        yield ws, before + ws
        before = (before + ws)[-(most - 1) :] if most > 1 else []


def counted(text: bytes, most: int, table: Buckets) -> tuple[int, int, np.ndarray, np.ndarray]:
    """How many words and features a text has, its buckets in order, and their counts."""
    total, words, features = np.zeros(table.buckets, np.int64), 0, 0
    for ws, context in pieces(text, most):
        words += len(ws)
        for n in range(1, most + 1):
            fresh = context[max(0, len(context) - len(ws) - n + 1) :]
            grams = fresh if n == 1 else [b" ".join(fresh[i : i + n]) for i in range(len(fresh) - n + 1)]
            features += len(grams)
            total += np.bincount(np.fromiter((table[g] for g in grams), np.int64, len(grams)), minlength=table.buckets)
    at = np.flatnonzero(total)
    return words, features, at.astype(np.int32), total[at]


def matrix(texts: DataFrame, key: str, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The stored matrix of a table's texts, a block a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Buckets(buckets)
        held: list[tuple] = []
        cells = 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                got = counted(text.as_py() or b"", most, table)
                held.append((doc_id.as_py(), *got))
                cells += len(got[2])
                if len(held) >= BLOCK_DOCS or cells >= BLOCK_CELLS:
                    yield block(held)
                    held, cells = [], 0
        if held:
            yield block(held)
        give_back()

    chosen = texts.select(F.col(key).cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(chosen.mapInArrow(run, BLOCK_DDL), "csr", batch_mb=4, options=GROUP)


def block(rows: list[tuple]) -> pa.RecordBatch:
    ids, words, features, at, counts = zip(*rows, strict=True)
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in at])])
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((ids, words, features, indptr, np.concatenate(at), np.concatenate(counts)), BLOCK, strict=True)], schema=BLOCK)


def arrays(b: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [b.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: a dense vector a task, added by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                at, n = arrays(b, k, "indices", "counts")
                np.add.at(total, at, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out, spark = np.zeros(buckets, np.int64), blocks.sparkSession
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "4m")
    try:
        for r in blocks.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r["bucket"]] = r["n"]
    finally:
        spark.conf.set(BATCH_BYTES, before)
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of each bucket's log ratio of smoothed shares, rounded down."""
    s, t, add = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + add) / ((s + 1.0) * (t.sum() + add)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id`` (as text), ``n_words``, ``n_features`` and ``weight``: the matrix times the gains."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, features, indptr, at, n = arrays(b, k, "n_words", "n_features", "indptr", "indices", "counts")
                upto = np.concatenate([[0], np.cumsum(gain[at] * n)])
                ids = b.column("doc_ids")[k].values
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (words, features, upto[indptr[1:]] - upto[indptr[:-1]]))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id string, n_words long, n_features long, weight long")


def ranked(df: DataFrame, order: list, most: int) -> DataFrame:
    """The ``most`` first rows in an order, with ``rank`` from 1: rows are dealt out by ranges of the order and
    stored, so what a partition's rows come after is one count for each partition before it."""
    at = F.monotonically_increasing_id()  # the partition's number, then the row's within it
    dealt = df.repartitionByRange(*order, F.rand(SEED)).sortWithinPartitions(*order).withColumn("_at", at)
    x = stored(dealt, "ranked").withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before, offsets = 0, {}
    for r in x.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets[r["_part"]] = before
        before += r["n"]
    kept = [(p, n) for p, n in offsets.items() if n < most]
    if not kept:
        return x.withColumn("rank", F.lit(1).cast("long")).drop("_at", "_part").limit(0)
    offset = F.try_element_at(F.map_from_arrays(F.lit([p for p, _ in kept]), F.lit([n for _, n in kept]).cast("array<long>")), "_part")
    x = x.withColumn("rank", offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return x.where(F.col("rank") <= most).drop("_at", "_part")


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, rate: int = RATE, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document. Of those with at least ``min_words`` words,
    ``rate`` percent are drawn and have a rank; features are runs of 1 to ``most`` words."""
    raw = matrix(docs, "doc_id", most, buckets)
    w = weights(raw, gains(column_sums(raw, buckets), column_sums(matrix(target, "item_id", most, buckets), buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    kind = docs.schema["doc_id"].dataType
    x = w.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    x = stored(x.withColumn("_row", F.monotonically_increasing_id()), "scores", batch_mb=4)
    open_ = x.where(F.col("n_words") >= min_words).select("_row", "doc_id", "score")
    drawn = ranked(open_, [F.desc("score"), F.asc_nulls_last("doc_id")], rate * open_.count() // 100).select("_row", "rank")
    return x.join(drawn, "_row", "left").select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = """
with bits as (select i, 0 as k, i as c from range(256) r(i)),
crc as (with recursive t(i, k, c) as (select i, 0, i::bigint from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8)
        select list(c order by i) as table256 from t where k = 8),
w as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
f as (select r, word, count(*) as n from (select r, unnest(ws) as word from w) group by all),
g as (select word, count(*) as n from (select unnest(ws) as word from b) group by all),
v as (select word, (xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::int, 2))::bigint)),
        lambda c, x: xor(c >> 8, table256[(xor(c, x) & 255) + 1])), 4294967295) % 10000) as bucket
      from (select word from f union select word from g), crc),
s as (select bucket, sum(n)::double as s from f join v using (word) group by 1),
t as (select bucket, sum(n)::double as t from g join v using (word) group by 1),
tot as (select (select coalesce(sum(s), 0) from s) as s_all, (select coalesce(sum(t), 0) from t) as t_all),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from s left join t using (bucket), tot),
sums as (select r, sum(n * gain)::bigint as weight from f join v using (word) join gain using (bucket) group by 1),
sc as (select doc_id, r, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296))))::bigint as score from w left join sums using (r)),
d as (select r, row_number() over (order by score desc, doc_id) as rank from sc where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from d) then rank end as rank from sc left join d using (r)
"""
