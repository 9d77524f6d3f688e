"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, and runs of other visible characters) give unigrams
and bigrams, hashed into ``BUCKETS``. One multinomial is counted over trusted documents, one
over the whole raw corpus; a document's score is the sum of its n-grams' log ratios
over their number. It is kept if the base rules pass and the score is at least ``THRESHOLD``.

The counts of the raw corpus cover every document. Trusted are at most ``TRUSTED``
documents labelled as good, those whose doc_id has the least hash, a table of bounded
size that is broadcast. The table of log ratios has one entry a bucket. A text is
scored within its row, so nothing about it moves.

Null and empty texts have no words and fail the base rules; without trusted documents all
ratios are zero and the base rules decide. Repeated rows each get their row; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

BUCKETS = 10_000
TRUSTED = 20_000
THRESHOLD = -0.25
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def repeated_words(w: Column) -> Column:
    """Words within three-word windows that occur twice or more in the text."""
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        found = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(found, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, v: a + v)

    distinct = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return let(windows, lambda s: F.when(distinct(F.transform(s, lambda e: e["h"])), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(s), twice), covered)))


def base(text: Column) -> Column:
    """The base counts of a text, as a struct."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _pair(tok: Column, x: Column, i: Column) -> tuple[Column, Column]:
    """A token's unigram and bigram bucket; the last token pairs with nothing."""
    b = F.lit(BUCKETS).cast("long")
    return F.pmod(F.xxhash64(x), b).cast("int"), F.pmod(F.xxhash64(x, F.get(tok, i + 1), F.lit(1)), b).cast("int")


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(trusted / raw) for each bucket, with half a count added to each."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    good = good.orderBy(F.xxhash64(F.lit("trusted"), "_id"), "_id").limit(TRUSTED).withColumn("_good", F.lit(1))
    both = docs.select("doc_id", "text").join(F.broadcast(good), docs.doc_id == good._id, "left")
    grams = let(tokens(F.col("text")), lambda tok: F.flatten(F.transform(tok, lambda x, i: F.array(*_pair(tok, x, i)))))
    g = both.select("_good", grams.alias("g")).select("_good", F.explode_outer("g").alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    raw, trusted = [0.5] * BUCKETS, [0.5] * BUCKETS
    for r in g.collect():
        if r["b"] is not None:
            raw[r["b"]] += r["raw"]
            trusted[r["b"]] += r["good"]
    if sum(trusted) <= 0.5 * BUCKETS:
        return [0.0] * BUCKETS
    a, b = math.log(sum(trusted)), math.log(sum(raw))
    return [math.log(x) - a - math.log(y) + b for x, y in zip(trusted, raw, strict=True)]


def score(text: Column, table: list[float]) -> Column:
    """The mean log ratio of a text's n-grams; 0 where there is none."""
    lit = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to one literal

    def total(tok: Column) -> Column:
        each = F.transform(tok, lambda x, i: F.get(lit, _pair(tok, x, i)[0]) + F.get(lit, _pair(tok, x, i)[1]))
        return F.when(F.size(tok) > 0, F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / (2 * F.size(tok))).otherwise(F.lit(0.0))

    return let(tokens(text), total)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept`` for every row."""
    table = ratios(docs, labels)
    x = docs.select("doc_id", base(F.col("text")).alias("b"), score(F.col("text"), table).alias("score")).select("doc_id", "b.*", "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))


#: The base counts and verdict for DuckDB, by other means.
BASE_ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
x as (select r, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) as s from w where len(ws) > 2),
m as (select r, s.i as i, count(*) over (partition by r, s.g) as n from x),
c as (select r, count(distinct i + k) as n_repeat from m, range(3) k(k) where n > 1 group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words,
       len(ws) < 50 or 100 * coalesce(n_repeat, 0) > 50 * len(ws) as base_failed
from w left join c using (r)
"""
