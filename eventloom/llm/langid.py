"""Language identification by words first, then shorter and shorter character n-grams.

A word of the model adds its log frequency in each language. A word it doesn't have is
scored by the longest n (``LONGEST`` down to 1) of which the model has some n-gram of the
word: the mean log frequency of those, over all its letters. A word or n-gram that a language was never seen with has one
and the same low value in all languages, however little there is to learn from in one. The language with the largest sum
is predicted; the score is its share when the sums, tempered by the square root of the number of
words, are normalised.

The model is fitted on about ``DOCS`` documents of each language (those whose hash of doc_id is
below the share that gives so many; remainder of the id's crc32 other than 1), fewer where there are so many
languages that these would be more than ``ALL_DOCS``, so it is broadcast at a bounded size. No language is left
out, and it has all n-grams of the sample and all words that occur in it ``SEEN`` times; a word seen less
is scored as an unseen one. Frequencies are kept only of the languages that have the word or n-gram. Fitting and
predicting take the same words. Every document is predicted over its whole text, however long, from its text alone.

A text that is null or has no letter is ``und`` at score 0, as is every text where there is
nothing to learn from. Repeated rows each get their row; empty tables give empty results; extra
columns are ignored; of equal sums the first language by code point wins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import letter_words, rows_at_most, stored

DOCS = 3000
ALL_DOCS = 100_000
SEEN = 2
LONGEST = 4
#: Bytes of the table that keeps the vectors of words met before, and most rows of it.
CACHE_BYTES, CACHE = 1 << 26, 100_000
#: Letters of a run taken at once, and letters of the longest word that is kept with its vector.
CHUNK = 4096
KEPT = 64
BROADCAST_LANGUAGES = 100_000


class Table:
    """Log frequencies of words or of n-grams: what a language has without any, and what those seen add to it."""

    def __init__(self, keys: list[str], lang: np.ndarray, n: np.ndarray, langs: int):
        """``keys`` in order, equal ones together, each with a language and its count there."""
        new = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        self.at = {keys[i]: row for row, i in enumerate(new)}
        self.ptr = np.array([*new, len(keys)], np.int64)
        # One floor for all languages, that of the one with the most data: what a language was never seen with tells nothing for it.
        total = np.bincount(lang, n, minlength=langs) + 0.5 * len(new) + 1
        floor = np.log(0.5 / total.max(initial=1.0))
        self.lang, self.base = lang.astype(np.int64), np.full(langs, floor)
        self.more = np.log((n + 0.5) / total[self.lang]) - floor

    def means(self, rows: list[int], sizes: list[int]) -> np.ndarray:
        """The mean log frequencies of groups of rows, which stand one group after another."""
        at, size, langs = np.array(rows, np.int64), np.array(sizes, np.int64), len(self.base)
        n = self.ptr[at + 1] - self.ptr[at]
        j = np.arange(n.sum()) + np.repeat(self.ptr[at] - (np.cumsum(n) - n), n)
        group = np.repeat(np.repeat(np.arange(len(size)) * langs, size), n)
        total = np.bincount(group + self.lang[j], self.more[j], minlength=len(size) * langs).reshape(len(size), langs)
        return total / size[:, None] + self.base


class Model:
    """Log frequencies of words (table 0) and of character n-grams (table n)."""

    def __init__(self, langs: list[str], tables: list[Table]):
        self.langs, self.tables = langs, tables
        self.memo: dict[str, int] = {}
        self.most = max(1000, min(CACHE, CACHE_BYTES // (8 * max(1, len(langs)))))
        self.rows: np.ndarray | None = None

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word, zero for one of which no letter is known."""
        out, found = np.zeros((len(words), len(self.langs))), [([], [], []) for _ in self.tables]
        for i, w in enumerate(words):
            row = self.tables[0].at.get(w)
            got = [row] if row is not None else None
            k, padded = 0, f" {w} "
            while got is None or not got:
                k = k - 1 if k else LONGEST
                if not k:
                    break
                get = self.tables[k].at.get
                got = [g for j in range(len(padded) - k + 1) if (g := get(padded[j : j + k])) is not None]
            if got:
                which, rows, sizes = found[k]
                which.append(i)
                rows += got
                sizes.append(len(got))
        for (which, rows, sizes), table in zip(found, self.tables, strict=True):
            if which:
                out[which] = table.means(rows, sizes)
        return out

    def long_word(self, w: str) -> np.ndarray:
        """The row of a word of any length, taken a piece at a time."""
        if w in self.tables[0].at:
            return self.vectors([w])[0]
        padded = f" {w} "
        for k in range(LONGEST, 0, -1):
            total, n, get = np.zeros(len(self.langs)), 0, self.tables[k].at.get
            for at in range(0, len(padded) - k + 1, CHUNK):
                got = [g for j in range(at, min(at + CHUNK, len(padded) - k + 1)) if (g := get(padded[j : j + k])) is not None]
                if got:
                    total += self.tables[k].means(got, [len(got)])[0] * len(got)
                    n += len(got)
            if n:
                return total / n
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letter_words(text)
        if not self.langs or not found:
            return "und", 0.0
        if self.rows is None:
            self.rows = np.zeros((self.most, len(self.langs)))
        memo, total = self.memo, np.zeros(len(self.langs))
        for k in range(0, len(found), self.most):
            some = found[k : k + self.most]
            new = [w for w in dict.fromkeys(some) if w not in memo and len(w) <= KEPT]
            if len(memo) + len(new) > self.most:
                memo.clear()
                new = [w for w in dict.fromkeys(some) if len(w) <= KEPT]
            self.rows[len(memo) : len(memo) + len(new)] = self.vectors(new)
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            total += self.rows[[memo[w] for w in some if len(w) <= KEPT]].sum(0)
            for w in some:
                if len(w) > KEPT:
                    total += self.long_word(w)
        best = int(np.argmax(total))
        p = np.exp((total - total[best]) / math.sqrt(len(found)))
        return self.langs[best], float(1.0 / p.sum())


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def grams(words: dict[str, int]) -> Iterator[Counter]:
    """The counts of the n-grams of some words, for each n from 1."""
    for k in range(1, LONGEST + 1):
        c: Counter = Counter()
        for w, n in words.items():
            padded = f" {w} "
            for j in range(len(padded) - k + 1):
                c[padded[j : j + k]] += n
        yield c


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (n = 0) and of n-grams in some texts, by language."""
    for b in batches:
        for lang, part in b.groupby("lang"):
            words = Counter(w for t in part["text"] for w in letter_words(t))
            for k, c in enumerate([words, *grams(words)]):
                yield pd.DataFrame({"lang": lang, "k": k, "key": list(c), "n": list(c.values())})


def fit(docs: DataFrame, per_language: int = DOCS, seen: int = SEEN) -> Model:
    known = docs.where("lang is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 1).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("m")), "languages")
    langs = sizes.count()
    if not langs:
        return Model([], [])
    most = max(1, min(per_language, ALL_DOCS // langs))
    if rows_at_most(sizes, BROADCAST_LANGUAGES):
        sizes = F.broadcast(sizes)
    part = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 31)) < F.greatest(F.lit(2.0), F.lit(float(most))) / F.col("m") * (1 << 31)
    some = known.join(sizes, "lang").where((F.col("m") <= most) | part).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    c = some.mapInPandas(_counts, "lang string, k int, key string, n long").groupBy("k", "key", "lang").agg(F.sum("n").alias("n"))
    got = stored(c.where(f"k > 0 or n >= {seen}"), "counts").toArrow().to_pandas().sort_values(["k", "key", "lang"])
    names = sorted(set(got["lang"]))
    number = {lang: i for i, lang in enumerate(names)}
    tables = []
    for k in range(LONGEST + 1):
        t = got[got["k"] == k]
        tables.append(Table(list(t["key"]), t["lang"].map(number).to_numpy(np.int64), t["n"].to_numpy(np.float64), len(names)))
    return Model(names, tables)


def predicted(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]})

    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    x = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held, "text").mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double")
    return x.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
