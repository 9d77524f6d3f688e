"""Toxicity by nearest labelled examples.

Labelled examples are indexed by TF-IDF over words in an inverted index cut into blocks of
examples. A word's weight is (1 + log tf) * idf * relevance, where the relevance is by how many
standard errors the word's document frequency differs between the labels, less one (with a
continuity correction, so a word of one example isn't taken for telling). Words that don't
differ so much weigh nothing in any cosine and have no postings; all others are indexed, at every
number of labels. Each word keeps its largest weight in each block. A document's bound for a
block is the sum of its weights times those maxima, so blocks are scored exactly in order of bound
and the rest skipped once the k-th best cosine is at least their bound: the neighbours are
those of an exhaustive search (of equal cosines, those of the least example number). Their
votes, weighted by squared cosine, become probabilities by isotonic regression on the examples'
own leave-one-out votes at the labelled share of toxic documents.

The index holds at most ``EXAMPLES`` examples of each label, those whose doc_id has the
least hash, with all words of their whole texts that differ between the labels, so it is
broadcast at the size of these examples. Every document is scored over its whole text, however long.

Null and empty texts, and texts with no indexed word, get the share of toxic documents among
labelled ones without a neighbour as their score, 0.5 where nothing is labelled. Repeated rows each
get their score; of differing texts with one labelled doc_id, that of the least hash is the
example. Labels that are null count not at all, and of labels that contradict each other for one
doc_id the larger counts. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, letter_words, stored

EXAMPLES = 2500
NEIGHBOURS = 31
BLOCK = 64
THRESHOLD = 0.7
#: Texts and MB of them that a Python worker gets at once where whole documents pass through.
ROWS, BATCH_MB = 500, 4


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions lo, lo + 1, .. of each of some ranges of n, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - (ends - n), n)


class Index:
    """TF-IDF examples in blocks. A cell is a word in a block: its postings and their largest weight."""

    def __init__(self, terms: list[str], scale: np.ndarray, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, y: np.ndarray, ids: list, rate: float, k: int = NEIGHBOURS):
        self.vocab = {t: i for i, t in enumerate(terms)}
        self.scale, self.y, self.ids, self.rate, self.k = scale, y, ids, rate, k
        self.blocks = -(-len(y) // BLOCK)
        order = np.lexsort((rows, cols))
        self.doc, self.w = rows[order].astype(np.int32), weight[order].astype(np.float64)
        block, col = self.doc // BLOCK, cols[order]
        first = np.flatnonzero(np.concatenate(([True], (col[1:] != col[:-1]) | (block[1:] != block[:-1])))) if len(col) else np.zeros(0, int)
        self.cell_block, self.cell_ptr = block[first], np.append(first, len(col))
        self.cell_top = np.maximum.reduceat(self.w, first) if len(first) else np.zeros(0)
        self.ptr = np.searchsorted(col[first], np.arange(len(terms) + 1))
        self.x = self.p = None
        self.alone = rate

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocab.get
        ids = [i for t in letter_words(text) if (i := get(t)) is not None]
        if not ids:
            return np.zeros(0, int), np.zeros(0)
        q, tf = np.unique(ids, return_counts=True)
        w = (1 + np.log(tf)) * self.scale[q]
        return q, w / np.sqrt((w * w).sum())

    def nearest(self, q: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, and their cosines."""
        if not len(q) or not self.blocks:
            return np.zeros(0, int), np.zeros(0)
        n = self.ptr[q + 1] - self.ptr[q]
        cell, by = _spread(self.ptr[q], n), np.repeat(w, n)
        block = self.cell_block[cell]
        bound = np.bincount(block, by * self.cell_top[cell], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        sims, done, wave = np.zeros(self.blocks * BLOCK), 0, 16
        place = np.empty(self.blocks, np.int64)
        place[order] = np.arange(self.blocks)
        while done < self.blocks and bound[order[done]] > 0:
            now = (place[block] >= done) & (place[block] < done + wave)
            lo = self.cell_ptr[cell[now]]
            ln = self.cell_ptr[cell[now] + 1] - lo
            j = _spread(lo, ln)
            sims += np.bincount(self.doc[j], np.repeat(by[now], ln) * self.w[j], minlength=len(sims))
            done, wave = done + wave, wave * 2
            if skip >= 0:
                sims[skip] = 0
            if done < self.blocks and len(sims) > self.k and np.partition(sims, -self.k)[-self.k] > bound[order[done]] + 1e-12:
                break
        best = np.lexsort((np.arange(len(sims)), -sims))[: self.k] if len(sims) <= self.k else self._top(sims)
        best = best[sims[best] > 0]
        return best, sims[best]

    def _top(self, sims: np.ndarray) -> np.ndarray:
        least = np.partition(sims, -self.k)[-self.k]
        some = np.nonzero(sims >= least)[0]
        return some[np.lexsort((some, -sims[some]))][: self.k]

    def vote(self, near: np.ndarray, sims: np.ndarray) -> float | None:
        w = sims * sims
        return float((w * self.y[near]).sum() / w.sum()) if len(near) else None

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic regression of the label on the leave-one-out vote."""
        votes = [self.vote(*self.nearest(q, w, i)) for i, (q, w) in enumerate(vectors)]
        got = [(v, y) for v, y in zip(votes, self.y, strict=True) if v is not None]
        pos, neg = max(1, int(self.y.sum())), max(1, int((1 - self.y).sum()))
        # Without a neighbour: the share of toxic documents among those without one.
        alone = [y for v, y in zip(votes, self.y, strict=True) if v is None]
        a, b = self.rate * (sum(alone) + 0.5) / (pos + 1), (1 - self.rate) * (len(alone) - sum(alone) + 0.5) / (neg + 1)
        self.alone = a / (a + b) if len(self.y) else self.rate
        pool: list[list[float]] = []  # mean vote, share, weight
        for v, y in sorted(got):
            wt = self.rate / pos if y else (1 - self.rate) / neg
            pool.append([v, float(y), wt])
            while len(pool) > 1 and pool[-2][1] >= pool[-1][1]:
                b, a = pool.pop(), pool.pop()
                t = a[2] + b[2] or 1.0
                pool.append([(a[0] * a[2] + b[0] * b[2]) / t, (a[1] * a[2] + b[1] * b[2]) / t, t])
        self.x, self.p = (np.array([p[i] for p in pool]) for i in (0, 1))

    def score(self, text: str | None) -> tuple[float, list[tuple[object, float, int]]]:
        near, sims = self.nearest(*self.vector(text))
        v = self.vote(near, sims)
        p = self.alone if v is None or self.x is None or not len(self.x) else float(np.interp(v, self.x, self.p))
        return min(1.0, max(0.0, p)), [(self.ids[i], float(s), int(self.y[i])) for i, s in zip(near[:3], sims[:3], strict=True)]


def relevance(df: Column, toxic: Column, pos: int, neg: int) -> Column:
    """By how many standard errors beyond one a word's document frequency differs between the labels."""
    p = df / (pos + neg)
    each = F.lit(1.0 / pos + 1.0 / neg)
    apart = F.abs(toxic / pos - (df - toxic) / neg) - 0.5 * each
    return F.greatest(apart / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * each) - 1, F.lit(0.0))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts of some texts."""
    for b in batches:
        for k in range(0, len(b), 100):
            part = b.iloc[k : k + 100]
            got = [Counter(letter_words(t)) for t in part["t"]]
            n = [len(c) for c in got]
            yield pd.DataFrame({"_id": np.repeat(part["_id"].to_numpy(), n), "y": np.repeat(part["y"].to_numpy(), n), "term": [w for c in got for w in c], "tf": [x for c in got for x in c.values()]})


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Index:
    """Index the bounded sample of labelled documents whose remainder is not 1."""
    lab = labels.where("toxic is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 1).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.5
    pick = lambda y: lab.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("toxic"), "_id"), "_id").limit(examples)
    ids = F.broadcast(pick(1).union(pick(0)))
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s"))
    some = some.select(F.col("_id").cast("string").alias("_id"), F.col("y").cast("int").alias("y"), F.col("s.text").alias("t"))
    tf = stored(some.mapInPandas(_counts, "_id string, y int, term string, tf int"), "examples")
    every = {str(r["_id"]): int(r["y"]) for r in ids.collect()}
    pos, neg = (max(1, sum(v == y for v in every.values())) for y in (1, 0))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("toxic")).withColumn("r", relevance(F.col("df"), F.col("toxic"), pos, neg))
    words = df.where("r > 0").orderBy(F.desc("r"), "term").collect()
    numbers = sorted(every, key=lambda i: (every[i], i))  # blocks of one label have closer maxima
    n, at = max(1, len(numbers)), {i: k for k, i in enumerate(numbers)}
    # One string an example reaches the driver, not a row a word.
    coded = docs.sparkSession.createDataFrame([(r["term"], i) for i, r in enumerate(words)], "term string, t int")
    scale = np.array([(np.log((1 + n) / (1 + r["df"])) + 0.1) * r["r"] for r in words])
    packed = tf.join(F.broadcast(coded), "term").groupBy("_id").agg(F.concat_ws(" ", F.collect_list(F.col("t").cast("string"))).alias("t"), F.concat_ws(" ", F.collect_list(F.col("tf").cast("string"))).alias("tf")).collect()
    bits = [(at[r["_id"]], np.array(r["t"].split(), np.int64), np.array(r["tf"].split(), float)) for r in packed]
    rows = np.repeat(np.array([b[0] for b in bits], np.int64), [len(b[1]) for b in bits])
    cols = np.concatenate([b[1] for b in bits]) if bits else np.zeros(0, np.int64)
    w = (1 + np.log(np.concatenate([b[2] for b in bits]))) * scale[cols] if bits else np.zeros(0)
    unit = w / np.sqrt(np.bincount(rows, w * w, minlength=n))[rows] if len(rows) else w
    index = Index([r["term"] for r in words], scale, rows, cols, unit, np.array([every[i] for i in numbers], np.int64), numbers, rate, k)
    order = np.lexsort((cols, rows))
    rows, cols, unit = rows[order], cols[order], unit[order]
    cut = np.searchsorted(rows, np.arange(len(numbers) + 1))
    index.calibrate([(cols[a:b], unit[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return index


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), **fit_options: int) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` (nearest examples as
    id:cosine:label) for every row, and the columns named in ``keep``."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fit_options))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for b in batches:
            got = [ix.score(t) for t in b["text"]]
            rest = b.drop(columns=["_score", "_evidence"], errors="ignore")
            yield rest.assign(_score=[s for s, _ in got], _evidence=[" ".join(f"{i}:{c:.4f}:{y}" for i, c, y in e) for _, e in got])

    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    x = docs.select(F.col("doc_id").cast("string").alias("_id"), held, F.col("text"), *[F.col(c) for c in keep])
    x = x.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema) + ", _score double, _evidence string")
    return x.select(F.col("_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"), *([F.col("text")] if "text" in keep else []), *[F.col(c) for c in keep if c != "text"])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that aren't predicted toxic."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([index.value.score(t)[0] for t in s], dtype="float64")
        give_back()

    return stored(docs.where(F.pandas_udf(run, "double")(F.col("text")) < THRESHOLD), "not-toxic", ROWS, BATCH_MB)
