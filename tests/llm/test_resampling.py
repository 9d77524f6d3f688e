"""Importance resampling against a plain version over dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from eventloom.llm import resampling

COLUMNS = "doc_id long, text string, weight string, indices int, rank string"
WORDS = "Alpha beta 7up gamma delta épée 東京 zeta eta theta iota kappa_x lambda mu a1b2".split()


def features(text, most):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, most + 1) for i in range(len(ws) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, min_words=20, rate=10):
    docs = [(i, *features(t, most)) for i, t in rows]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, _, f in docs for g in f), Counter(bucket(g) for x in target for g in features(x, most)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(g)) for g in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= min_words)
    drawn = {None if none else i: k + 1 for k, (_, none, i) in enumerate(able[: rate * len(able) // 100])}
    return {i: (n, w, sc, drawn.get(i)) for i, _, n, w, sc in out}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], COLUMNS)


def goal(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, counts string")


def got(df):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


def rows(n=400):
    r = random.Random(2)
    return [(i, " ".join(r.choice(WORDS[: 5 + i % 11]) + r.choice(["", "!", "-"]) for _ in range(r.randint(0, 70)))) for i in range(n)]


TARGET = ["alpha beta beta 7up", None, "", "épée Épée kappa", "7up never seen"] * 3


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 97)])
def test_weights_and_draw(spark, most, buckets):
    x = rows() + [(900, None), (901, ""), (902, "Beta " * 300_000 + "gamma"), (-5, "alpha " * 20), (None, "alpha " * 25)]
    assert got(resampling.resampled(frame(spark, x), goal(spark, TARGET), most, buckets)) == brute(x, TARGET, most, buckets)


def test_blocks_are_rows_of_a_sparse_matrix(spark):
    x = rows(100)
    m = resampling.matrix(frame(spark, x).repartition(3), "doc_id").collect()
    cells = {(i, b): n for r in m for k, i in enumerate(r["doc_ids"]) for b, n in zip(r["indices"][r["indptr"][k] : r["indptr"][k + 1]], r["counts"][r["indptr"][k] : r["indptr"][k + 1]], strict=True)}
    assert cells == {(str(i), b): n for i, t in x for b, n in Counter(zlib.crc32(g.encode()) % 10_000 for g in features(t, 1)[1]).items()}
    sums = resampling.column_sums(resampling.matrix(frame(spark, x), "doc_id"))
    assert sums.sum() == sum(cells.values()) and len(sums) == 10_000


def test_ties_repeats_and_empty_tables(spark):
    same = [(5, "alpha beta " * 15)] * 30 + [(None, "alpha beta " * 15)] * 30
    out = resampling.resampled(frame(spark, same), goal(spark, [])).collect()
    assert len(out) == 60 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 7))
    best = max(r["score"] for r in out)
    assert all(r["score"] == best for r in out if r["rank"])
    assert resampling.resampled(frame(spark, []), goal(spark, TARGET)).count() == 0
    few = resampling.resampled(frame(spark, [(1, "alpha " * 30)]), goal(spark, TARGET)).collect()
    assert [r["rank"] for r in few] == [None]  # a tenth of one document is none


def test_ranks_don_t_depend_on_partitions(spark):
    x = rows(300)
    one = got(resampling.resampled(frame(spark, x).coalesce(1), goal(spark, TARGET), rate=60))
    assert one == got(resampling.resampled(frame(spark, x).repartition(9), goal(spark, TARGET), rate=60)) and sum(v[3] is not None for v in one.values()) > 100


def test_blocks_of_a_task_lie_in_small_row_groups(spark):
    """What a task writes and reads at once doesn't grow with its documents: Parquet's readers take a row group, its writer
    at least so many rows, and a block is a row."""
    r = random.Random(3)
    x = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(600))) for i in range(3000)]
    m = resampling.matrix(frame(spark, x).coalesce(1), "doc_id")
    groups = [g for f in m.inputFiles() for g in row_groups(f.removeprefix("file:"))]
    assert len(groups) > 1 and max(groups) <= 16 << 20
    assert all(r["n"] <= 1 << 17 for r in m.selectExpr("size(indices) as n").collect())


def row_groups(path):
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    return [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
