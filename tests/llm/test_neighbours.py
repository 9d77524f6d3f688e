"""Search by inner product against brute force: exact on small tables, by recall on a larger one."""

import math

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import neighbours

COLUMNS = "vec_id long, embedding array<float>, key string, vid int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], COLUMNS)


def brute(rows, k=20, every=20):
    """The k best rows of each query row but itself, nearest first, null ids last among ties."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            best = sorted(((-float((v * w).sum()), j is None, j if j is not None else 0) for m, (j, w) in enumerate(ok) if m != n))[:k]
            out.append((i, [(None if none else j, -s) for s, none, j in best]))
    return sorted(out, key=str)


def found(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_small_tables_are_searched_exactly(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(150, 5)).astype(np.float32)
    v[30:60] = v[7]  # a third of all are equal
    v[70] = -0.0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500, None), (520, [1.0, None, 2.0, 3.0, 4.0]), (540, [float("nan")] * 5), (560, [0.0] * 5), (580, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, [3.0] * 5), (600, [1.0, 2.0]), (None, None)]
    rows += [(-20, [9.0] * 5), (40, [-9.0, 1.0, 0.0, 0.0, 0.0])]  # a second row with the id 40
    want = [(i, l) for i, l in brute([x for x in rows if x[1] is None or len(x[1]) == 5])]
    got = found(neighbours.nearest(frame(spark, rows)))
    assert sorted(got) == sorted({i for i, _ in want})
    for i, best in want:
        mine = sorted(got[i], key=lambda x: x[0])
        if i == 40:  # two query rows share the id
            assert len(mine) == 40 and {(a, round(s, 9)) for a, s in best} <= {(a, round(s, 9)) for _, a, s in mine}
            continue
        assert [x[0] for x in mine] == list(range(1, 21))
        assert [(a, round(s, 9)) for _, a, s in mine] == [(a, round(s, 9)) for a, s in best]


def test_few_and_no_vectors(spark):
    assert found(neighbours.nearest(frame(spark, []))) == {} and found(neighbours.nearest(frame(spark, [(0, None), (20, [0.0])]))) == {}
    assert found(neighbours.nearest(frame(spark, [(0, [1.0, 2.0])]))) == {}
    assert found(neighbours.nearest(frame(spark, [(0, [1.0, 2.0]), (3, [2.0, 0.0]), (4, [0.0, 5.0])]))) == {0: [(1, 4, 10.0), (2, 3, 2.0)]}
    assert found(neighbours.nearest(frame(spark, [(20, [1.0]), (20, [1.0]), (20, [2.0])]), k=1)) == {20: [(1, 20, 2.0)] * 2 + [(1, 20, 2.0)]}


def test_crowded_buckets_and_short_queries(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=8) * r.uniform(0.2, 3)).tolist()) for i in range(400)]
    want = dict(brute(rows))
    for piece, queries, bucket in ((37, 3, 256), (50, 5, 4)):  # pieces of buckets; then buckets so small that most queries come short
        monkeypatch.setattr(neighbours, "PIECE", piece)
        monkeypatch.setattr(neighbours, "QUERIES", queries)
        monkeypatch.setattr(neighbours, "BUCKET", bucket)
        got = found(neighbours.nearest(frame(spark, rows), tables=1 if bucket == 4 else 12, probes=1 if bucket == 4 else 10))
        hit = [len({a for _, a, _ in got[i]} & {a for a, _ in want[i]}) for i in want]
        assert all(len(got[i]) == 20 for i in want) and sum(hit) >= 0.9 * 20 * len(hit)


def test_recall_on_random_vectors(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(8000, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    want, got = dict(brute(list(enumerate(v)))), found(neighbours.nearest(df))
    assert sum(len({a for _, a, _ in got[i]} & {a for a, _ in want[i]}) for i in want) >= 0.9 * 20 * len(want)
    assert df.where(F.col("vec_id") % 20 == 0).count() == len(got)


def test_hadamard_and_keys():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)
    assert neighbours.axes(51_282, 128) == [128] and neighbours.axes(10**9, 128) == [128, 128, 32] and neighbours.axes(3, 2) == [1]
    k = neighbours.keys(x, 1, [8, 4], 6)
    assert k.shape == (5, 6) and (k[:, :1] == neighbours.keys(x, 1, [8, 4], 1)).all() and all(len(set(row)) == 6 for row in k.tolist())
