"""Scores against a brute-force version that starts from the texts; small and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.llm import toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def made(n, seed, bad=("idiotic", "scumbag", "trashy", "moronic")):
    r = random.Random(seed)
    plain = [f"w{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}" for k in range(100)]
    texts = [" ".join(r.choices(plain, k=r.randint(5, 60)) + (r.choices(bad, k=r.randint(1, 4)) if i % 5 == 0 else [])) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)], [(i, int(i % 5 == 0)) for i in range(n)]


def brute(rows, labels):
    """Scores of all texts, by cosines of every pair."""
    text, y = dict(rows), {i: v for i, v in labels if not held(i)}
    words = {i: Counter(re.findall(r"[a-z]+", (t or "").lower())) for i, t in rows}
    ex = sorted(y, key=lambda i: (y[i], str(i)))
    pos, neg, n = sum(y.values()), len(y) - sum(y.values()), len(y)
    scale = {}
    for w in {w for i in ex for w in words[i]}:
        df, dp = sum(w in words[i] for i in ex), sum(w in words[i] for i in ex if y[i])
        p, each = df / n, 1 / pos + 1 / neg
        z = (abs(dp / pos - (df - dp) / neg) - each / 2) / math.sqrt(max(p * (1 - p), 1e-9) * each) - 1
        if z > 0:
            scale[w] = z * (math.log((1 + n) / (1 + df)) + 0.1)

    def vec(i):
        v = {w: (1 + math.log(c)) * scale[w] for w, c in words[i].items() if w in scale}
        s = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / s for w, x in v.items()}

    vs = {i: vec(i) for i in text}

    def vote(i, skip=None):
        c = [(-sum(x * vs[j].get(w, 0) for w, x in vs[i].items()), k, j) for k, j in enumerate(ex) if j != skip]
        top = [(-s, j) for s, _, j in sorted(c)[: toxicity.NEIGHBOURS] if s < 0]
        return sum(s * s * y[j] for s, j in top) / sum(s * s for s, _ in top) if top else None

    return {i: vote(i) for i in text}, {i: vote(i, i) for i in ex}, scale


@pytest.mark.parametrize(("n", "seed"), [(400, 1), (60, 2)])
def test_votes_and_scores_by_brute_force(spark, n, seed):
    rows, lab = made(n, seed)
    d = spark.createDataFrame([*rows, (1001, None), (1002, "")], "doc_id long, text string")
    labels = spark.createDataFrame(lab, "doc_id long, toxic int")
    ix = toxicity.fit(d, labels)
    votes, own, scale = brute(rows, lab)
    assert set(ix.vocab) == set(scale) and all(abs(ix.scale[ix.vocab[w]] - s) < 1e-9 for w, s in scale.items())
    for i, t in rows:
        got = ix.vote(*ix.nearest(*ix.vector(t)))
        assert (got is None) == (votes[i] is None) and (got is None or abs(got - votes[i]) < 1e-9)
    by = {r["doc_id"]: r for r in toxicity.scored(d, labels).collect()}
    # Scores rise with votes, and the toxic share among examples equals the mean score over them.
    seen = sorted((votes[i], by[i]["score"]) for i, _ in rows if votes[i] is not None)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(seen, seen[1:], strict=False))
    assert len({s for _, s in seen}) > 1
    mine = [j for j in own if own[j] is not None]
    rate, pos = sum(v for i, v in lab if not held(i)), sum(v for i, v in lab if not held(i))
    share = rate / len(own)
    wt = {i: share / pos if v else (1 - share) / (len(own) - pos) for i, v in lab if not held(i)}
    import numpy as np

    fitted = np.interp([own[j] for j in mine], ix.x, ix.p)
    assert by[1001]["score"] == by[1002]["score"] == ix.alone
    assert sum(r["predicted"] for r in by.values()) > 0 and abs(sum(wt.values()) - 1) < 1e-9 and fitted.min() >= 0 and fitted.max() <= 1
    out = [i for i, _ in rows if held(i)]
    assert sum(by[i]["predicted"] == dict(lab)[i] for i in out) >= 0.9 * len(out)


def test_marks_stay_in_their_words(spark):
    rows = [(i, " ".join(["नमस्ते दुनिया"] * 3 + (["मूर्ख"] if i % 2 else ["मित्र"]))) for i in range(60)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    ix = toxicity.fit(d, lab)
    assert set(ix.vocab) == {"मूर्ख", "मित्र"}
    assert ix.score("मूर्ख")[0] > 0.9 and ix.score("मित्र")[0] < 0.1


def test_awkward_tables(spark):
    rows, lab = made(60, 3)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(0, "another text for one id", "x", 1), (None, "idiotic", "x", 1), (7, "idiotic " * 50_000, "x", 1)], "doc_id long, text string, _score string, term int")
    labels = spark.createDataFrame([(i, v, 1) for i, v in lab] + [(0, None, 1), (None, 1, 1), (1, 1, 1), (1, 0, 1)], "doc_id long, toxic int, tf int")
    got = toxicity.scored(d, labels).collect()
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, toxicity.scored(d.repartition(5), labels.repartition(3)).collect()))
    assert toxicity.scored(d.limit(0), labels).count() == 0 and toxicity.scored(d.limit(0), labels.limit(0)).count() == 0
    kept = toxicity.without_toxic(d, labels)
    assert kept.columns == d.columns and kept.where(F.col("doc_id").isNull()).count() == 0
    one = labels.where("toxic = 0")
    assert toxicity.scored(d, one).where("predicted = 1").count() == 0
