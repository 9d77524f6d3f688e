"""The pipeline's near-duplicate stage against brute force over planted near copies."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 9) for i, t in enumerate(texts)], DOCS)


def changed(r, text, n):
    ws = text.split()
    for _ in range(n):
        ws[r.randrange(len(ws))] = f"x{r.randrange(10**6)}"
    return " ".join(ws)


def planted():
    r = random.Random(4)
    fresh = lambda k: " ".join(f"w{r.randrange(3000)}" for _ in range(k))
    line = fresh(60)
    texts = [fresh(r.choice([3, 5, 40, 250])) for _ in range(30)] + [line + " " + fresh(k) for k in (5, 10, 14, 20) * 5]
    texts += [changed(r, t, r.choice([1, 2, 5, 7, 9])) for t in texts for _ in range(2)]
    texts += [changed(r, texts[-1], 1) for _ in range(40)]
    return [*texts, None, "", " \n", "a B c", "A b\tC", texts[0].upper()]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if k in (x, y) else k for k in root]
    return root


@pytest.mark.parametrize(("leaders", "sample", "piece"), [(2, 20_000, 1024), (0, 1, 7), (1, 20_000, 3), (0, 20_000, 1024)])
def test_near_copies_by_brute_force(spark, monkeypatch, leaders, sample, piece):
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    texts = planted()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_stage_drops_near_copies(spark):
    texts = planted()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))
    nameless = docs(spark, texts[:2] + [texts[0]]).withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.drop_near_duplicates(spark, nameless, "").count() == 2


def test_a_line_that_the_sample_misses_makes_no_pairs_of_all(spark, monkeypatch):
    """Unlike texts that share a long line: the sample has none of them, the counts over all texts put its shingles last."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "HEAVY", 10)
    r = random.Random(5)
    line = " ".join(f"c{r.randrange(9999)}" for _ in range(60))
    texts = [line + " " + " ".join(f"f{r.randrange(10**6)}" for _ in range(100)) for _ in range(80)]
    df = docs(spark, texts)
    order = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = jaccard._prefixes(df, order)
    shared = lambda: jaccard._keys(rows).groupBy("key").count().agg(F.max("count")).first()[0]
    assert shared() == 80
    for _ in range(jaccard.PASSES):
        if (better := jaccard._heavier(rows, order)) is None:
            break
        order = better
        rows = jaccard._prefixes(df, order)
    assert len(order[0]) and (shared() or 0) <= 10
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(df.union(docs(spark, [texts[3]]))).collect()}
    assert got == {i: i for i in range(80)} | {3: 0}


def test_simhash_comes_first_and_superseded_tables_go(spark, monkeypatch):
    """The closest copies are found by fingerprints, as candidates that are verified; of the stored tables only those that are
    still read stay."""
    from eventloom.llm import common

    r = random.Random(6)
    text = " ".join(f"w{r.randrange(3000)}" for _ in range(900))
    texts = [text, changed(r, text, 1), " ".join(f"v{r.randrange(3000)}" for _ in range(900))]
    asked, kept = [], []
    alike, drop = jaccard._alike, common._drop
    monkeypatch.setattr(jaccard, "_alike", lambda d, k, pairs: (asked.append({(x["u"], x["v"]) for x in pairs.collect()}), alike(d, k, pairs))[1])
    monkeypatch.setattr(common, "_drop", lambda s, path: (kept.append(path.rsplit("/llm-", 1)[1].split("-")[0]), drop(s, path))[1])
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    sets = [jaccard.set_hash(jaccard.shingles(t)) for t in texts[:2]]
    assert asked[0] == {(min(sets), max(sets))}
    assert {"prefixes", "pairs", "sets", "keys", "open"} <= set(kept)


def test_sets_without_a_partner_under_a_key_carry_no_sketch(spark):
    """Of a key's sets only those move with their sketches that another root's set of a similar size meets; all pairs that are possible stay."""
    n = [90, 100, 112, 125, 126, 400, 500, 1000, 1000, 3000]
    rows = [(1, k, m, 0, True, 7 if m == 1000 else k) for k, m in enumerate(n)] + [(2, 0, 90, 12, False, 0), (2, 1, 100, 13, False, 1)]
    x = spark.createDataFrame(rows, "key long, fp long, n long, at int, first boolean, root long")
    kept = jaccard._partnered(x).collect()
    left = {r["fp"] for r in kept if r["key"] == 1}
    alike = {k for k, a in enumerate(n) for j, b in enumerate(n) if rows[k][5] != rows[j][5] and 5 * min(a, b) >= 4 * max(a, b)}
    assert alike == {0, 1, 2, 3, 4, 5, 6} and left == alike and all(r["key"] == 1 for r in kept)


def test_sketches_leave_few_pairs_of_unlike_near_copies():
    """Copies of one text that differ too much: nearly none of their pairs is left to be compared, and no alike pair is lost."""
    r = np.random.default_rng(7)
    fresh = lambda k: r.integers(-(2**63), 2**63 - 1, k)
    for n in (20, 60, 200, 900):
        base = fresh(n)
        sets = [np.unique(np.concatenate([base[r.permutation(n)[: n - n // k]], fresh(n // k)])) for k in (6, 7, 20) for _ in range(20)]
        ends = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
        alike = [9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for a, b in ends]
        left = [jaccard.possible(jaccard.sketch(a), jaccard.sketch(b), len(a), len(b)) for a, b in ends]
        assert all(q for p, q in zip(alike, left, strict=True) if p)
        assert sum(left) - sum(alike) <= 0.1 * len(ends), (n, sum(left), sum(alike), len(ends))
        rows = pd.DataFrame([{"fp": k, "n": len(a), "root": k, "first": True, "piece": 0, "sketch": jaccard.sketch(a)} for k, a in enumerate(sets)])
        assert {tuple(x) for x in jaccard._tile(rows).to_numpy().tolist()} == {(j, i) for (i, j), q in zip(((i, j) for i in range(len(sets)) for j in range(i)), left, strict=True) if q and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))}


def test_components_keep_one_table(spark, monkeypatch):
    """Tables of earlier rounds go with each round; the last one goes when it is discarded."""
    from eventloom.llm import common, components

    made, gone = [], []
    store, drop = components.stored, common._drop
    monkeypatch.setattr(components, "stored", lambda df, *a: (made.append(store(df, *a)), made[-1])[1])
    monkeypatch.setattr(common, "_drop", lambda s, path: (gone.append(path), drop(s, path))[1])
    roots = components.components(spark.createDataFrame([(k, k + 1) for k in range(20)], "u long, v long"))
    assert {tuple(x) for x in roots.collect()} == {(k, 0) for k in range(21)}
    assert len(made) > 2 and len(gone) == len(made) - 1
    common.discard(roots)
    assert len(gone) == len(made)


def tags(monkeypatch, *modules):
    """The tags of the tables that some modules store from here on."""
    made = []
    for m in modules:
        store = m.stored
        monkeypatch.setattr(m, "stored", lambda df, tag, *a, store=store: (made.append(tag), store(df, tag, *a))[1])
    return made


def test_stars_take_no_round_of_components(spark, monkeypatch):
    """The driver plans no round for what is settled, nor one more to see that it is."""
    from eventloom.llm import components

    made = tags(monkeypatch, components)
    stars = [(k, k % 3) for k in range(3, 30)] + [(1, 1)]
    assert {tuple(x) for x in components.components(spark.createDataFrame(stars, "u long, v long")).collect()} == {(k, k % 3) for k in range(30)}
    assert made == ["edges"]
    two = [(5, 1), (5, 2), (9, 7), (7, 4)]
    assert {tuple(x) for x in components.components(spark.createDataFrame(two, "u long, v long")).collect()} == {(1, 1), (2, 1), (5, 1), (4, 4), (7, 4), (9, 4)}


def test_steps_without_pairs_plan_nothing_more(spark, monkeypatch):
    """Unlike texts: no step makes sets of no pairs or components of no links."""
    from eventloom.llm import components

    made = tags(monkeypatch, jaccard, components)
    texts = [" ".join(f"{k}w{j}" for j in range(40)) for k in range(6)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(docs(spark, [*texts, texts[2]])).collect()}
    assert got == {k: k for k in range(6)} | {6: 2}
    assert not {"sets", "links", "edges"} & set(made)
