"""The audit of sources against integer arithmetic over all pairs of groups and all terms."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from eventloom.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term string, value int, p string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], COLUMNS)


def brute(rows, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    out = set()
    for lang in {x for _, x, _ in rows}:
        docs = [(w, s) for w, (_, x, s) in zip(words, rows, strict=True) if x == lang]
        df = Counter(t for w, _ in docs for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= 3)
        count = {s: Counter(t for w, o in docs if o == s for t in w if df[t] >= 3) for s in {s for _, s in docs}}
        all_ = sum(count.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in count.items():
            pair = [(-sum(f(p(c, t), p(d, t)) for t in kept), o.encode(), o) for o, d in count.items() if o != s]
            term = [(-f(p(c, t), p(all_, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(all_, t)]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pair))} | {(lang, s, "term", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(term)[:top])}
    return out


def corpus(n=300, groups=9):
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mi", "éü", "東", "st") for b in "abcdefghijklmnopqrstuvwxyz"] + ["q" * 40]
    rows = []
    for i in range(n):
        s = r.randrange(groups)
        own = vocabulary[7 * s : 7 * s + 30]
        rows.append((" ".join(r.choice(own + vocabulary[:10]) + r.choice(["", "1", ".", "_"]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "de", None]), r.choice([f"s{s}", None]) if s == 2 else f"s{s}"))
    return rows + [(None, "en", "silent"), ("", "en", "s1"), ("one two", "xx", "a"), ("one three", "xx", "b"), (None, None, None), ("word " * 60_000 + "Kaa", "de", "long")] + [("same same Twins", "en", "s0")] * 5


def got(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def test_all_pairs_and_terms_are_exact(spark):
    rows = corpus()
    x = divergence.audited(frame(spark, rows))
    assert x.columns == ["lang", "source", "part", "item", "value", "rank"] and got(x) == brute(rows)


def test_every_split_of_the_work_gives_the_same(spark, monkeypatch):
    rows = corpus(200, 7)
    want = brute(rows, 5)
    for light, block, tile, shares, few in ((0, 2, 3, 2, 0), (100, 3, 1000, 4, 10), (3, 1, 7, 5, 10)):
        for name, v in (("LIGHT", light), ("BLOCK", block), ("TILE", tile), ("SHARES", shares), ("BROADCAST_GROUPS", few), ("TOP", 5)):
            monkeypatch.setattr(divergence, name, v)
        assert got(divergence.audited(frame(spark, rows))) == want


def test_empty_tables_and_large_counts(spark):
    assert divergence.audited(frame(spark, [])).count() == 0
    assert got(divergence.audited(frame(spark, [("a", "en", "x"), (None, "en", "y")]))) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    one = spark.createDataFrame([(10**13, 10**15)], "n long, total long").select(divergence.share(F.col("n"), F.col("total")).alias("p")).first()
    assert one["p"] == 1 + 10**9 * (10**13 + 1) // 10**15
