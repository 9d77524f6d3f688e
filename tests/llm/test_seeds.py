"""No pattern of substitutions that leaves 80 % of a window escapes the seeds; overlaps by brute force."""

import random
import re
from itertools import combinations

import pytest

from eventloom.llm import decontam


@pytest.mark.parametrize("n", range(decontam.MIN_TOKENS, 21))
def test_no_pattern_escapes(n):
    placed = [sum(1 << at + k for k in m) for m in decontam.MASKS for at in range(n - m[-1])]
    lost = [c for c in combinations(range(n), n // 5) if all(sum(1 << i for i in c) & p for p in placed)]
    assert not lost


def test_overlap_found_at_the_lost_patterns(spark):
    cases = [(8, (1,)), (15, (3, 7, 11))]
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n))) for n, _ in cases]
    docs = [(n, " ".join("other" if i in c else f"t{n}x{i}" for i in range(n))) for n, c in cases]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_equal"]) for r in got.collect()} == {(8, 8, 7), (15, 15, 12)}


def brute(texts, items):
    """Every document and item of which some alignment has a window that agrees enough."""
    toks = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    out = {}
    for i, t in texts:
        h = toks(t)
        for k, s in items:
            ih = toks(s)
            w = min(20, len(ih))
            for d in range(-len(ih) + 1, len(h)) if ih else ():
                a = [h[d + j] == ih[j] for j in range(len(ih)) if 0 <= d + j < len(h)]
                best = max(sum(a[x : x + w]) for x in range(max(1, len(a) - w + 1))) / w
                if best >= 0.8:
                    out[i, k] = max(out.get((i, k), (0, 0, 0)), (best, sum(a), -d))
    return out


def substituted(r, ws, n):
    ws = list(ws)
    for k in r.sample(range(len(ws)), n):
        ws[k] = f"other{r.randrange(99)}"
    return ws


def test_overlaps_by_brute_force(spark):
    r = random.Random(9)
    items = [(n, " ".join(f"t{n}x{k}" for k in range(n))) for n in (1, 2, 4, 5, 6, 7, 8, 13, 20, 27, 44)] + [(60, "go go go go go go go go stop"), (61, ""), (62, None)]
    clean = lambda n: [f"c{r.randrange(500)}" for _ in range(n)]
    texts = []
    for _, s in items[:-2]:
        ws = s.split()
        for share in (0, 0.1, 0.2, 0.3):
            texts.append(clean(r.randrange(30)) + substituted(r, ws, int(share * len(ws))) + clean(r.randrange(30)))
        texts += [ws[: -(len(ws) // 5) or None], ws[len(ws) // 5 :] + clean(5), clean(3) + ws[1:], ws + ws]
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "go " * 60)]
    got = decontam.overlaps(spark.createDataFrame([*texts, texts[3]], "doc_id long, text string"), spark.createDataFrame([*items, items[2]], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (x["best"], x["n_equal"], -x["doc_start"]) for x in got} == brute(texts, items) and len(got) == len(brute(texts, items))


def test_short_items_and_evidence(spark):
    d = spark.createDataFrame([(1, "so one two three four five six seven on", "x"), (2, "one", "x"), (3, "nothing", "x")], "doc_id long, text string, hit string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(d, items).collect()} == {(1, 1), (1, 2), (2, 2)}
    kept = decontam.decontaminated(d, items)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == {2, 3}


def test_a_very_long_text_by_either_join(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [" ".join(r.choices(vocabulary, k=n)) for n in (3, 6, 8, 12, 25, 60)] * 2
    long = r.choices(vocabulary, k=20_000)
    for k, item in enumerate(items):
        ws = item.split()
        if len(ws) > 8:
            ws[3] = "other"
        long[1500 * k + 40 : 1500 * k + 40 + len(ws)] = ws
    texts = [(1, " ".join(long)), (1, items[4]), (None, items[5]), (None, "tail " + items[3]), (2, items[4] + " " + items[4]), (2, items[4] + " " + items[4]), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, k string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    key = lambda: sorted(map(str, decontam.overlaps(docs, bench).collect()))
    want = key()
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert key() == want and len(want) == 18
