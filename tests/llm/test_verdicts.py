"""Quality scores and the ownership of secrets by brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import xxhash

from eventloom.llm import quality, secrets

COLUMNS = "doc_id long, text string, lang string, source string, score string, owner int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", 1) for i, t, s in rows], COLUMNS)


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def buckets(text):
    """Unigram and bigram buckets of a text; the last token's bigram has no second token."""
    tok = re.findall(r"[a-z0-9]+|[^\sa-z0-9]+", (text or "").lower())
    h = lambda b, seed: xxhash.xxh64_intdigest(b, seed)
    out = []
    for x, y in zip(tok, [*tok[1:], None][: len(tok)], strict=True):
        one = h(x.encode(), 42)
        two = h((1).to_bytes(4, "little"), h(y.encode(), one) if y is not None else one)
        out += [signed(one) % quality.BUCKETS, signed(two) % quality.BUCKETS]
    return out


def test_quality_scores_by_brute_force(spark):
    r = random.Random(1)
    good, bad = "the cat sat on a mat and then it went home to rest again for a while".split(), "buy now cheap $$$ win !! click ### free".split()
    rows = [(i, " ".join(r.choice(good if i % 3 else good + bad * (i % 5)) for _ in range(r.randint(0, 90))), "s") for i in range(120)] + [(200, None, "s"), (201, "", "s"), (7, "the cat sat " * 30, "s"), (None, "a mat and a mat", "s"), (300, "Home! " * 4000, "s")]
    labels = [(i, int(i % 2), 0) for i in range(60)] + [(None, 1, 0), (7, 1, 0), (8, None, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    raw, fine = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(buckets(t))
        if i in trusted:
            fine.update(buckets(t))
    half = 0.5 * quality.BUCKETS
    ratio = lambda b: math.log(fine[b] + 0.5) - math.log(fine.total() + half) - math.log(raw[b] + 0.5) + math.log(raw.total() + half)
    want = sorted((str(i), round(sum(map(ratio, buckets(t))) / len(buckets(t)), 4) if buckets(t) else 0.0) for i, t, _ in rows)
    got = quality.judged(frame(spark, rows), lab).collect()
    assert all(abs(a[1] - b[1]) < 2e-4 and a[0] == b[0] for a, b in zip(want, sorted((str(x["doc_id"]), round(x["score"], 4)) for x in got), strict=True))
    assert all(x["kept"] == (not x["base_failed"] and x["score"] >= quality.THRESHOLD) for x in got) and len({x["kept"] for x in got}) == 2
    assert quality.judged(frame(spark, rows).limit(0), lab).count() == 0


def test_ownership_by_brute_force(spark):
    r = random.Random(2)
    value = lambda n: "".join(r.choices("abcXYZ019", k=n)) + "aZ1"
    pool = [value(r.choice([20, 24, 30])) for _ in range(25)]
    rows = []
    for i in range(160):
        s = r.choice([None, "a", "b", "c", "d"])
        parts = [r.choice(["plain words", f"token={r.choice(pool)}", r.choice(pool), r.choice(pool), "AKIA" + "ABCDEFGH12345678", "0123456789abcdef" * 2, f"secret: {r.choice(pool)}", f"see {value(22)} once"]) for _ in range(r.randint(0, 6))]
        rows.append((i, " ".join(parts), s))
    rows += [(500, f"only here {pool[0][::-1]}aB1", "a")] + [(600 + k, "one owner many places " + "qwErtY1234567890zzzzZ", "c") for k in range(secrets.EXAMPLE_REPOS)] + [(None, f"nobody {pool[1]}", None), (700, None, "a"), (701, "", "a")]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans, seen = {}, defaultdict(set)
    for i, t, s in rows:
        t = t or ""
        base = [(m.start(), 0, m.end(), m[1]) for m in assign.finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]{16,}", t)] + [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]{24,}", t)]
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t) if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        more = [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
        spans[i] = (sorted(base), more)
        for x in (*base, *more):
            seen[x[3]].add((s, i))
    example = {v: len({s for s, _ in o}) >= secrets.EXAMPLE_OWNERS or len(o) >= secrets.EXAMPLE_REPOS for v, o in seen.items()}
    assert len(set(example.values())) == 2
    for x in secrets.scan(frame(spark, rows)).collect():
        base, more = spans[x["doc_id"]]
        want = sorted([*base, *[m for m in more if not example[m[3]]]])
        assert [(s["start"], s["kind"], s["end"], s["value"]) for s in x["spans"]] == want
        assert all(s["example"] == example[s["value"]] and s["n_owners"] == len({o for o, _ in seen[s["value"]]}) for s in x["spans"])
