"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns;
and brute-force versions where SQL can't express an operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import bwt, chat, decontam, langid, mixing, quality, secrets, simhash, toxicity, urls
from eventloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, spans string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def docs(spark, rows):
    """Rows (doc_id, text[, lang, source]) with extra columns whose names clash."""
    full = [(*r, *("en", "s0")[len(r) - 2 :], len(r[1] or ""), 7, "x") if len(r) < 4 else (*r, len(r[1] or ""), 7, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def some_texts(n=40, seed=3):
    r = random.Random(seed)
    t = [" ".join(r.choice(WORDS) + r.choice(["", ".", "\n"]) for _ in range(r.randint(0, 120))) for _ in range(n)]
    return t + [t[5], t[5] + " tail", None, "", "  \n\t", t[7][:60] + t[9]]


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_mix_reaches_targets(spark):
    texts = some_texts(60)
    d = docs(spark, [(i, t, "en", [None, "a", "b", "c"][i % 4]) for i, t in enumerate(texts)])
    x = mixing.mixed(d).toPandas()
    assert len(x) == len(texts) and (x["taken"] <= 2 * x["size"]).all()
    assert [int(s) for s in x.sort_values("doc_id")["size"]] == [len((t or "").split()) for t in texts]
    y = x.merge(d.select("doc_id", "source").toPandas(), on="doc_id").fillna({"source": "~"}).groupby("source").agg(t=("taken", "sum"), g=("target", "first"))
    assert (abs(y["t"] - y["g"]) <= mixing.BLOCK + 1).all()
    assert x.sort_values("doc_id").equals(mixing.mixed(d).toPandas().sort_values("doc_id")) or (x.sort_values("doc_id")["taken"].to_list() == mixing.mixed(d).toPandas().sort_values("doc_id")["taken"].to_list())
    assert mixing.mixed(d.limit(0)).count() == 0


def test_shards_hold_what_the_mix_takes(spark):
    texts = some_texts(60)
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4]) for i, t in enumerate(texts)] + [(70, "once more " * 300, "en", "a")] * 3
    d = docs(spark, [(i, t and " ".join(f"d{i}.{w}" for w in re.findall(r"[^\x20\x09-\x0d]+", t)), *r) for i, t, *r in rows]).withColumnRenamed("spans", "slot")
    want = {r["doc_id"]: r["n"] for r in mixing.mixed(d).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r["n"]}
    got = mixing.shards(d).collect()
    n: dict[int, int] = {}
    for r in got:
        ws = r["text"].split(" ")
        assert len(ws) <= mixing.BLOCK and [int(w[1:].partition(".")[0]) for w in ws] == sorted((int(w[1:].partition(".")[0]) for w in ws), key=r["doc_ids"].index)
        for w in ws:
            n[int(w[1:].partition(".")[0])] = n.get(int(w[1:].partition(".")[0]), 0) + 1
    assert n == want and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(got, key=key) == sorted(mixing.shards(d).collect(), key=key)
    assert mixing.shards(d.limit(0)).count() == 0 and mixing.shards(d.where("text is null")).count() == 0


def test_water_fill_and_permutation():
    t = mixing.water_fill([10, 100, 100], [3, 1, 2], 1.5, 2.0)
    assert t[0] == 20 and abs(sum(t) - 315) < 1e-9 and max(b / a for a, b in zip([10, 100, 100], t, strict=True)) <= 2
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))) == list(range(n))


def test_quality_counts_and_verdicts(spark):
    good, junk = "the cat sat on the old mat and then it went away again to a place ", "zq$$$ xx### vv&&& kk%%% "
    r = random.Random(0)
    texts = [" ".join(r.sample((good * 8).split(), 70)) for _ in range(40)] + [" ".join(r.sample((junk * 30).split(), 70)) for _ in range(10)] + some_texts(10)
    lab = spark.createDataFrame([(i, int(i < 40), 0) for i in range(50)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.judged(docs(spark, list(enumerate(texts))), lab))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        seen, dup, pos, cov = set(), 0, {}, set()
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\n\v\f"):
                dup += line in seen
                seen.add(line)
        for k in range(len(w) - 2):
            pos.setdefault(tuple(w[k : k + 3]), []).append(k)
        for v in pos.values():
            if len(v) > 1:
                cov |= {k + j for k in v for j in range(3)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cov))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(cov) > 50 * len(w))
    assert min(got[i]["score"] for i in range(40)) > max(got[i]["score"] for i in range(40, 50))
    assert not any(r["kept"] for r in quality.judged(docs(spark, [(1, None), (None, "")]), lab).collect())


def test_chat_folds_and_reads_back(spark):
    e = spark.createDataFrame(
        [(1, 0, 0, "message", "user", "a <|im_end|> ~</s>"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "draft"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "fin"), (1, 1, 5, "delta", None, "al [~INST]"), (1, 70, 6, None, "user\n~", None), (None, None, 0, None, None, "x"), (2, 0, 1, "message", "user", "old"), (2, 0, 2, "edit", "user", "new")],
        "conv_id long, turn long, seq long, kind string, role string, text string",
    )
    got = rows_of(chat.read_back(chat.formatted(e)), "conv_id")
    turns = "user\na <|im_end|> ~</s>\nassistant\nfinal [~INST]\nuser\n~\n\n"
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1]["loss_chars"] == 13 and got[1]["loss_sha256"] == hashlib.sha256(b"final [~INST]").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"user\nnew\n").hexdigest() and got[None]["n_turns"] == 1
    whole = rows_of(chat.assembled(chat.formatted(e)), "conv_id")[1]["formatted"]
    assert len(whole) == got[1]["formatted_chars"] and whole.count("<|im_end|>") == 3
    assert chat.read_back(chat.formatted(e.limit(0))).count() == 0


def test_secret_spans(spark):
    key, hexa, tok = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef01234567", "aB3" * 8
    texts = [f"é password = \"{hexa}\" and {key}x", "token=abc secret: abcdef", f"see {tok} here", f"{key} {key}", None, "", f"TOKEN='{'a1' * 500}'"] + [f"example {'zZ9' * 9}"] * 3
    d = docs(spark, [(i, t, "en", f"s{i}") for i, t in enumerate(texts)])
    got = rows_of(secrets.scan(d))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(b["start"], b["kind"], b["end"]) for b in got[i]["base"]] == sorted(want)
    assert [s["kind"] for s in got[2]["spans"]] == [3] and not got[7]["spans"]
    out = rows_of(secrets.redacted(d))
    assert out[0]["text"] == "é [REDACTED]\" and [REDACTED]x" and out[4]["text"] is None and out[1]["text"] == "token=abc [REDACTED]" and out[0]["n_chars"] == len(out[0]["text"]) and out[3]["text"] == "[REDACTED] [REDACTED]"


def test_many_spans_in_one_text(spark):
    t = " ".join(f"token=abcdef{i}" for i in range(700))
    r = secrets.redacted(docs(spark, [(1, t), (1, t)])).collect()
    assert [x["text"] for x in r] == [" ".join(["[REDACTED]"] * 700)] * 2


def test_names_of_columns_stay(spark):
    rows = [(1, "token=abcdef1", "s", "a", "b", "c", "d", "e"), (1, "token=abcdef1", "s", "a2", "b", "c", "d", "e"), (2, "plain", "s", "a", "b", "c", "d", "e")]
    for names in (("_t", "_id", "_h", "_s", "hit"), ("span_id", "span_hash", "SPAN_LIST", "text_hash", "hash"), ("none", "id", "hash", "value_hash", "rid")):
        d = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"{n} string" for n in names)]))
        got = sorted(map(tuple, secrets.redacted(d).collect()))
        assert got == sorted((r[0], "[REDACTED]" if r[0] == 1 else r[1], *r[2:]) for r in rows)
        kept = simhash.deduplicated(d)
        assert kept.columns == d.columns and kept.count() == 2 and all(r[3].startswith("a") and r[4:] == ("b", "c", "d", "e") for r in map(tuple, kept.collect()))
    assert secrets.redacted(d.limit(0)).count() == 0 and secrets.scan(d.limit(0)).count() == 0 and simhash.deduplicated(d.limit(0)).count() == 0


def test_many_candidates_beside_many_base_spans(spark):
    r = random.Random(3)
    made = lambda k: "".join(r.choices("abcXYZ012", k=k)) + "aA1"
    t = " ".join(r.choice([f"token={made(24)}", made(30), f"secret: {made(20)}", "0123456789abcdef" * 2 + "Zz" + made(9)]) for _ in range(1500))
    got = secrets.found(docs(spark, [(1, t)]), F.col("doc_id"), F.col("source")).first()
    base = [(b["start"], b["end"]) for b in got["base"]]
    every = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    assert [(m["start"], m["end"]) for m in got["more"]] == [(a, b) for a, b in every if not any(x < b and a < y for x, y in base)] and len(base) > 500


def test_decontamination(spark):
    r = random.Random(5)
    item = [f"w{r.randint(0, 999)}" for _ in range(40)]
    changed = [x if i % 7 else "zzz" for i, x in enumerate(item)]
    clean = [f"v{r.randint(0, 999)}" for _ in range(300)]
    texts = [" ".join(clean), " ".join(clean[:50] + item + clean[50:]), " ".join(clean[:90] + changed), " ".join(item[:9] + clean), None, "", " ".join(item[10:34]).upper()]
    items = spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item)), (6, "short one"), (7, None)], "item_id long, text string")
    d = docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in decontam.overlaps(d, items).collect()}
    assert set(got) == {1, 2, 6} and got[1]["n_equal"] == 40 and got[1]["doc_start"] == 50 and got[6]["doc_start"] == -10
    assert {r["doc_id"] for r in decontam.decontaminated(d, items).collect()} == {0, 3, 4, 5}
    assert decontam.decontaminated(d, items.limit(0)).count() == 7 and decontam.overlaps(d.limit(0), items).count() == 0


def test_language(spark):
    en, de = "the house and the garden with of", "das haus und der garten mit von"
    r = random.Random(1)
    rows = [(i, " ".join(r.choices((en if i % 2 else de).split(), k=20)), "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(90, None, "en", "s"), (91, "123 $$", None, "s"), (92, "Gartens hauses", None, "s"), (None, "the house", "en", "s")]
    got = langid.predicted(docs(spark, rows)).collect()
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= by[i]["score"] <= 1 and by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60))
    assert by[90]["lang_pred"] == by[91]["lang_pred"] == "und" and by[92]["lang_pred"] == "de" and len(got) == len(rows)
    assert langid.predicted(docs(spark, [(1, "x", None, "s")])).first()["lang_pred"] == "und"


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(spark):
    texts = some_texts() + ["ÄB c", "Äb C d", "x y"]
    got = rows_of(simhash.near_duplicates(docs(spark, list(enumerate(texts)))))
    fps = [fingerprint(t) for t in texts]
    assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == groups(fps)
    kept = simhash.deduplicated(docs(spark, [*enumerate(texts), (0, texts[0])]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(fps)))


@pytest.mark.parametrize("most", [64, 4])
def test_hot_blocks_give_the_same_components(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
    r, fps = random.Random(2), [0]
    for _ in range(120):
        f = r.choice(fps)
        for _ in range(r.choice([1, 2, 3, 9])):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x["node"]: x["root"] for x in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want, seen = groups(fps), {}
    for f, g in zip(signed, want, strict=True):
        seen.setdefault(g, set()).add(got.get(f, f))
    assert all(len(s) == 1 for s in seen.values()) and len({min(s) for s in seen.values()}) == len(seen)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100
    assert components(e.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.B.Example.net/en/x?q"), (2, "http://example.com/de/"), (3, "http://x.org/fr/#t"), (4, "http://x.net"), (5, None), (6, "no scheme"), (7, "http://bad.org/a"), (8, "http://bad.org/b"), (9, "http://Ä.ORG?x"), (9, "http://Ä.ORG?x")]
    p = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(p, spark.createDataFrame([(7, 1), (8, 1), (1, 0)], "page_id long, bad int")).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3)] == [("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (got[1]["host"], got[1]["path"]) == ("a.b.example.net", "/en/x") and got[4]["rule"] is None and (got[5]["host"], got[6]["path"]) == ("", "")
    assert got[9]["host"] == "Ä.org" and urls.judged(p, spark.createDataFrame([], "page_id long, bad int")).where("verdict = 'block' and rule is null").count() == 0
    many = spark.createDataFrame([(i, f"http://{'spam' if i < 40 else 'fine'}.org/{i}") for i in range(80)], "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in urls.judged(many, spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)], "page_id long, bad int")).collect()}
    assert out[1] == "block" and out[41] == "allow"


def test_substrings_by_brute_force(spark):
    r = random.Random(4)
    base = "".join(r.choice("abcdé \n") for _ in range(400))
    texts = ["".join(r.choice("abcdé \n") for _ in range(r.randint(0, 300))) for _ in range(20)]
    texts += [base, "x" + base[:200] + "y" + base[150:], base[100:170], base, None, "", "z" * 300, "z" * 120, texts[3] + base[5:80] + texts[4]]
    ids = [*range(len(texts))]
    r.shuffle(ids)
    got = rows_of(bwt.deduplicated(docs(spark, [*zip(ids, texts, strict=True), (None, base)])))
    first: dict[bytes, int] = {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert got[None]["n_removed"] == 0 and bwt.deduplicated(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_merged_transforms_are_the_sorted_suffixes():
    r = np.random.default_rng(0)
    texts = [np.append(r.integers(97, 100, n), bwt.END).astype(np.uint8) for n in (40, 7, 90)]
    got = [bwt.transform(t, 50) for t in texts]
    row, lcp = bwt.merged([b for _, b in got], 50)
    starts = [(t, o) for t, (order, _) in zip(texts, got, strict=True) for o in order]
    keys = [bytes(np.roll(t, -o)[np.arange(50) % len(t)]) for t, o in starts]
    seq = [keys[i] for i in row]
    assert seq == sorted(keys)
    assert all(x == next((k for k in range(50) if a[k] != b[k]), 50) for a, b, x in zip(seq, seq[1:], lcp[1:], strict=False))


def test_toxicity(spark):
    r, bad = random.Random(6), ["idiotic", "scumbag", "trashy"]
    rows = [(i, " ".join(r.choices(WORDS, k=40) + (r.choices(bad, k=4) if i % 4 == 0 else []))) for i in range(300)]
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*rows, (900, None), (901, ""), (None, "idiotic scumbag trashy")])
    got = toxicity.scored(d, lab).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == 303 and all(by[i]["predicted"] == int(i % 4 == 0) for i in range(300)) and by[900]["predicted"] == by[901]["predicted"] == 0 and by[None]["predicted"] == 1
    assert all(0 <= x["score"] <= 1 for x in got) and by[0]["evidence"].split()[0].endswith(":1")
    assert toxicity.scored(d, lab.limit(0)).where("score = 0.5").count() == 303


def test_pruned_search_is_exhaustive():
    r = np.random.default_rng(1)
    x = r.random((300, 40)) * (r.random((300, 40)) < 0.2)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rows, cols = np.nonzero(x)
    ix = toxicity.Index([f"t{i:03d}" for i in range(40)], np.ones(40), rows, cols, x[rows, cols], (r.random(300) < 0.5).astype(int), list(range(300)), 0.5, k=5)
    for q in x[:50]:
        t = np.nonzero(q)[0]
        best, sims = ix.nearest(t, q[t])
        assert np.allclose(sims, np.sort(x @ q)[::-1][:5])


def test_prefix_sums(spark):
    from eventloom.llm.common import running_totals

    a = [random.Random(7).randint(0, 9) for _ in range(1000)]
    r = spark.createDataFrame([(a,), ([],), ([3],)], "a array<int>").select(running_totals(F.col("a")).alias("s")).collect()
    assert r[0]["s"] == np.cumsum(a).tolist() and r[1]["s"] == [] and r[2]["s"] == [3]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(60)), "en", f"s{i % 3}", 9) for i in range(60)]
    rows[10] = (10, rows[9][1], "en", "s0", 9)
    rows[20] = (20, rows[20][1] + " " + " ".join(f"q{k}" for k in range(30)), "en", "s1", 9)
    rows[30] = (30, rows[30][1] + " password=abcdef123", "en", "s1", 9)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
    kept = rows_of(at)
    assert set(kept) == set(range(60)) - {10, 20} and kept[30]["text"].endswith(" [REDACTED]")
    whole = {w for r in kept.values() for w in r["text"].split()}
    assert {i for r in got for i in r["doc_ids"]} <= set(kept) and {w for r in got for w in r["text"].split()} <= whole and len(got) > 20


def test_pipeline_takes_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    extra = "doc_id long, text string, lang string, source string, n_chars long, hash string, hit string, span_id string"
    rows = [(1, "some words of one text that stays here", "en", "a", 38, "x", "y", "z"), (1, "some words of one text that stays here", "en", "a", 38, "x", "y", "z"), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, None, None, None), (None, "a text without an id token=abcdef99 in it", "en", None, 7, None, None, None), (5, "word " * 30_000, "en", "b", 1, None, None, None)]
    d = spark.createDataFrame(rows, extra)
    labels, bench = spark.createDataFrame([(9, None, None)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    for k, (x, y, z) in enumerate([(d, labels, bench), (d.limit(0), labels.limit(0), bench.limit(0))]):
        for df, name in ((x, "documents"), (y, "labels"), (z, "benchmark")):
            df.write.parquet(str(tmp_path / str(k) / f"{name}.parquet"))
        at = x
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path / str(k)))
            assert at.columns == d.columns
        got = corpus_pipeline.run(spark, str(tmp_path / str(k))).collect()
        assert {i for r in got for i in r["doc_ids"]} <= ({1, 5, None} if k == 0 else set())
        assert k or (sorted(str(r["doc_id"]) for r in at.collect()) == ["1", "2", "5", "None"] and not any("abcdef99" in r["text"] for r in got))


def test_hosts_without_ports_and_suffixes_from_a_table(spark):
    hosts = ["10.0.0.1", "192.168.0.1:80", "a.example.com.", "b.example.com:8080", "u:p@c.example.com", "one.github.io", "two.github.io", "github.io", "x.co.uk", "www.x.co.uk", "com", "", "[::1]:8080", "deep.a.b.c.example.org"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in urls.with_suffixes(df, None).collect()}
    assert got["10.0.0.1"] == ("10.0.0.1",) * 2 and got["192.168.0.1:80"] == ("192.168.0.1",) * 2 and got["[::1]:8080"] == ("[::1]",) * 2
    assert {got[h] for h in hosts[2:5]} == {("example.com", "com")} and got["one.github.io"] == ("github.io", "io")
    assert got["www.x.co.uk"] == got["x.co.uk"] == ("x.co.uk", "co.uk") and got["com"] == ("com", "com") and got[""] == ("", "")
    table = spark.createDataFrame([("github.io", 1), ("GitHub.io", 1), ("b.c.example.org", 1), ("io", 1), (None, 1)], "suffix string, host int")
    own = {r["host"]: (r["domain"], r["suffix"]) for r in urls.with_suffixes(df, table).collect()}
    assert own["one.github.io"] == ("one.github.io", "github.io") and own["two.github.io"][0] == "two.github.io" and own["github.io"] == ("github.io", "github.io")
    assert own["deep.a.b.c.example.org"] == ("a.b.c.example.org", "b.c.example.org") and {h: own[h] for h in hosts[:5]} == {h: got[h] for h in hosts[:5]}
    pages = spark.createDataFrame([(i, f"http://{'one' if i < 40 else 'two'}.github.io/{i}") for i in range(80)], "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)], "page_id long, bad int")
    assert {r["page_id"] for r in urls.judged(pages, bad, suffixes=table).where("verdict = 'block'").collect()} == set(range(40))
    assert urls.judged(pages.limit(0), bad).count() == 0
    long = urls.judged(spark.createDataFrame([(1, "http://" + "a." * 100_000 + "com/" + "p" * 100_000)], "page_id long, url string"), bad).first()
    assert len(long["host"]) == 200_003 and long["verdict"] == "allow"
