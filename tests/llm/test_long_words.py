"""Language identification over runs of letters of any length."""

import random
from collections import Counter

import pytest

import numpy as np

from eventloom.llm import langid


def model(counts):
    """A model of the words of some languages."""
    langs, tables = sorted(counts), []
    for k in range(langid.LONGEST + 1):
        rows = sorted((key, i, n) for i, lang in enumerate(langs) for key, n in (counts[lang] if not k else list(langid.grams(counts[lang]))[k - 1]).items())
        tables.append(langid.Table([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float), len(langs)))
    return langid.Model(langs, tables)


@pytest.mark.parametrize("head", [64, 1000])
def test_every_letter_of_a_long_run_counts(head):
    r = random.Random(2)
    words = lambda letters: {"".join(r.choices(letters, k=6)): 3 for _ in range(300)}
    m = model({"one": words("abcdefg"), "two": words("mnopqrs")})
    tail = "".join(r.choices("mnopqrs", k=9000))
    assert m.predict("".join(r.choices("abcdefg", k=head)) + tail)[0] == "two"
    assert m.predict("a" * head + tail)[0] == "two" and m.predict("z" * head + tail)[0] == "two"
    assert not any(len(w) > langid.KEPT for w in m.memo)


def test_pieces_give_the_mean_over_all(monkeypatch):
    r = random.Random(3)
    m = model({"one": {"abcabd": 3, "bca": 1}, "two": {"bcbcd": 2, "dab": 5}})
    w = "".join(r.choices("abcd", k=700))
    whole = m.vectors([w])[0]
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert abs(m.long_word(w) - whole).max() < 1e-12


def brute(counts, text):
    """Sums of log frequencies by plain dictionaries."""
    langs = sorted(counts)
    tables = [counts, *({lang: list(langid.grams(counts[lang]))[k] for lang in langs} for k in range(langid.LONGEST))]
    total = dict.fromkeys(langs, 0.0)
    for w in langid.letter_words(text):
        for k in (0, 4, 3, 2, 1):
            keys = [w] if k == 0 else [f" {w} "[j : j + k] for j in range(len(w) + 3 - k)]
            every = {x for lang in langs for x in tables[k][lang]}
            keys = [x for x in keys if x in every]
            if keys:
                size = {lang: sum(tables[k][lang].values()) + 0.5 * len(every) + 1 for lang in langs}
                for lang in langs:
                    t = tables[k][lang]
                    total[lang] += sum(np.log((t[x] + 0.5) / size[lang] if x in t else 0.5 / max(size.values())) for x in keys) / len(keys)
                break
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(np.exp((total[x] - total[best]) / len(langid.letter_words(text)) ** 0.5) for x in langs)


def test_predictions_by_brute_force():
    r = random.Random(5)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(1, 7)))
    counts = {lang: {word(a): r.randint(1, 9) for _ in range(80)} for lang, a in (("x", "abcdeé"), ("y", "cdefgh"), ("z", "aeghij"))}
    m = model(counts)
    for _ in range(200):
        t = " ".join(r.choice([word("abcdefghijé"), r.choice(list(counts[r.choice("xyz")])), "qq", "7"]) for _ in range(r.randint(1, 12))) + " a"
        (a, p), (b, q) = m.predict(t), brute(counts, t)
        assert a == b and abs(p - q) < 1e-9
    m.most = 3  # words of one text in several turns, each with the cache emptied
    m.memo, m.rows = {}, None
    t = " ".join(word("abcdefghijé") for _ in range(50))
    assert m.predict(t)[0] == brute(counts, t)[0] and abs(m.predict(t)[1] - brute(counts, t)[1]) < 1e-9


def test_fit_keeps_every_language_and_whole_words(spark):
    r = random.Random(6)
    say = lambda i: f"kata{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(k * 1000 + i, f"{say(i)} {say(i)} common", f"l{i:03d}", "x") for i in range(520) for k in range(6)]
    rows += [(10**7 + k, "नमस्ते दुनिया " * 3, "hi", "x") for k in range(9)] + [(10**8, None, "hi", "x"), (None, "loose", "hi", "x")]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, k string")
    m = langid.fit(d)
    assert len(m.langs) == 521 and {"नमस्ते", "दुनिया", say(519)} <= set(m.tables[0].at)
    assert m.predict("नमस्ते")[0] == "hi" and all(m.predict(say(i))[0] == f"l{i:03d}" for i in range(0, 520, 40))
    assert langid.predicted(d.limit(0)).count() == 0


@pytest.mark.parametrize("few", [6, 20, 200])
def test_a_language_of_little_data_isn_t_preferred(spark, few):
    r = random.Random(8)
    make = lambda letters, n: ["".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n)]
    en, de = make("abcdefghijklmnoprst", 1500), make("aeioubdfgklmnrstwzäöü", 400)
    text = lambda ws: " ".join(ws[min(len(ws) - 1, int(r.paretovariate(0.7)) - 1)] for _ in range(40))
    docs = [("en", text(en)) for _ in range(2000)] + [("de", text(de)) for _ in range(few)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    m = langid.fit(df)
    seen = Counter(w for lang, t in docs if lang == "en" for w in t.split())
    rare, once = [w for w, n in seen.items() if 2 <= n <= 5], [w for w, n in seen.items() if n == 1]
    assert [m.predict(" ".join(r.sample(rare, 6)))[0] for _ in range(300)] == ["en"] * 300
    assert sum(m.predict(" ".join(r.sample(once, 6)))[0] == "en" for _ in range(300)) >= 285  # by their n-grams alone
    assert sum(m.predict(" ".join(de[:25][r.randrange(25)] for _ in range(12)))[0] == "de" for _ in range(50)) >= 45
