"""Numbering, counters, keys, order and exact sums: loaders and sinks that agree at any number of partitions."""

import json
import math
import random
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from toy import SCHEMA, events, rows

from eventloom import api, streaming
from eventloom.evaluator import Evaluator
from eventloom.language import analyse
from eventloom.operators.cutflow import cutflow
from eventloom.operators.exactsum import exponent, gathered, summed, totals
from eventloom.operators.prefix import prefix_sums
from eventloom.plans.planner import plan
from eventloom.prover.boundaries import boundary_flips
from eventloom.sources import CounterError, ingest, numbered_lines, read_jsonl, read_numbered, rechunked, sinks, toy_events
from eventloom.sources.profiles import ignored_tag_bits, unmapped_classes
from eventloom.sources.validate import LoadError, check_events
from eventloom.streaming import incremental

JETS = "region r\n  select size(Jet) >= 1\n  select MET > 5\n"


@pytest.fixture
def splits(spark):
    """Sets how many bytes a split has at most."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def use(n: int, files: int = 1) -> None:
        for name, v in zip(names, (n, 1, files), strict=True):
            spark.conf.set(name, str(v))

    yield use
    for name in names:
        spark.conf.unset(name)


# -- lines and their numbers ---------------------------------------------------------
@pytest.mark.parametrize("size", [37, 200, 1 << 20])
def test_numbers_are_dense_at_any_split(spark, tmp_path, splits, size):
    r = random.Random(size)
    want, n = [], 0
    for name in ("b.jsonl", "a.jsonl", "c.jsonl", "empty.jsonl"):
        lines = [r.choice(["", " \t", f'{{"k{i}":{i}}}', f'{{"k{i}":{i}, "x":{"1" * r.randint(1, 60)}}}']) for i in range(0 if name == "empty.jsonl" else 90)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        for k, x in enumerate((tmp_path / name).read_text().split("\n")[:-1], 1):
            if x.strip():
                want.append((n, name, k, x))
                n += 1
    splits(size)
    got = numbered_lines(spark, str(tmp_path))
    assert sorted((r["ordinal"], r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got.collect()) == want
    assert size > 100 or got.rdd.getNumPartitions() > 3


def test_the_first_bad_line_of_several_files(spark, tmp_path, splits):
    good = '{"jet":[{"pt":3}],"met":9}\n'
    (tmp_path / "one.jsonl").write_text(good * 40 + "\n" + good * 3)
    (tmp_path / "two.jsonl").write_text("\n\n" + good * 50 + '{"met":"x"}\n' + good + "junk\n")
    (tmp_path / "zzz.jsonl").write_text("junk\n" + good)
    splits(64)
    a = analyse(JETS)
    with pytest.raises(LoadError, match=r"line 53 of .*two\.jsonl: MET is neither"):
        read_numbered(spark, str(tmp_path), a)
    told = read_numbered(spark, str(tmp_path), a, refuse=False).where("_parse_error is not null").orderBy("event")
    assert [(r["event"], r["_line"], r["_file"][-9:]) for r in told.collect()] == [(93, 53, "two.jsonl"), (95, 55, "two.jsonl"), (96, 1, "zzz.jsonl")]
    fine = read_numbered(spark, str(tmp_path / "one.jsonl"), a)
    assert sorted(r["event"] for r in fine.select("event").collect()) == list(range(43)) and api.run(a, fine).counts.first()["passed"] == 43


# -- keys ----------------------------------------------------------------------------
BAD = {
    '{"MET":5,"MissingET":9}': "there twice",
    '{"MET":5,"met":5}': "there twice",
    '{"Jet":[],"jet":[]}': "there twice",
    '{"AK4jets":[],"jet":[{"pt":1}]}': "there twice",
    '{"weight":1,"Weight":1}': "there twice",
    '{"Lumi":1,"LUMI":2}': "there twice",
    '{"Jet":[{"pt":1,"m":1,"mass":1}]}': "two properties",
    '{"Tau":[{"pt":1,"q":1,"charge":1}]}': "two properties",
    '{"MET":{"pt":1,"PT":2}}': "two properties",
    '{"triggers":{"a":1,"A":0}}': "two flags",
    '{"Jet":[]} {"Jet":[]}': "alone on its line",
    '{"Jet":[]}{"Jet":[]}': "alone on its line",
    '{"Jet":[]},{"Jet":[]}': "alone on its line",
    '{"Jet":[]}]}': "alone on its line",
    '{"HT":"5"}': "alone on its line",
    '{"run":"a"}': "run is neither",
    '{"flag":true}': "flag is neither",
    '{"other":{"pt":1}}': "other is neither",
    '{"Jet":[{"pt":1,"tags":[1]}]}': "no array of objects",
    '{"Jet":[{"pt":1,"btag":2}]}': "tag that is neither",
    '{"Photon":[{"pt":-1}]}': "negative pt",
    '{"Photon":[{"energy":-1}]}': "negative pt or e",
    '{"MET":-1}': "negative pt",
    '{"ST":-2}': "is negative",
    '{"triggers":{"a":2}}': "neither 0 nor 1",
    '{"Muon":[{"pt":1},{"eta":1},{"pt":2}]}': "doesn't fall in pt",
    '{"Muon":[{"pt":1e999}]}': "isn't finite",
    '{"weight":"w"}': "weight is no",
}


def test_clashes_and_domains_are_told_and_never_raise_by_themselves(spark, tmp_path):
    good = ['{"Jet":[{"pt":5,"m":null}],"Q\\"{[":3,"MET":{"phi":1}}', "{}", '{ "x" : 1.5e-3 , "Jet" : [ { } , {"pt":2} ] }', '{"MET":null}', '{"weight":-1,"triggers":{}}']
    (tmp_path / "e.jsonl").write_text("".join(x + "\n" for x in [*BAD, *good]))
    got = {r["event"]: r["_parse_error"] for r in read_jsonl(spark, str(tmp_path / "e.jsonl"), analyse(JETS), refuse=False).coalesce(1).collect()}
    assert len(got) == len(BAD) + len(good)
    for k, (line, what) in enumerate(BAD.items()):
        assert what in (got[k] or ""), (line, got[k])
    assert all(got[k] is None for k in range(len(BAD), len(got)))


# -- counters --------------------------------------------------------------------------
def test_prefix_sums_by_brute_force(spark):
    r = random.Random(1)
    data = [(r.randrange(-50, 5000), r.randint(0, 9), "z") for _ in range(400)] + [(None, 5, "z")]
    df = spark.createDataFrame(data, "k long, v int, chunk string")
    for width in (3, 64, 4096):
        got = sorted((x["k"] is None, x["k"] or 0, x["v"], x["before"]) for x in prefix_sums(df, "k", F.col("v"), "before", width).collect())
        assert got == sorted((k is None, k or 0, v, None if k is None else sum(w for j, w, _ in data if j is not None and j < k)) for k, v, _ in data)
    assert prefix_sums(df.limit(0), "k", F.col("v"), "before").count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_flat_leaves_are_cut_by_their_counters(spark, block):
    r = random.Random(block)
    counts = [r.choice([0, 0, 1, 2, 5]) for _ in range(120)] + [60, 0]
    flat = [round(r.uniform(-9, 9), 3) for _ in range(sum(counts))]
    c = spark.createDataFrame([(3 * i, n, 1) for i, n in enumerate(counts)], "entry long, n int, start int").repartition(5)
    leaf = lambda v: spark.createDataFrame(list(enumerate(v)), "position long, value double").repartition(4)
    got = sorted(rechunked(c, {"pt": leaf(flat), "eta": leaf([-x for x in flat])}, block=block).collect(), key=lambda x: x["entry"])
    at = 0
    for i, n in enumerate(counts):
        assert (got[i]["entry"], got[i]["start"], got[i]["n"], got[i]["pt"], got[i]["eta"]) == (3 * i, at, n, flat[at : at + n], [-x for x in flat[at : at + n]])
        at += n


def test_counters_that_disagree_raise(spark):
    c = lambda *n: spark.createDataFrame(list(enumerate(n)), "entry long, n int")
    leaf = lambda *p: spark.createDataFrame([(x, 1.0) for x in p], "position long, value double")
    for counts, positions, what in ((c(1, 2), (0, 1), "3"), (c(2, -1), (0,), "negative"), (c(1, 1), (0, 5), "positions"), (c(1, 1), (0, None), "positions"), (c(1, None), (0,), "missing")):
        with pytest.raises(CounterError, match=what):
            rechunked(counts, {"pt": leaf(*positions)})
    with pytest.raises(Exception, match="there twice"):
        rechunked(c(2, 2), {"pt": leaf(0, 1, 1, 3)}).collect()
    with pytest.raises(CounterError, match="two counters"):
        rechunked(spark.createDataFrame([(1, 1), (1, 0)], "entry long, n int"), {"pt": leaf(0)})
    assert rechunked(c().limit(0), {"pt": leaf()}).count() == 0


def test_uneven_leaves_and_what_a_profile_leaves_out(spark):
    df = spark.createDataFrame([([3.0, 2.0, 1.0], [0.5], 1.0, 7, [4], 5)], "Jet_pt array<double>, Jet_eta array<double>, MET_pt double, run int, Jet_area array<int>, nJet int")
    with pytest.raises(Exception, match=r"leaves differ in length: Jet_pt has 3, Jet_eta has 1"):
        ingest(df, "nanoaod").collect()
    assert ingest(df.drop("Jet_eta"), "nanoaod").first()["jet"][2]["pt"] == 1.0
    assert unmapped_classes(df, "nanoaod") == {"unmapped": {"Jet": ["Jet_area"]}, "dropped": {}, "unknown": {"run": ["run"]}}
    d = spark.createDataFrame([([1.0, 2.0], [3, 1], [0, 0], [1], 2, [1])], "`Jet.PT` array<double>, `Jet.BTag` array<int>, `Jet.TauTag` array<int>, `Particle.PT` array<int>, `Jet_size` int, `Beam.X` array<int>")
    assert unmapped_classes(d, "delphes") == {"unmapped": {}, "dropped": {"Particle": ["Particle.PT"]}, "unknown": {"Beam": ["Beam.X"]}}
    assert {(r["column"], r["bit"]): r["values"] for r in ignored_tag_bits(d, "delphes").collect()} == {("Jet.BTag", 0): 1, ("Jet.TauTag", 0): 0}


# -- order and domains in every run ------------------------------------------------------
def test_a_run_refuses_what_the_language_takes_for_granted(spark):
    make = lambda pts, btag=0.0: spark.createDataFrame([(4, [(p, btag) for p in pts])], "event long, jet array<struct<pt:double,btag:double>>")
    src = "object s\n  take sort(Jet, pt, descend)\nregion r\n  select s[0].pt > 8\n"
    with pytest.raises(Exception, match="event 4: jet doesn't fall in pt"):
        api.run(src, make([5.0, 9.0])).counts.collect()
    assert api.run(src, make([9.0, 5.0])).counts.first()["passed"] == 1
    with pytest.raises(Exception, match="neither 0 nor 1"):
        api.run(src, make([9.0], 2.0)).counts.collect()


# -- exact sums -----------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["mixed", "tiny", "equal", "cancel"])
def test_sums_are_equal_bit_by_bit_and_close_to_exact(spark, kind):
    r = random.Random(7)
    w = {
        "mixed": [r.choice([0.1, 1e16, -1e16, 3.0, -0.7, 0.0]) for _ in range(500)],
        "tiny": [r.uniform(-1, 1) * 10.0 ** r.randint(-120, 120) for _ in range(500)],
        "equal": [0.1] * 1000,
        "cancel": [1e140, 1.0, -1e140, 2.0**-60] * 50 + [0.25],
    }[kind]
    df = spark.createDataFrame([(x,) for x in w], "w double")

    def total(n: int) -> tuple:
        x = df.repartition(n, F.rand(n)).withColumn("e", exponent(F.col("w"))).groupBy("e").agg(*summed())
        s, s2 = totals(F.col("p"))
        return tuple(x.agg(gathered().alias("p")).select(s, s2).first())

    got = total(1)
    assert got == total(4) == total(64)
    exact = float(sum(Fraction(x) for x in w))
    small = [x for x in w if abs(x) < 2.0**500]
    if len(small) == len(w):
        assert abs(got[0] - exact) <= 1e-15 * abs(exact) + 1e-300
        assert math.isclose(got[1], float(sum(Fraction(x * x) for x in w)), rel_tol=1e-15)


def test_exponents_and_odd_weights(spark):
    w = [1.0, 1.5, 2.0, math.nextafter(2.0, 0), math.nextafter(2.0, 3), -8.0, 0.0, 2.0**-300, 1e-320, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(w)], "i int, w double").orderBy("i").select(exponent(F.col("w"))).collect()]
    assert got == [0, 0, 1, 0, 1, 3, 0, -300, None, None, None, None]


def test_cutflows_don_t_depend_on_partitions(spark):
    evs = events(300, 5)
    for k, e in enumerate(evs):
        e["weight"] = (0.1, 1e16, -1e16, 0.3)[k % 4]
    df = spark.createDataFrame(rows(evs), SCHEMA)
    src = 'region r\n  select size(Jet) >= 1\n  weight w 0.7\n  select MET > 50\n  bin MET 50 100 300\n  histo h, "t", 5, 0, 500, MET\n'

    def all_(n: int):
        p = api.run(src, df.repartition(n, F.rand(n)))
        key = lambda x: [tuple(r) for r in x.collect()]
        return sorted(key(p.cutflow)), sorted(key(p.bins)), sorted(key(p.histograms.select("cell", "entries", "sumw", "sumw2"))), key(p.counts)

    assert all_(1) == all_(4) == all_(64)


# -- exact products and quotients ----------------------------------------------------------
PRODUCTS = """region a
  select Jet[0].pt * 3 == HT
region b
  select Jet[0].pt / 3 == MET
region c
  select Jet[0].pt * MET >= HT * 0.1
region d
  select (Jet[0].pt + 0.1) * 3 - HT / 7 <= MET
region e
  select HT / MET > Jet[0].pt / -0.3
region f
  select Jet[0].pt / 3 * 3 == Jet[0].pt and Jet[0].pt * 0.1 + Jet[0].pt * 0.2 == Jet[0].pt * 0.3
"""


def test_products_and_quotients_are_exact(spark):
    r = random.Random(3)
    evs = []
    for i in range(400):
        pt, met = round(r.uniform(0.1, 99), r.choice([0, 1, 2, 4])), round(r.uniform(0, 9), r.choice([1, 3]))
        ht = r.choice([float(str(Fraction(str(pt)) * 3 and round(pt * 3, 4))), round(pt * met * 10, 5), round(r.uniform(0, 900), 2)])
        met = r.choice([met, round(pt / 3, 12), 0.0])
        evs.append({"event": i, "jet": [{"pt": pt, "eta": 0.0, "phi": 0.0, "m": None, "btag": 0.0, "q": 0.0}], "electron": [], "muon": [], "met": {"pt": met, "phi": 0.0}, "ht": ht, "triggers": {"urgent": 0.0}, "weight": 1.0})
    a = analyse(PRODUCTS)
    df = spark.createDataFrame(rows(evs), SCHEMA)
    got = {(x["event"], x["region"]): x["pass"] for x in api.run(a, df).membership.collect()}
    want = {(e["event"], low): Evaluator(a, e).region(low) for e in evs for low in a.regions}
    assert got == want and all(any(v for (_, low), v in want.items() if low == x) for x in "acdef")
    loose = {(x["event"], x["region"]): x["pass"] for x in api.run(a, df, exact=False).membership.collect()}
    assert loose != want  # in doubles they aren't
    assert "Python" not in df.sparkSession._jvm.PythonSQLUtils.explainString(api.run(a, df).membership._jdf.queryExecution(), "simple")


# -- events at the edge of cuts ----------------------------------------------------------------
def test_boundaries_by_brute_force(spark):
    src = "region a\n  select MET > 200\n  select Jet[1].pt >= 40\nregion b\n  select Jet[0].eta ][ -1 1.5\n  select HT <= 300\nregion c\n  select size(Jet) > 2\n"
    a, evs = analyse(src), events(80, 11)
    got = {(r["cut"], r["region"]): (r["n"], r["below"], r["at"], r["above"]) for r in boundary_flips(a, spark.createDataFrame(rows(evs), SCHEMA)).collect()}
    cuts = {"met.pt 200": ("met", 200.0), "jet[1].pt 40": (1, "pt", 40.0), "jet[0].eta -1": (0, "eta", -1.0), "jet[0].eta 1.5": (0, "eta", 1.5), "ht 300": ("ht", 300.0)}
    want = {}
    for name, cut in cuts.items():
        for low in a.regions:
            n, sides = 0, [0, 0, 0]
            for k, v in enumerate((math.nextafter(cut[-1], -math.inf), cut[-1], math.nextafter(cut[-1], math.inf))):
                for e in evs:
                    c = json.loads(json.dumps(e))
                    if cut[0] in ("met", "ht"):
                        if c[cut[0]] is None:
                            continue
                        c[cut[0]] = {"pt": v, "phi": c["met"]["phi"]} if cut[0] == "met" else v
                    else:
                        if len(c["jet"]) <= cut[0]:
                            continue
                        c["jet"][cut[0]][cut[1]] = v
                        pts = [j["pt"] for j in c["jet"]]
                        if pts != sorted(pts, reverse=True):
                            continue
                    n += k == 1
                    try:
                        sides[k] += Evaluator(a, c).region(low)
                    except Exception:  # noqa: BLE001  a failure is no pass
                        pass
            want[name, low] = (n, *sides)
    assert got == want
    assert boundary_flips(analyse("region r\n  select size(Jet) > 1\n"), spark.createDataFrame(rows(evs), SCHEMA)).count() == 0


# -- batches -------------------------------------------------------------------------------------
def test_the_log_of_batches_stays_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "TABLES", {"depths": incremental.TABLES["depths"]})
    log = incremental.Log(spark, str(tmp_path / "log"))
    one = lambda k: {"depths": spark.range(1).selectExpr("'r' region", "0 depth", "false failed", "0 e", "1L n", *[f"{k}L {c}" for c in ("a2", "a1", "a0", "b2", "b1", "b0")], "0D odd", "0D odd2")}
    for k in range(100):
        log.write((k, k), one(k))
        log.compact(5)
    assert log.current() == [(0, 24), (25, 49), (50, 74), (75, 99)] or len(log.current()) <= 12
    assert len([f for f in Path(tmp_path / "log").rglob("*.parquet")]) <= 12
    total = log.summed("depths", log.current()).first()
    assert total["n"] == 100 and total["a0"] == sum(range(100)) and log.covers(57)


def test_batches_add_up_however_often_they_come(spark, tmp_path):
    src = 'region r\n  select size(Jet) >= 2\n  bin MET 50 200\n  bin size(Jet) >= 4\n  histo h, "t", 5, 0, 100, Jet[0].pt\n'
    a, df, path = analyse(src), spark.createDataFrame(rows(events(90)), SCHEMA), str(tmp_path / "state")
    for k in (0, 1, 2, 1, 3, 4, 0, 4):
        streaming.store_batch(a, df.where(F.col("event") % 5 == k), k, path, merge=2)
    (Path(path) / "7-7" / "bins").mkdir(parents=True)  # a batch that was cut short counts for nothing
    p, key = api.run(a, df), lambda x: sorted(tuple(r) for r in x.collect())
    assert key(streaming.current_bins(spark, path)) == key(p.bins) and key(streaming.current_cutflow(spark, a, path)) == key(p.cutflow)
    cells = streaming.current_cells(spark, path).select("cell", "entries", "sumw", "sumw2")
    assert key(cells) == key(p.histograms.select("cell", "entries", "sumw", "sumw2"))


def test_numbers_are_dense_over_batches(spark, tmp_path):
    got, r = [], random.Random(9)
    for k in range(4):
        for f in range(2):
            p = tmp_path / "in" / f"b{k}{f}.jsonl"
            p.parent.mkdir(exist_ok=True)
            p.write_text("".join(r.choice(["\n", f"line {k}.{f}.{i}\n"]) for i in range(20)))
        q = streaming.numbered_stream(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check"), lambda df, n: got.extend((x["ordinal"], n, x["line"], x["value"]) for x in df.collect()))
        q.awaitTermination(120)
    lines = [(k, i + 1, x) for k in range(4) for f in range(2) for i, x in enumerate((tmp_path / "in" / f"b{k}{f}.jsonl").read_text().split("\n")[:-1]) if x]
    assert sorted(got) == [(n, *x) for n, x in enumerate(lines)]
    again = streaming.incremental.number_batch(spark.createDataFrame([("a", "f", 0), ("", "f", 0), ("b", "f", 0)], "value string, _file string, _start long").coalesce(1), 3, str(tmp_path / "log"))
    assert [x["ordinal"] for x in again.orderBy("ordinal").collect()] == [len([x for x in lines if x[0] < 3]) + i for i in range(2)]
    with pytest.raises(ValueError, match="has not noted"):
        streaming.incremental.number_batch(spark.createDataFrame([("a", "f", 0)], "value string, _file string, _start long"), 9, str(tmp_path / "log"))


# -- sinks -----------------------------------------------------------------------------------------
def test_results_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame(rows(events(500)), SCHEMA).repartition(9)
    sinks.write_ordered_results(api.run("region r\n  select size(Jet) > 2\n", df).results, str(tmp_path / "out"), 80)
    files = sorted(Path(tmp_path / "out").glob("part-*"))
    got = [json.loads(x)["event"] for f in files for x in f.read_text().splitlines()]
    assert got == list(range(500)) and len(files) > 3


def test_the_identity_of_input_doesn_t_depend_on_splits(spark, tmp_path, splits):
    text = "".join(f'{{"Jet":[],"k":{i}}}\n' + "\n" * (i % 11 == 0) for i in range(9000))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text(text)
    (tmp_path / "a" / "y.jsonl").write_text("{}\n")
    got = []
    for size in (5000, 64_000, 1 << 24):
        splits(size)
        got.append(sinks.input_identity(spark, str(tmp_path / "a")))
    assert got[0] == got[1] == got[2] and (got[0]["files"], got[0]["events"], got[0]["lines"]) == (2, 9001, 9001 + 819)
    (tmp_path / "a" / "x.jsonl").write_text(text.replace('"k":4999}', '"k":5}'))
    assert sinks.input_identity(spark, str(tmp_path / "a"))["sha256"] != got[0]["sha256"]
    assert sinks.provenance("x", input=got[0])["input"]["events"] == 9001


def test_sums_survive_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert [(r["raw"], r["sumw"]) for r in cutflow(plan(analyse(JETS), df)).collect()] == [(0, 0.0)] * 3


def test_the_cutflow_as_one_document(spark):
    df = spark.createDataFrame(rows(events(60)), SCHEMA)
    src = "region r\n  select size(Jet) >= 1\n  weight w 0.5\n  weight v HT\n  select MET > 50\n  bin MET 50 100 300\n  bin size(Jet) >= 4\nregion s\n  select ALL\n"
    p = api.run(src, df)
    d = json.loads(json.dumps(p.cutflow_json()))
    flow = {(r["region"], r["step"]): r for r in p.cutflow.collect()}
    assert d["version"] == 1 and d["total"] == {k: flow["s", 0][k] for k in ("raw", "sumw", "sumw2")} and [r["name"] for r in d["regions"]] == ["r", "s"]
    r = d["regions"][0]
    assert [(x["raw"], x["errors"]) for x in r["steps"]] == [(flow["r", k]["raw"], flow["r", k]["errors"]) for k in range(3)]
    assert "weighted_incomplete" not in r["steps"][1] and r["steps"][2]["weighted_incomplete"]
    edges, cond = r["bins"]
    assert (edges["kind"], edges["edges"], len(edges["bins"]), cond["kind"]) == ("boundary", [50.0, 100.0, 300.0], 3, "cond")
    accepted = flow["r", 2]["raw"]
    assert sum(b["raw"] for b in edges["bins"]) + edges["out"]["raw"] + edges["failed"] == accepted == cond["true"]["raw"] + cond["false"]["raw"] + cond["failed"]
    assert d["regions"][1]["bins"] == []


def test_elements_behind_an_unknown_sort_fail(spark):
    df = spark.createDataFrame(rows(events(20)), SCHEMA)
    src = "region r\n  select size(Jet) >= 0\n  sort nosuchthing(Jet) ascend\n  select size(Jet) >= 0\nregion s\n  sort nosuchthing(Jet) ascend\n  select size(Jet) >= 0 and Jet[0].pt > 0\nregion t\n  select Jet[0].pt >= 0\n  sort nosuchthing(Jet) ascend\n"
    got = {r["region"]: (r["passed"], r["errors"]) for r in api.run(src, df).counts.collect()}
    some = sum(bool(e["jet"]) for e in events(20))
    assert got == {"r": (20, 0), "s": (0, 20), "t": (some, 0)}
    assert any("by their place fail" in d.text for d in api.check(src))


COMBINATIONS = """object trio
  take disjoint(Jet a, Jet b, Jet c)
  select a.pt > 30
  select b.pt + c.pt > 40 and c.btag == 0
object mixed
  take disjoint(Electron e, Muon u, Jet j)
  select dR(e, u) > 0.4 and j.pt > 20
object loose
  take cartesian(Jet a, Jet b)
  select a.pt > 50
  select MET > 100
region r
  select size(trio) >= 1
region s
  select size(mixed) == 2
region t
  select size(loose) >= 1
"""


def test_cuts_of_combinations_may_come_early(spark):
    a, evs = analyse(COMBINATIONS), events(150, 21)
    got = {(r["event"], r["region"].lower()): r for r in api.run(a, spark.createDataFrame(rows(evs), SCHEMA)).membership.collect()}
    for e in evs:
        for low in a.regions:
            n, error = Evaluator(a, e).depth(low)
            r = got[e["event"], low]
            assert (r["error"] is not None) == (error is not None) and r["pass"] == (None if error else n == 1), (low, e)


def test_toy_events_are_sound_and_the_same_at_any_partition(spark):
    one, key = toy_events(spark, 400, 3, 1), lambda df: sorted(df.collect())
    got = key(one)
    assert got == key(toy_events(spark, 400, 3, 7)) and got[:50] == key(toy_events(spark, 50, 3)) and got != key(toy_events(spark, 400, 4))
    check_events(one)
    assert {len(r["jet"]) for r in got} == set(range(7)) and {len(r["muon"]) for r in got} == {0, 1, 2} and 0.3 < sum(j["btag"] for r in got for j in r["jet"]) / sum(len(r["jet"]) for r in got) < 0.5
    assert api.run("region r\n  select size(Jet) >= 2\n  select Jet[0].pt > 200 and MET > 50\n", one).counts.first()["passed"] > 20
