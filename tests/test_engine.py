import json
import math

import pytest
from toy import SCHEMA, events, rows

from eventloom import api, catalog
from eventloom.evaluator import Decisive, Evaluator, Failure
from eventloom.language import analyse
from eventloom.operators.histograms import documents
from eventloom.plans.planner import plan

EVENTS = events(120)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(EVENTS), SCHEMA).coalesce(1).cache()


@pytest.mark.parametrize("name", sorted(catalog.REGIONS))
def test_columns_agree_with_the_evaluator(df, name):
    a = analyse(catalog.REGIONS[name][0])
    got = {(r["event"], r["region"].lower()): r for r in api.run(a, df).membership.collect()}
    for e in EVENTS:
        ev = Evaluator(a, e)
        for low in a.regions:
            n, error = ev.depth(low)
            r = got[e["event"], low]
            assert (r["error"] is not None) == (error is not None), (name, low, e, r, error)
            assert r["pass"] == (None if error else n == len([s for s in a.regions[low].steps if s.kind in ("select", "reject", "inherit", "trigger")])), (name, low, e)


@pytest.mark.parametrize("name", ["decisive", "short_circuit", "ternary", "any_all", "sum_reducer", "scalar_min_max", "region_as_predicate", "out_of_fragment"])
def test_three_valued_membership_agrees_with_the_evaluator(df, name):
    a = analyse(catalog.DECISIVE if name == "decisive" else catalog.REGIONS[name][0])
    got = {(r["event"], r["region"].lower()): r["pass"] for r in api.run(a, df, decisive=True).membership.collect()}
    loose = 0
    for e in EVENTS:
        for low in a.regions:
            try:
                want = Decisive(a, e).region(low)
            except Failure:
                want = None
            assert got[e["event"], low] is want, (name, low, e)
            n, error = Evaluator(a, e).depth(low)
            loose += error is not None and want is not None
            if error is None:  # what evaluation in order decides, this decides alike
                assert want is (n == len([s for s in a.regions[low].steps if s.kind in ("select", "reject", "inherit", "trigger")]))
    assert loose or name != "decisive"


def test_a_part_without_a_value_hides_an_error_beside_it():
    a = analyse("region r\n  select Jet[0].pt * MET > 1\nregion s\n  select HT > 1\n  select size(Jet) > 0\nregion t\n  select MET > 1 ? NONE : size(Jet) > 0\n")
    e = Decisive(a, {"jet": []})
    assert not e.region("r") and not e.region("s") and not e.region("t")
    with pytest.raises(Failure):
        Decisive(a, {"jet": [{"pt": 5.0}]}).region("r")


def test_cutflow_bins_and_histograms(df):
    p = plan(analyse(catalog.EX), df)
    r = api.Result(p)
    a, want = p.analysis, {}
    for e in EVENTS:
        ev = Evaluator(a, e)
        for low in a.regions:
            n, error = ev.depth(low)
            for k in range(n + 1):
                want[low, k] = want.get((low, k), 0) + 1
            if error:
                want[low, "e", n + 1] = want.get((low, "e", n + 1), 0) + 1
    flow = r.cutflow.collect()
    for x in flow:
        assert x["raw"] == want.get((x["region"], x["step"]), 0)
        assert x["errors"] == want.get((x["region"], "e", x["step"]), 0)
    assert "region base" in r.cutflow_text()
    passed = max(x["raw"] for x in flow if x["region"] == "tight" and x["step"] == 3)
    assert sum(b["raw"] for b in r.bins.collect() if b["statement"] == 0) == passed
    docs = documents(p)
    assert [d["type"] for d in docs] == ["h1", "h1var", "h2"] and all(d["entries"] == passed for d in docs)
    assert math.isclose(sum(docs[0]["sumw"]) + docs[0]["underflow"] + docs[0]["overflow"], sum(docs[2]["sumw"]))
    json.dumps(docs)


def test_no_event_is_shuffled(df):
    p = plan(analyse(catalog.EX), df)
    text = p.events._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_check_objects_dot():
    assert api.check("region r\n  selct 1\n")
    assert api.objects(catalog.EX)[1]["chain"] == ["filter", "filter"]
    assert "tight" in api.dot(catalog.EX)


def test_verdicts():
    base = "object g\n  take Jet\n  select pt > 30\n"
    r = api.verify(base + "region a\n  select size(g) >= 3\nregion b\n  select size(g) < 2\nregion c\n  select size(g) >= 2\nregion d\n  select size(g) >= 2\n  select size(g) == 0\n")
    assert r.pair("a", "b").relation == "DISJOINT" and r.pair("a", "c").subset and r.pair("a", "c").relation == "OVERLAPPING" and r.empty["d"] and not r.empty["a"]
    # An absent mass fails both cuts, and both negations hold.
    r = api.verify("region a\n  reject Jet[0].m > 5\nregion b\n  reject Jet[0].m <= 5\n")
    assert r.pair("a", "b").relation != "DISJOINT"
    r = api.verify("region a\n  select Jet[0].pt < 50\nregion b\n  select Jet[1].pt > 60\n")
    assert r.pair("a", "b").relation == "DISJOINT"
    r = api.verify("region a\n  select MET / HT > 0.5\n  select HT > 100\nregion b\n  select MET < 40\n")
    assert r.pair("a", "b").relation == "DISJOINT" and r.pair("a", "b").certificates > 0
    r = api.verify(base + "region a\n  select g[0].pt < 20\nregion b\n  select g[0].pt < 50\n  select Jet[-1].pt > 60\n  select Jet[0].pt < 55\nregion c\n  select dR(Electron, Muon) < 0.4\nregion d\n  select dR(Electron, Muon) > 0.4\n")
    assert r.empty["a"] and r.empty["b"] and r.pair("c", "d").relation == "DISJOINT"
    r = api.verify({"x": "region a\n  select MET > 100\n", "y": "region a\n  select MET < 50\n"})
    assert r.pair("x::a", "y::a").relation == "DISJOINT" and r.fails({"DISJOINT"})


def test_proven_verdicts_hold_on_events(df):
    from eventloom.prover.verdicts import crosstab

    src = catalog.GOOD + "region a\n  select size(good) < 2\nregion b\n  select size(good) >= 2\nregion c\n  select good[2].pt > 40\n"
    r, seen = api.verify(src), {(x["left"], x["right"]): x for x in crosstab(plan(analyse(src), df)).collect()}
    for v in r.pairs:
        x = seen[v.left, v.right]
        assert not (v.relation == "DISJOINT" and x["both"]) and not (v.subset and x["left_only"]) and not (v.superset and x["right_only"])
    assert r.pair("a", "b").relation == "DISJOINT" and r.pair("c", "b").subset
