import pytest
from toy import SCHEMA, events, rows


from eventloom import api
from eventloom.language import LanguageError, analyse, parse, resolve
from eventloom.evaluator import Evaluator, Failure

JET = [{"pt": 120.0, "eta": 0.5, "phi": 0.3, "m": 10.0}, {"pt": 40.0, "eta": -0.5, "phi": 1.3}, {"pt": 30.0, "eta": 0.1, "phi": 2.3, "m": 5.0}]
EVENT = {"jet": JET, "met": {"pt": 80.0, "phi": -1.9}}


def accepts(source: str, event: dict = EVENT) -> bool:
    a = analyse(source if "region" in source else f"region r\n  select {source}\n")
    return Evaluator(a, event).region("r")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("size(Jet) == 3", True), ("Jet[0].pt > 100 and Jet[1].pt > 100", False), ("Jet[-1].pt == 30", True), ("Jet[5].pt > 0", False), ("not Jet[5].pt > 0", True),
        ("Jet[1].m > 0", False), ("sum(m(Jet)) > 0", False), ("max(m(Jet)) > 5", True), ("max(m(Jet)) * 1 > 5", False), ("min(pt(Jet)) > 20", True), ("min(pt(Photon)) > 20", False),
        ("all(pt(Photon) > 1)", True), ("any(pt(Photon) > 1)", False), ("sum(pt(Photon)) == 0", True), ("20 < Jet[2].pt < 40", True), ("Jet[0].pt [] 100 130", True), ("Jet[0].pt ][ 100 130", False),
        ("Jet[0].pt / 0 > 1", False), ("0.1 + 0.2 == 0.3", True), ("2 ^ 3 == 8", True), ("2 * 3 ^ 2 == 36", True), ("|0 - 3| == 3", True), ("size(Jet) > 5 ? Jet[0].pt > 1", True), ("MET ~= 80", False),
        ("dR(Jet[0], MET) < 99", False), ("defined(Jet[1].m) == 0", True), ("Jet_1.pt == 40", True), ("size(Jet[0:2]) == 2", True), ("m(Jet[0] + Jet[1]) > 0", False), ("m(Jet[0] + Jet[2]) > 30", True),
    ],
)
def test_values(text, want):
    assert accepts(text) is want


def test_hard_errors_propagate_unless_hidden():
    with pytest.raises(Failure):
        accepts("MET > 1", {"jet": JET})
    assert not accepts("size(Jet) > 9 and MET > 1", {"jet": JET})
    assert accepts("size(Jet) > 2 or MET > 1", {"jet": JET})
    with pytest.raises(Failure):
        accepts("pt(Jet) > 30")
    with pytest.raises(Failure):
        accepts("region r\n  reject MET > 1\n", {"jet": JET})


def test_falling_sort_puts_missing_keys_first():
    src = "object s\n  take sort(Jet, m, descend)\nregion r\n  select s[0].pt == 40 and s[1].m == 10\n"
    assert accepts(src)
    assert accepts(src.replace("descend", "ascend").replace("s[0].pt == 40 and s[1].m == 10", "s[0].m == 5 and s[2].pt == 40"))


def test_combinations():
    one = "object p\n  take disjoint(Jet a, Jet b)\nregion r\n  select size(p) == 3\n"
    assert accepts(one)
    assert accepts(one.replace("disjoint", "cartesian").replace("== 3", "== 9"))
    twin = {"jet": [JET[0], JET[0]]}
    assert not accepts(one.replace("== 3", ">= 1"), twin)


def test_names_and_reuse():
    a = analyse("object g\n  take Jet\n  select pt > 30\nobject same\n  take g\nregion r\n  select size(same) == 2\n")
    assert a.collection("same") == a.collection("g")
    assert Evaluator(a, EVENT).region("r")


def test_inherit_only_earlier_regions():
    d = resolve(parse("region a\n  b\nregion b\n  select ALL\n"))
    assert d.errors
    with pytest.raises(LanguageError):
        analyse("define a = b\ndefine b = a\nregion r\n  select a > 1\n")


def test_every_error_is_reported_with_its_line():
    d = resolve(parse("region a\n  selct size(Jet) > 1\n  select (size(Jet) > \nobject g\n  take\n")).errors
    assert len(d) >= 2 and {x.line for x in d} >= {2}


def test_depth_is_capped():
    assert resolve(parse("region a\n  select " + "(" * 100 + "1" + ")" * 100 + " > 0\n")).errors


def test_histogram_shapes():
    a = analyse('region r\n  select ALL\n  histo a, "t", 10, 0, 1, MET\n  histo b, "t", 0 1 5, MET\n  histo c, "t", 2, 0, 1, 3, 0, 1, MET, MET\n  histo d, "t", 0, 0, 1, MET\n')
    assert [s.histo.kind for s in a.region("r").steps if s.histo] == ["h1", "h1var", "h2", "bad"]


def test_undeclared_functions_of_a_particle_are_hard_errors(spark):
    for src in ("select frob(Jet[0]) > 1", "reject frob(Jet[0]) > 1", "select any(frob(Jet) > 1)"):
        source = f"region a\n  {src}\n"
        assert [d.level for d in api.check(source) if "frob" in d.text] == ["warning"]
        df = spark.createDataFrame(rows(events(5)), SCHEMA)
        r = api.run(source, df).counts.first()
        assert (r["passed"], r["errors"]) == (0, 5) or r["passed"] + r["errors"] == 0
    assert not api.check("region a\n  select btag(Jet[0]) == 1 and dxy(Muon[0]) < 1\n")
