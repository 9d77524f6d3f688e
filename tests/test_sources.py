import json

import pytest
from toy import SCHEMA, events, rows

from eventloom import api, streaming
from eventloom.language import analyse
from eventloom.sources import check_events, ingest, read_jsonl, sinks, validated
from eventloom.sources.profiles import unmapped
from eventloom.sources.validate import LoadError

SRC = "object g\n  take Jet\n  select pt > 30\nregion r\n  select size(g) >= 1\n  select MET > 50\n  trigger fire\n"


def test_json_lines(spark, tmp_path):
    lines = [{"JET": [{"PT": 50, "eta": 1}, {"pt": 20}], "MissingET": {"pt": 60}, "triggers": {"fire": 1}}, {"jet": [], "MET": 70, "weight": 2, "triggers": {"fire": 1}}, {"AK4jets": [{"pt": 40}], "met": 90, "triggers": {"fire": 0}}, {"Jet": [{"pt": 40}]}]
    (tmp_path / "e.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    a = analyse(SRC)
    e = check_events(read_jsonl(spark, str(tmp_path / "e.jsonl"), a))
    got = [(r["pass"], r["error"] is not None) for r in api.run(a, e).membership.orderBy("event").collect()]
    assert got == [(True, False), (False, False), (False, False), (None, True)]
    sinks.write_jsonl(e, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    sinks.write_results(api.run(a, e).results, str(tmp_path / "res"))
    assert json.loads(spark.read.text(str(tmp_path / "res")).first()[0])["regions"][0]["name"] == "r"


@pytest.mark.parametrize("line", ['{"jet":[{"pt":1}', "not json", '{"jet":"oops"}', '{"jet":[{"pt":"x"}]}', '{"jet":[1]}', '{"jet":[null]}', '{"jet":{"pt":1}}', '{"jet":[{"pt":1e999}]}', '{"met":"x"}', '{"met":{"pt":true}}', '{"triggers":[1]}', '{"weight":"w"}', "[1]", '{"jet":[]} more'])
def test_bad_lines_are_refused(spark, tmp_path, line):
    (tmp_path / "e.jsonl").write_text('{"jet":[],"met":1}\n\n' + line + '\n{"jet":[{"pt":2,"m":null}]}\nlast\n')
    a = analyse(SRC)
    with pytest.raises(Exception, match="line [24]: "):
        api.run(a, read_jsonl(spark, str(tmp_path / "e.jsonl"), a)).counts.collect()
    told = read_jsonl(spark, str(tmp_path / "e.jsonl"), a, refuse=False)
    assert [r["event"] for r in told.where("_parse_error is not null").orderBy("event").collect()] == [2, 4]
    with pytest.raises(LoadError, match="event 2: "):
        check_events(told)


def test_unsound_events_are_refused(spark):
    evs = events(5)
    evs[3]["jet"] = [dict(evs[0]["jet"][0] if evs[0]["jet"] else {"pt": 1.0, "eta": 0.0, "phi": 0.0, "m": None, "btag": 0.0, "q": 0.0}, pt=p) for p in (10.0, None, 20.0)]
    df = spark.createDataFrame(rows(evs), SCHEMA)
    assert [r["event"] for r in validated(df).collect() if r["_load_error"]] == [3]
    with pytest.raises(LoadError, match="event 3"):
        check_events(df)


def test_columnar_profiles(spark):
    df = spark.createDataFrame([(1, [50.0, 20.0], [0.1, 0.2], [1.0, 2.0], [5.0, 6.0], 80.0, 1.5, 2.0, 7)], "id long, Jet_pt array<double>, Jet_eta array<double>, Jet_phi array<double>, Jet_mass array<double>, MET_pt double, MET_phi double, genWeight double, other int")
    e = ingest(df, "nanoaod", "id")
    r = e.first()
    assert r["jet"][1]["m"] == 6.0 and r["met"]["pt"] == 80.0 and r["weight"] == 2.0 and unmapped(df, "nanoaod") == ["id", "other"]
    d = spark.createDataFrame([([30.0], [2], [40.0])], "`Jet.PT` array<double>, `Jet.BTag` array<int>, `Electron.PT` array<double>")
    r = ingest(d, "delphes").first()
    assert r["jet"][0]["btag"] == 0.0 and r["electron"][0]["m"] == 0.000511
    f = spark.createDataFrame([([30.0], [3], [1], [5.0])], "`FatJet.PT` array<double>, `FatJet.BTag` array<int>, `FatJet.TauTag` array<int>, `Muon.PT` array<double>")
    r = ingest(f, "delphes").first()
    assert r["fatjet"][0]["btag"] == r["fatjet"][0]["tautag"] == 1.0 and r["muon"][0]["m"] == 0.105658
    n = spark.createDataFrame([([9.0], [True], [3], [8.0], [-1], [0.7])], "Muon_pt array<double>, Muon_tightId array<boolean>, Muon_pfIsoId array<int>, Tau_pt array<double>, Tau_charge array<int>, Jet_btagDeepFlavB array<double>")
    r = ingest(n, "nanoaod").first()
    assert r["muon"][0]["tightid"] == 1.0 and r["muon"][0]["pfisoid"] == 3.0 and r["tau"][0]["q"] == -1.0 and r["jet"][0]["btagdeepflavb"] == 0.7


def test_streamed_partial_results_add_up(spark, tmp_path):
    a = analyse('region r\n  select size(Jet) >= 2\n  histo h, "t", 5, 0, 100, Jet[0].pt\n')
    df = spark.createDataFrame(rows(events(60)), SCHEMA)
    df.where("event < 30").write.parquet(str(tmp_path / "in"))
    for k in range(2):
        if k:
            df.where("event >= 30").write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.accumulate(a, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check"))
        q.awaitTermination(120)
    key = lambda rs: sorted((r["step"], r["raw"], r["sumw"]) for r in rs)
    assert key(streaming.current_cutflow(spark, a, str(tmp_path / "state")).collect()) == key(api.run(a, df).cutflow.collect())
    got = {r["cell"]: r["entries"] for r in streaming.current_cells(spark, str(tmp_path / "state")).collect()}
    assert got == {r["cell"]: r["entries"] for r in api.run(a, df).histograms.collect()}


def test_files_of_results(spark):
    p = api.run('region r\n  select ALL\n  histo h, "t", 5, 0, 100, Jet[0].pt\n  histo k, "t", 2, 0, 100, 2, 0, 100, Jet[0].pt, Jet[1].pt\n', spark.createDataFrame(rows(events(20)), SCHEMA))
    h, k = p.histogram_json()["histograms"]
    assert sinks.histogram_csv(h).count("\n") == 6 and sinks.histogram_csv(k).count("\n") == 17
    assert sinks.histogram_svg(h).startswith("<svg") and "rect" in sinks.histogram_svg(k)
    assert sinks.provenance("x")["source_sha256"]
