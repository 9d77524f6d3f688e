"""Lines that are read by a schema, and those that are taken apart key by key, say the same."""

from pyspark.sql import functions as F

from eventloom.api import analyse
from eventloom.sources import jsonl

SOURCE = "region r\n  select MET.pt > 0 and MET.phi > -9 and HT > 0 and sum(m(Jet)) > 0 and Jet[0].btag == 1 and Jet[0].q > -2\n  trigger urgent\n"
REGULAR = [
    '{"Jet":[{"pt":3.5,"eta":-1.0,"btag":1.0,"mass":2},{"pt":3,"charge":-1,"m":null}],"MET":5,"weight":-1.5,"HT":3e2}',
    '{ "AK4jets" : [ ], "missinget": {"PT": 3, "phi":-0.5}, "Triggers":{"Urgent":1,"other":0.0}, "Lumi":3 }',
    '{"Ele":[{"pt":2,"e":1e2},{"eta":1},{"pt":2}],"metlv":{"phi":1}}',
    "{}",
    '{"jet":[{},{"pt":1}],"triggers":{}}',
    '{"jet":[],"jets":3}',
]
OTHERS = [
    '{"Jet":[{"pt":1},{"eta":1},{"pt":3}]}', '{"Ele":[{"pt":1},{"pt":3}]}', '{"Jet":[{"pt":3,"m":1,"mass":2}]}', '{"Jet":[{"pt":3,"d0":1,"D0":2}]}', '{"Jet":[],"ak4jet":[]}',
    '{"MET":5,"MissingET":9}', '{"Jet":[]} {"Jet":[]}', '{"Jet":[{"pt":3,"btag":2}]}', '{"HT":-1}', '{"Jet":[{"pt":-3}]}', '{"Jet":[{"pt":1e999}]}', '{"weight":"1"}', '{"Lumi":1,"LUMI":2}',
    '{"triggers":{"a":1,"A":1}}', '{"triggers":{"a":2}}', '{"triggers":3}', '{"jet":5}', '{"met":[]}', '{"Jet":[{"pt":1},]}', '{"Jet":[{"pt":1,}]}', '{"Jet":[],}', '{"Jet":[{"pt":01}]}', '{"Jet":[{"pt":NULL}]}',
    '{"Jet":[{"pt":{"x":1}}]}', '{"Jet":null,"HT":null}', '[]', '{"HT":1', '{"Stuff":[{"pt":1}]}', '{"H\\u0054":1}', '{"HT":-0}', '{"MET":1.}',
]


def test_regular_lines_are_read_as_others(spark, monkeypatch):
    a = analyse(SOURCE)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(REGULAR + OTHERS)], "k long, value string")
    taken = [r[0] for r in df.orderBy("k").select(F.col("value").rlike(jsonl.REGULAR)).collect()]
    assert all(taken[: len(REGULAR)]) and taken[len(REGULAR) :] == [True, True] + [False] * (len(OTHERS) - 2)
    read = lambda: jsonl.parse_events(df, a, key="k", refuse=False).orderBy("event").collect()
    told = [r["_parse_error"] for r in jsonl.parse_events(df, a, key="k", refuse=False, columns=False).orderBy("event").collect()]
    got = read()
    monkeypatch.setattr(jsonl, "REGULAR", "^none$")
    assert got == read() and told == [r["_parse_error"] for r in got]


def test_many_objects_on_a_line(spark):
    """A long line neither overflows the pattern's stack nor changes."""
    line = '{"Jet":[' + ",".join(f'{{"pt":{20000 - i},"eta":0.5}}' for i in range(20000)) + "]}"
    x = jsonl.parse_events(spark.createDataFrame([(line,)], "value string"), analyse("region r\n  select size(Jet) > 0\n"), refuse=False)
    assert x.select(F.size("jet"), "_parse_error").collect() == [(20000, None)]
