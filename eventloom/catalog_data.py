"""Queries of sources, sinks and sums over the driver's tables, with their SQL: numbering, counters, keys, order, exactness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .api import analyse
from .catalog import BINS_SQL, EX
from .operators.cutflow import cutflow
from .operators.membership import results
from .operators.prefix import prefix_sums
from .plans.planner import plan
from .prover.boundaries import boundary_flips
from .sources.flat import rechunked
from .sources.jsonl import parse_events, read_numbered
from .sources.lines import numbered_lines
from .sources.profiles import ignored_tag_bits
from .sources.scratch import scratch
from .sources.sinks import write_jsonl, write_ordered_results
from .sources.tables import EVENTS_SQL, events_from_tables
from .streaming.incremental import current_bins, store_batch


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rechunk_query(spark: SparkSession, d: str) -> DataFrame:
    """Line items as flat leaves: one long column of prices and one of quantities, all orders end to end, and a counter an
    order (none for an order without items). Cut into lists again by the counters alone."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    n = li.groupBy(F.col("l_orderkey").alias("entry")).agg(F.count("*").alias("n"))
    counts = _kept(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("entry")).join(n, "entry", "left").fillna(0, ["n"]), "counts")
    starts = prefix_sums(counts, "entry", F.col("n"), "start").select("entry", "start")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity"))
    flat = li.withColumn("_k", place).join(starts, F.col("l_orderkey") == F.col("entry")).withColumn("position", F.col("start") + F.col("_k") - 1)
    flat = _kept(flat.select("position", "l_extendedprice", "l_quantity"), "flat")  # leaves are checked, then cut: made once, not for each pass
    x = rechunked(counts, {"price": flat.select("position", F.col("l_extendedprice").alias("value")), "quantity": flat.select("position", F.col("l_quantity").alias("value"))})
    placed = lambda c: F.round(F.aggregate(F.transform(c, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v), 2)
    return x.select("entry", "start", "n", F.get("price", 0).cast("double").alias("first_price"), placed("price").alias("price"), placed("quantity").alias("quantity"))


_RECHUNK_SQL = """
with c as (select o_orderkey as entry, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1),
s as (select entry, n, coalesce(sum(n) over (order by entry rows between unbounded preceding and 1 preceding), 0)::bigint as start from c),
k as (select l_orderkey as entry, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_quantity) as k, l_extendedprice as p, l_quantity as q from lineitem)
select s.entry, start, n, min(p) filter (where k = 1)::double as first_price, round(coalesce(sum(p::double * k), 0), 2) as price, round(coalesce(sum(q::double * k), 0), 2) as quantity
from s left join k using (entry) group by all
"""

#: A line by the remainder of its event's number by 10, and what is wrong with it.
CLASHES = [
    ('{"MET":5,"MissingET":9}', "twice"),
    ('{"Jet":[{"pt":3,"m":1,"mass":2}]}', "property"),
    ('{"Jet":[],"jet":[]}', "twice"),
    ('{"AK4jets":[{"pt":1}],"jet":[]}', "twice"),
    ('{"Jet":[]} {"Jet":[]}', "shape"),
    ('{"Jet":[{"pt":3,"btag":2}]}', "tag"),
    ('{"Jet":[{"pt":3},{"pt":5}]}', "order"),
    ('{"Jet":[],"HT":-1}', "negative"),
    ('{"Jet":[{"pt":7,"e":1e2}],"Muo":[{"pt":1,"charge":-1}],"Lumi":3}', "none"),
]


def clashes_query(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, most of them with two names of one key, another object behind, or a value outside its domain,
    none of which the analysis reads but the jets' pt: how many are refused, by what is wrong."""
    k = F.col("event") % 10
    line = F.to_json(F.struct(F.col("jet").alias("Jet"), F.col("weight").alias("weight")))
    for i, (text, _) in enumerate(CLASHES):
        line = F.when(k == i, F.lit(text)).otherwise(line)
    e = parse_events(events_from_tables(spark, d).select("event", line.alias("value")), analyse("region r\n  select size(Jet) >= 0\n"), key="event", refuse=False)
    says = {"is there twice": "twice", "two properties": "property", "alone on its line": "shape", "has a tag": "tag", "doesn't fall": "order", "is negative": "negative"}
    wrong = F.lit("none")
    for text, name in says.items():
        wrong = F.when(F.col("_parse_error").contains(text), name).otherwise(wrong)
    return e.groupBy(wrong.alias("wrong")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_parse_error").isNull(), F.size("jet").cast("long")).otherwise(0)).alias("n_jets"))


_CLASH_SQL = EVENTS_SQL + "select case event % 10 " + " ".join(f"when {i} then '{name}'" for i, (_, name) in enumerate(CLASHES)) + " else 'none' end as wrong, count(*) as n, sum(case event % 10 when 8 then 1 when 9 then len(jet) else 0 end)::bigint as n_jets from ev group by 1"


LOADED = "region r\n  select MET.pt > 100 and MET.phi > -9 and HT > 0\n  trigger Urgent\n  select size(Jet) >= 0 and Jet[0].btag == 1 and Jet[0].q > -2\n"


def met_and_triggers_query(spark: SparkSession, d: str) -> DataFrame:
    """Missing momentum as a number, as an object, under another name and absent; triggers and an alias of a collection."""
    k, met, fired = F.col("event") % 4, F.col("met.pt").cast("string"), F.col("triggers.urgent").cast("string")
    head = F.when(k == 0, F.concat(F.lit('"MET":'), met)).when(k == 1, F.concat(F.lit('"MissingET":{"PT":'), met, F.lit(',"phi":'), F.col("met.phi").cast("string"), F.lit("}"))).when(k == 2, F.concat(F.lit('"metlv":{"phi":'), F.col("met.phi").cast("string"), F.lit("}")))
    jets = F.to_json(F.transform("jet", lambda j: F.struct(j["pt"].alias("PT"), j["btag"].alias("bTag"), j["q"].alias("charge"))))
    line = F.concat(F.lit("{"), F.coalesce(F.concat(head, F.lit(",")), F.lit("")), F.lit('"Triggers":{"URGENT":'), fired, F.lit('},"AK4jets":'), F.coalesce(jets, F.lit("[]")), F.lit("}"))
    e = parse_events(events_from_tables(spark, d).select("event", line.alias("value")), analyse(LOADED), key="event")
    total = lambda c: F.round(F.sum(F.aggregate(F.transform("jet", lambda j: j[c]), F.lit(0.0), lambda a, v: a + v)), 3)
    return e.groupBy((F.col("event") % 4).cast("int").alias("form")).agg(F.count("*").alias("n"), F.count("met.pt").alias("n_pt"), F.count("met.phi").alias("n_phi"), F.round(F.sum("met.pt"), 3).alias("pt"), F.sum("triggers.urgent").alias("fired"), total("btag").alias("tagged"), total("q").alias("charge"))


_MET_SQL = EVENTS_SQL + """select (event % 4)::int as form, count(*) as n, count(case when event % 4 < 2 then met end) as n_pt, count(case when event % 4 in (1, 2) then metphi end) as n_phi, round(sum(case when event % 4 < 2 then met end), 3) as pt, sum(urgent)::double as fired,
       round(sum(coalesce(list_sum(list_transform(jet, lambda x: x.btag)), 0)), 3) as tagged, round(sum(coalesce(list_sum(list_transform(jet, lambda x: x.q)), 0)), 3) as charge from ev group by 1"""


def roundtrip_query(spark: SparkSession, d: str) -> DataFrame:
    """Canonical events written as JSON lines by all tasks and read again."""
    e, path = events_from_tables(spark, d), scratch(spark, "canonical")
    write_jsonl(e.select("event", "jet", "met", "ht", "triggers", "weight"), path)
    x = read_numbered(spark, path, analyse("region r\n  select MET > 0 and HT > 0 and sum(m(Jet)) > 0 and Jet[0].eta > 0\n  trigger urgent\n"))
    total = lambda c: F.round(F.sum(F.aggregate(F.transform("jet", lambda j: F.coalesce(j[c], F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)), 3)
    return x.agg(F.count("*").alias("n"), F.max("event").alias("last"), F.sum(F.size("jet").cast("long")).alias("n_jets"), F.count("met").alias("n_met"), F.count("ht").alias("n_ht"), F.round(F.sum("ht"), 3).alias("ht"), F.sum("weight").alias("weight"), F.sum("triggers.urgent").alias("fired"), total("pt").alias("pt"), total("eta").alias("eta"), total("m").alias("m"))


_ROUNDTRIP_SQL = EVENTS_SQL + "select count(*) as n, count(*) - 1 as last, sum(len(jet))::bigint as n_jets, count(met) as n_met, count(ht) as n_ht, round(sum(ht), 3) as ht, sum(w) as weight, sum(urgent)::double as fired, " + ", ".join(f"round(sum(coalesce(list_sum(list_transform(jet, lambda x: coalesce(x.{c}, 0))), 0)), 3) as {c}" for c in ("pt", "eta", "m")) + " from ev"


def tag_bits_query(spark: SparkSession, d: str) -> DataFrame:
    """Tags kept as a bit beside others: how many values of each leaf have bits that aren't read."""
    e = events_from_tables(spark, d)
    bits = lambda n: F.transform("jet", lambda j, i: (j["btag"] + F.lit(n) * (i % 2)).cast("int"))
    return ignored_tag_bits(e.select(bits(2).alias("Jet.BTag"), bits(4).alias("FatJet.BTag"), bits(0).alias("Jet.TauTag")), "delphes")


_BITS_SQL = EVENTS_SQL + "\nunion all\n".join(f"select '{c}' as \"column\", 0 as bit, {v}::bigint as \"values\" from ev" for c, v in (("Jet.BTag", "sum(len(jet) // 2)"), ("FatJet.BTag", "sum(len(jet) // 2)"), ("Jet.TauTag", "0 * count(*)")))


def _lines(spark: SparkSession, d: str, files: int) -> str:
    """Orders as JSON lines in several files, in order, with blank lines among them."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    text = F.concat(F.when(F.col("k") % 5 == 0, F.lit(" \n\n")).otherwise(F.lit("")), F.lit('{"Jet":[],"HT":'), F.col("k").cast("string"), F.lit("}"))
    path = scratch(spark, "lines")
    o.repartitionByRange(files, "k").sortWithinPartitions("k").select(text.alias("value")).write.text(path)
    return path


def numbering_query(spark: SparkSession, d: str) -> DataFrame:
    """Dense numbers of events over several files with blank lines: the order of each and its number."""
    x = read_numbered(spark, _lines(spark, d, 7), analyse("region r\n  select HT > 0\n"))
    return x.select("event", F.col("ht").cast("long").alias("orderkey"))


_NUMBERING_SQL = "select (row_number() over (order by o_orderkey) - 1)::bigint as event, o_orderkey::bigint as orderkey from orders"


def ordered_query(spark: SparkSession, d: str) -> DataFrame:
    """Results of shuffled events written in order: the files' lines, read one file after another, and the event in each."""
    p = plan(analyse("region r\n  select size(Jet) >= 3\n"), events_from_tables(spark, d).repartition(11))
    path = scratch(spark, "ordered")
    write_ordered_results(results(p), path, 4000)
    got = F.from_json("value", "event long, regions array<struct<name:string,pass:boolean>>")
    return numbered_lines(spark, path).select("ordinal", got.alias("g")).select("ordinal", "g.event", F.get("g.regions", 0)["pass"].alias("pass"))


_ORDERED_SQL = EVENTS_SQL + "select (row_number() over (order by event) - 1)::bigint as ordinal, event, len(jet) >= 3 as pass from ev"

WEIGHED = "region r\n  select size(Jet) >= 2\n  select MET > 100\n"


def exact_merge_query(spark: SparkSession, d: str) -> DataFrame:
    """A cutflow with weights of 0.1, 1e16 and -1e16 over three numbers of partitions, none of which a larger table outgrows: whether
    its sums are equal bit by bit."""
    w = F.when(F.col("event") % 3 == 0, 1e16).when(F.col("event") % 3 == 1, -1e16).otherwise(0.1)
    e = events_from_tables(spark, d).withColumn("weight", w)
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flow = lambda k: cutflow(plan(analyse(WEIGHED), e.repartition(k * p + k // 2, F.rand(k)))).select("region", "step", "raw", F.struct("sumw", "sumw2").alias(f"s{k}"))
    x = flow(1).join(flow(2).drop("raw"), ["region", "step"]).join(flow(3).drop("raw"), ["region", "step"])
    near = F.abs(F.col("s1.sumw2") / F.col("raw") - F.lit(2e32) / 3) < 1e31
    return x.select("region", "step", "raw", ((F.col("s1") == F.col("s2")) & (F.col("s2") == F.col("s3"))).alias("alike"), near.alias("near"))


_MERGE_SQL = EVENTS_SQL + "\nunion all\n".join(f"select 'r' as region, {k} as step, count(*) filter (where {c}) as raw, true as alike, true as near from ev" for k, c in enumerate(("true", "len(jet) >= 2", "len(jet) >= 2 and met > 100")))

EDGES = "region a\n  select MET > 200\n  select size(Jet) >= 2\nregion b\n  select Jet[1].pt >= 30\n  select HT <= 300\nregion c\n  select Jet[0].eta [] -1 1\n"


def boundary_query(spark: SparkSession, d: str) -> DataFrame:
    """Events at and beside each cut's constant: how many copies each region accepts."""
    return boundary_flips(analyse(EDGES), events_from_tables(spark, d))


def _boundary_sql() -> str:
    """Each region's verdict with one value set, over the events that have it and stay in order."""
    met, jet1, ht, eta0 = "met is not null", "len(jet) >= 2 and jet[1].pt >= {0} and (len(jet) < 3 or jet[3].pt <= {0})", "ht is not null", "len(jet) >= 1"
    a, b, c = "coalesce(met > 200, false) and len(jet) >= 2", "coalesce(jet[2].pt >= 30, false) and coalesce(ht <= 300, false)", "coalesce(jet[1].eta between -1 and 1, false)"
    sets = {
        "met.pt 200": (met, {"a": ("false", "false", "len(jet) >= 2")}),
        "jet[1].pt 30": (jet1.format("30.0"), {"b": ("false", "coalesce(ht <= 300, false)", "coalesce(ht <= 300, false)")}),
        "ht 300": (ht, {"b": ("coalesce(jet[2].pt >= 30, false)", "coalesce(jet[2].pt >= 30, false)", "false")}),
        "jet[0].eta -1": (eta0, {"c": ("false", "true", "true")}),
        "jet[0].eta 1": (eta0, {"c": ("true", "true", "false")}),
    }
    out = []
    for cut, (there, own) in sets.items():
        for region, plain in (("a", a), ("b", b), ("c", c)):
            sides = own.get(region, (plain,) * 3)
            out.append(f"select '{cut}' as cut, '{region}' as region, count(*) filter (where {there}) as n, " + ", ".join(f"count(*) filter (where {there} and {x}) as \"{s}\"" for s, x in zip(("below", "at", "above"), sides, strict=True)) + " from ev")
    return EVENTS_SQL + "\nunion all\n".join(out)


def batches_query(spark: SparkSession, d: str) -> DataFrame:
    """The bin flow of the example analysis over twelve batches, kept in a log that is compacted; one batch comes twice."""
    a, path, e = analyse(EX), scratch(spark, "batches"), events_from_tables(spark, d)
    for k in (*range(12), 5):
        store_batch(a, e.where(F.col("event") % 12 == k), k, path, merge=3)
    return current_bins(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "counter_rechunk": rechunk_query,
    "jsonl_clashes": clashes_query,
    "jsonl_met_triggers": met_and_triggers_query,
    "jsonl_roundtrip": roundtrip_query,
    "ignored_tag_bits": tag_bits_query,
    "dense_numbering": numbering_query,
    "ordered_results": ordered_query,
    "exact_merge": exact_merge_query,
    "boundary_battery": boundary_query,
    "batched_bin_flow": batches_query,
}
ORACLES: dict[str, str] = {
    "counter_rechunk": _RECHUNK_SQL,
    "jsonl_clashes": _CLASH_SQL,
    "jsonl_met_triggers": _MET_SQL,
    "jsonl_roundtrip": _ROUNDTRIP_SQL,
    "ignored_tag_bits": _BITS_SQL,
    "dense_numbering": _NUMBERING_SQL,
    "ordered_results": _ORDERED_SQL,
    "exact_merge": _MERGE_SQL,
    "boundary_battery": _boundary_sql(),
    "batched_bin_flow": BINS_SQL,
}
