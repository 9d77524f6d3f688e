"""Orders and their line items as events: an order is an event, its items are jets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _in_place(df: DataFrame) -> DataFrame:
    """A Parquet table's rows with ``_file``, their file's place among its paths, and ``_row``, theirs in it."""
    files = sorted(df.inputFiles())
    df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    if len(files) < 2:
        return df.withColumn("_file", F.lit(0)).drop("_path")
    plain = F.regexp_replace("_path", ":/+", ":/")  # file:/ and file:/// are one
    places = df.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], "_path string, _file int").withColumn("_path", plain)
    return df.withColumn("_path", plain).join(F.broadcast(places), "_path", "left").drop("_path")


def events_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an order. Items combine on the order key; prices in thousands stand for energy.
    Only the columns that events need are read, and an order's few items are the
    largest group that forms, so the one shuffle is even. Items of one price stand as in the table: by their
    file, in the order of paths, and their row in it."""
    li = _in_place(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    jet = F.struct(
        (-F.col("l_extendedprice")).alias("_k"),
        "_file",
        "_row",
        (F.col("l_extendedprice") / 1000).alias("pt"),
        ((F.round(F.col("l_discount") * 100) - 5) / 2.0).alias("eta"),
        ((F.col("l_partkey") % 63 - 31) / 10.0).alias("phi"),
        F.when(F.col("l_linestatus") != "O", F.col("l_tax") * 100).alias("m"),
        (F.col("l_returnflag") == "R").cast("int").cast("double").alias("btag"),
        ((F.col("l_suppkey") % 3) - 1).cast("double").alias("q"),
    )
    jets = li.groupBy(F.col("l_orderkey").alias("event")).agg(F.sort_array(F.collect_list(jet)).alias("j"))
    props = ("pt", "eta", "phi", "m", "btag", "q")
    jets = jets.select("event", F.transform("j", lambda x: F.struct(*[x[p].alias(p) for p in props])).alias("jet"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    met = F.struct((F.col("o_totalprice") / 1000).alias("pt"), ((F.col("o_custkey") % 63 - 31) / 10.0).alias("phi"))
    weight = F.when(F.col("o_orderpriority").startswith("1"), 2.0).when(F.col("o_orderpriority").startswith("2"), 0.5).otherwise(1.0)
    o = o.select(
        F.col("o_orderkey").alias("event"),
        F.when(F.col("o_orderstatus") != "P", met).alias("met"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 500).alias("ht"),
        F.struct((F.col("o_orderpriority") == "1-URGENT").cast("int").cast("double").alias("urgent")).alias("triggers"),
        weight.alias("weight"),
    )
    e = o.join(jets, "event", "left")
    # Leptons are the positively and negatively charged items of small phi, as collections of their own.
    soft = lambda s: F.filter(F.coalesce("jet", F.array().cast(jets.schema["jet"].dataType)), lambda x: (x["q"] == s) & (F.abs(x["eta"]) < 2))
    return e.withColumns({"electron": soft(1.0), "muon": soft(-1.0)})


#: The same events for DuckDB; alias ``ev``.
EVENTS_SQL = """
with jets as (select l_orderkey as event, list(struct_pack(pt := l_extendedprice / 1000, eta := (round(l_discount * 100) - 5) / 2.0,
        phi := (l_partkey % 63 - 31) / 10.0, m := case when l_linestatus <> 'O' then l_tax * 100 end,
        btag := case when l_returnflag = 'R' then 1.0::double else 0.0::double end, q := ((l_suppkey % 3) - 1)::double) order by l_extendedprice desc) as jet
    from lineitem group by 1),
e0 as (select o_orderkey as event, coalesce(jet, []) as jet,
        case when o_orderstatus <> 'P' then o_totalprice / 1000 end as met, case when o_orderstatus <> 'P' then (o_custkey % 63 - 31) / 10.0 end as metphi,
        case when o_orderstatus <> 'F' then o_totalprice / 500 end as ht, case when o_orderpriority = '1-URGENT' then 1 else 0 end as urgent,
        case when o_orderpriority like '1%' then 2.0::double when o_orderpriority like '2%' then 0.5::double else 1.0::double end as w
    from orders left join jets on o_orderkey = jets.event),
ev as (select *, list_filter(jet, lambda x: x.q = 1 and abs(x.eta) < 2) as ele, list_filter(jet, lambda x: x.q = -1 and abs(x.eta) < 2) as muo from e0)
"""
