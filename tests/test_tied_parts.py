"""Items of one price over a dozen part files: events hold them by file and row, as the SQL does by one thread."""

import duckdb
import pytest

import __spark_entry__ as entry

LEADING = ("delta_eta_r", "delta_phi", "number_as_predicate")


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Orders whose items are spread over all parts; part-10 is read before part-2."""
    d = tmp_path_factory.mktemp("parts")
    con = duckdb.connect()
    con.sql("set threads = 1")
    (d / "lineitem.parquet").mkdir()
    item = "select (hash(i, 9) % 400)::bigint as l_orderkey, (hash(i, 1) % 999)::bigint as l_partkey, (hash(i, 2) % 99)::bigint as l_suppkey, (40000 + hash(i, 3) % 3 * 20000)::double as l_extendedprice, (hash(i, 4) % 11) / 100.0 as l_discount, (hash(i, 5) % 9) / 100.0 as l_tax, case when hash(i, 6) % 2 = 0 then 'R' else 'N' end as l_returnflag, 'F' as l_linestatus from range({0}, {1}) t(i)"
    for k in range(12):
        con.sql(f"copy ({item.format(k * 140, k * 140 + 140)}) to '{d}/lineitem.parquet/part-{k}.parquet'")
    con.sql(f"copy (select i as o_orderkey, (i % 50)::bigint as o_custkey, 'O' as o_orderstatus, 90000.0::double as o_totalprice, '1-URGENT' as o_orderpriority from range(400) t(i)) to '{d}/orders.parquet'")
    for name, at in (("orders", f"{d}/orders.parquet"), ("lineitem", f"{d}/lineitem.parquet/*.parquet")):
        con.sql(f"create table {name} as select * from read_parquet('{at}')")
    return str(d), con


@pytest.mark.parametrize("name", LEADING)
def test_ties_over_parts(spark, parts, name):
    d, con = parts
    got = sorted(tuple(r) for r in entry.queries()[name](spark, d).collect())
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
