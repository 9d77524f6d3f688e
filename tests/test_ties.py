"""Items of one price: events hold them in the order of the table, as the SQL does over rows in order."""

import duckdb
import pytest

import __spark_entry__ as entry

TIED = ("and_or_not", "delta_phi", "functions", "predicate_as_number")


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Orders whose items' prices are often equal; the items lie in two files, in no order of their columns."""
    d = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.sql("set threads = 1")
    (d / "lineitem.parquet").mkdir()
    item = "select (i * 7919) % 400 as l_orderkey, (hash(i, 1) % 999)::bigint as l_partkey, (hash(i, 2) % 99)::bigint as l_suppkey, 1 + i % 7 as l_linenumber, 1.0::double as l_quantity, (40000 + hash(i, 3) % 3 * 20000)::double as l_extendedprice, (hash(i, 4) % 11) / 100.0 as l_discount, (hash(i, 5) % 9) / 100.0 as l_tax, case when hash(i, 6) % 2 = 0 then 'R' else 'N' end as l_returnflag, 'F' as l_linestatus from range({0}, {1}) t(i)"
    for name, a, b in (("b", 700, 1600), ("a", 0, 700)):
        con.sql(f"copy ({item.format(a, b)}) to '{d}/lineitem.parquet/{name}.parquet'")
    con.sql(f"copy (select i as o_orderkey, (i % 50)::bigint as o_custkey, 'O' as o_orderstatus, 90000.0::double as o_totalprice, '1-URGENT' as o_orderpriority from range(400) t(i)) to '{d}/orders.parquet'")
    for name, at in (("orders", f"{d}/orders.parquet"), ("lineitem", f"{d}/lineitem.parquet/*.parquet")):
        con.sql(f"create table {name} as select * from read_parquet('{at}')")
    return str(d), con


@pytest.mark.parametrize("name", TIED)
def test_ties_stand_as_in_the_table(spark, tied, name):
    d, con = tied
    got = sorted(tuple(r) for r in entry.queries()[name](spark, d).collect())
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
