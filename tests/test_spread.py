"""What one task reads: no query over tables deals all events to a few tasks."""

import re

from eventloom import catalog_data


def test_exact_merge_spreads_events(spark):
    df = catalog_data.exact_merge_query(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"partitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(set(dealt)) == 3 and min(dealt) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(r["alike"] and r["near"] for r in df.collect())
