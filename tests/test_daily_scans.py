"""The daily table reads the line items once; the sums over time run on its own rows."""
from spreadlens.sources.adapters import Tables


def test_sums_over_time_do_not_read_line_items(spark):
    d = Tables(spark, "/root/testdata/sf0.001")._daily()
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "l_shipdate" not in plan
