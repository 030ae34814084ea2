"""Rounding as the oracle does it, rows kept by their unrounded value, and trades that end exactly on a bucket's border."""
import duckdb
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import tape as Q
from spreadlens.plans import registry, t4_info


def test_rounds_like_the_oracle(spark):
    values = [9.797907499999999, -9.797907499999999, 1.0000005, 2.5e-7, 5e-7, -5e-7, 1234567890.1234565, 0.0, None]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(registry.rnd("x")).toDF("x").collect()]
    assert got == [duckdb.execute(f"SELECT {registry.rnd_sql('CAST(? AS DOUBLE)')}", [v]).fetchall()[0][0] for v in values]
    assert got[0] == 9.797908


def test_two_leg_rows_are_chosen_before_rounding(spark, monkeypatch):
    flow = spark.createDataFrame([("A_B", 1, 3e-7, 0.5), ("A_B", 2, 1e-16, 0.5), ("A_B", 3, 0.25, 0.5)], "pair string, i long, ofi double, spread double")
    monkeypatch.setattr(t4_info, "two_leg", lambda t: flow)
    got = registry.QUERIES["inf11_two_leg_flow"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["i"], r["ofi"]) for r in got) == [(1, 0.0), (3, 0.25)]


@pytest.mark.parametrize("width", [3_000_000, 10**12])
def test_a_trade_on_the_border_opens_the_next_bucket(spark, width):
    rows = [("A", i, i * 1_000_000, 0.1 if i % 3 else -0.1) for i in range(100)]
    d = spark.createDataFrame(rows, "symbol string, trade_id long, us long, signed_notional double").repartition(3).withColumn("ts", F.timestamp_micros("us"))
    got = {r["bucket_no"]: (r["s"], r["imbalance"]) for r in Q.vpin_tape(d, 1.0, 10, width).withColumn("s", F.unix_micros("end_ts")).collect()}
    want = {}
    for n, i, us, v in rows:
        want.setdefault((i + 1) // 10, []).append((us, round(v * 10)))
    assert got == {k: (max(us for us, _ in v), pytest.approx(abs(sum(x for _, x in v)) / 10)) for k, v in want.items()}
