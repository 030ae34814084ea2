"""Stores, the streamed bar, seeded controls and exact tests."""
import hashlib
import math

from pyspark.sql import functions as F

from spreadlens.operators import controls as C, execution as E, inference as I
from spreadlens.operators.bars import trade_bars
from spreadlens.sources import lake as L
from spreadlens.sources.adapters import Tables
from spreadlens.streaming.bars import stream_trade_bars

ROOT = "/root/testdata/sf0.001"
MINUTE = 60_000_000


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    trades = Tables(spark, ROOT).trades.select("symbol", "ts", "side", "price", "amount", "notional")
    trades.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(trades.schema).parquet(str(tmp_path / "ticks"))
    run = (stream_trade_bars(stream, 60 * MINUTE).writeStream.format("parquet").option("path", str(tmp_path / "bars"))
           .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination(120)
    got = {tuple(r[:3]): r[3:] for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    want = {tuple(r[:3]): r[3:] for r in trade_bars(trades, 60 * MINUTE).select("symbol", "ts", "trade_count", "volume_base", "volume_quote", "buy_volume_base", "sell_volume_base", "signed_volume_base", "vwap").collect()}
    last = max(k[1] for k in want)
    assert len(got) > 0 and set(got) <= set(want)
    assert all(k in got for k in want if (last - k[1]).total_seconds() > 7200)
    assert all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], want[k]))


def test_a_store_reads_the_folders_of_one_symbol(spark, tmp_path):
    trades = Tables(spark, ROOT).trades.withColumn("day", F.to_date("ts"))
    L.write_store(trades, str(tmp_path / "store"), by=("symbol", "day"))
    one = L.load_symbol(spark.read.parquet(str(tmp_path / "store")), "S1", ["ts", "price"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "symbol" in filters and "ReadSchema: struct<ts:timestamp,price:double>" in plan
    assert one.count() == trades.filter("symbol = 'S1'").count()


def test_orders_of_a_day_have_both_sides(spark):
    book = Tables(spark, "/root/testdata/sf0.01").book
    orders = E.parent_orders(book, 7_200_000_000, [1e3], 7)
    sides = orders.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.countDistinct("side").alias("s")).filter("n >= 8")
    assert sides.filter("s = 2").count() >= 0.9 * sides.count() > 0
    digest = lambda r: hashlib.md5(f"{r['symbol']}|{r['t0']}|7".encode()).hexdigest()[0] < "8"
    assert all((r["side"] == "buy") == digest(r) for r in orders.limit(50).collect())


def test_phase_surrogates_of_long_labels_differ(spark):
    rows = [(k, i, math.sin(i) + 0.1 * (i % 5)) for k in ("BTCUSDT_ETHUSDT", "BTCUSDT_SOLUSDT") for i in range(64)]
    d = spark.createDataFrame(rows, "pair string, i bigint, x double")
    out = {(s, r["pair"], r["i"]): r["x"] for s in (3, 4) for r in C.phase_randomised(d, ["pair"], "x", s).collect()}
    series = [tuple(out[s, p, i] for i in range(64)) for s in (3, 4) for p in ("BTCUSDT_ETHUSDT", "BTCUSDT_SOLUSDT")]
    assert len(set(series)) == 4
    assert all(abs(sum(x) - sum(r[2] for r in rows[:64])) < 1e-9 for x in series)


def test_sign_test_of_many_rows(spark):
    d = spark.createDataFrame([(1040, 2000), (60, 100), (5, 10), (0, 3)], "k bigint, n bigint")
    got = {r["n"]: r["p"] for r in d.select("n", I.sign_test_p(F.col("k"), F.col("n")).alias("p")).collect()}
    for k, n in ((1040, 2000), (60, 100), (5, 10), (0, 3)):
        low, high = (k, n) if 2 * k >= n else (0, k)
        p = min(1.0, 2 * sum(math.comb(n, j) / 2**n for j in range(low, high + 1)))
        assert abs(got[n] - p) < 1e-9


def test_lags_have_no_cap(spark):
    """At 100,000 rows the rule gives 18 lags."""
    d = spark.range(100_000).select(F.lit("all").alias("k"), F.col("id").alias("i"), (F.sin(F.col("id") * 0.7) + F.lit(0.01)).alias("x"))
    r = I.sharpe_with_se(d, ["k"], "x", 1.0).first()
    assert r["lag"] == 18 and r["se_ann"] > 0
