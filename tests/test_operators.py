"""Hand-computed cases and leakage checks."""
import math

from pyspark.sql import functions as F

from spreadlens.functions.tails import chi2_sf, unit_root_p
from spreadlens.operators import backtest as T, book as K, features as X, screens as S, tape as Q


def ticks(spark, prices, sides=None):
    rows = [("A", i, 1_000_000 * i, float(p), (sides or ["buy"] * len(prices))[i]) for i, p in enumerate(prices)]
    d = spark.createDataFrame(rows, "symbol string, trade_id long, us long, price double, side string")
    return d.withColumns({"ts": F.timestamp_micros("us"), "notional": F.col("price"), "amount": F.lit(1.0)})


def test_tick_rule(spark):
    d = Q.tick_rule(ticks(spark, [100, 100.1, 100, 100, 99.9, 99.9, 100.1]), width_us=2_000_000)
    assert [r[0] for r in d.orderBy("trade_id").select("tick_sign").collect()] == [0, 1, -1, -1, -1, -1, 1]


def test_size_buckets_and_aggressor(spark):
    d = spark.createDataFrame([(1, 100.0), (2, 500.0), (3, 5e3), (4, 5e4), (5, 5e5)], "id int, notional double")
    assert [r[0] for r in d.orderBy("id").select(Q.size_bucket()).collect()] == ["retail", "retail", "mid", "large", "institutional"]
    s = ticks(spark, [1.0] * 4, ["buy", "sell", "buy", ""])
    assert [r[0] for r in s.orderBy("trade_id").select(Q.aggressor_sign()).collect()] == [1, -1, 1, 0]


def test_book_walk(spark):
    d = spark.createDataFrame([(100.0, 1.5, 101.0, 100.0, 99.0, 1.0, 98.0, 1.0)], "ask_px_1 double, ask_sz_1 double, ask_px_2 double, ask_sz_2 double, bid_px_1 double, bid_sz_1 double, bid_px_2 double, bid_sz_2 double")
    r = K.fill_columns(d, F.lit(1000.0), F.lit("buy"), 2).first()
    assert abs(r["vwap"] - 1000 / (1.5 + 850 / 101)) < 1e-9 and r["filled"] == 1000.0 and r["levels_used"] == 2


def pair(spark, signal, close_a, close_b, beta=0.5):
    rows = [("A_B", i, s, a, b, beta) for i, (s, a, b) in enumerate(zip(signal, close_a, close_b))]
    return spark.createDataFrame(rows, "pair string, i int, signal double, close_a double, close_b double, beta double")


def test_cost_only_and_known_return(spark):
    cost = T.pair_pnl(pair(spark, [0.0, 1.0] + [1.0] * 8, [100.0] * 10, [50.0] * 10), T.Costs(taker_fee_bps=10, slippage_bps=5))
    assert abs(cost.agg(F.sum("cost")).first()[0] - 22.5) < 1e-9
    known = T.pair_pnl(pair(spark, [1.0] * 5, [100.0, 101.0, 101.0, 101.0, 101.0], [50.0] * 5), T.Costs(taker_fee_bps=0, slippage_bps=0))
    assert abs(known.agg(F.sum("pnl")).first()[0] - 100.0) < 1e-9


def test_state_machine_makes_two_transitions(spark):
    rows = [("A_B", i, 3.0 if 20 <= i <= 79 else 0.0, 1.0, 0) for i in range(100)]
    d = spark.createDataFrame(rows, "pair string, i int, latest_spread_z double, current_spread double, pred_class int")
    s = [r[0] for r in T.class_machine(d, ["pair"]).orderBy("i").select("signal").collect()]
    assert sum(a != b for a, b in zip([0.0] + s, s)) == 2


def test_hysteresis_equals_a_sequential_loop(spark):
    z = [3 * math.sin(i / 7) + 2 * math.sin(i / 3.1) for i in range(400)]
    cur, want = 0.0, []
    for v in z:
        if abs(v) >= 4 or abs(v) <= 0.5:
            cur = 0.0
        elif cur == 0.0:
            cur = -1.0 if v >= 2 else 1.0 if v <= -2 else 0.0
        want.append(cur)
    d = spark.createDataFrame([("p", i, v) for i, v in enumerate(z)], "pair string, i int, z double")
    assert [r[0] for r in T.hysteresis(d, "z", ["pair"]).orderBy("i").select("position").collect()] == want


def test_a_late_spike_changes_no_earlier_feature(spark):
    cfg = X.FeatureConfig(z_window=60, block_rows=100)
    base = [("p", i, math.sin(i / 9) + 0.01 * i) for i in range(600)]
    bent = [(p, i, v + (50 if i > 500 else 0)) for p, i, v in base]
    cols = ["spread_z", "spread_diff_24", "spread_vol_24", "spread_vol_z"]
    get = lambda rows: X.spread_features(spark.createDataFrame(rows, "pair string, i long, spread double"), cfg).where("i <= 500").orderBy("i").select("i", *cols).collect()
    assert get(base) == get(bent)


def test_unit_root_tails():
    assert abs(unit_root_p(-2.86) - 0.05) < 0.002 and abs(unit_root_p(-3.34, 2) - 0.05) < 0.002
    assert abs(chi2_sf(31.41, 20) - 0.05) < 1e-4


def test_adf_separates_noise_from_a_walk(spark):
    import numpy as np
    r = np.random.default_rng(3)
    e = r.normal(size=1500)
    rows = [("noise", i, float(v)) for i, v in enumerate(e)] + [("walk", i, float(v)) for i, v in enumerate(np.cumsum(e))]
    p = {x["k"]: x["adf_pvalue"] for x in S.adf(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], "x").collect()}
    assert p["noise"] < 0.01 < 0.05 < p["walk"]


def test_legs_of_every_pair(spark):
    from spreadlens.operators import bars as B, info as N
    rows = [(s, i, float(i * (k + 1)), "d") for k, s in enumerate("ABC") for i in range(60) if (i + k) % 5]
    d = spark.createDataFrame(rows, "symbol string, i long, v double, day string")
    pairs = spark.createDataFrame([("A_B", "A", "B", 0.5), ("A_C", "A", "C", 2.0), ("B_C", "B", "C", 1.0)], "pair string, sym_a string, sym_b string, beta double")
    value = {(s, i): v for s, i, v, _ in rows}
    want = sorted((f"{a}_{b}", i, value[a, i], value[b, i]) for a, b in ("AB", "AC", "BC") for i in range(60) if (a, i) in value and (b, i) in value)
    got = B.pair_legs(d, pairs, "i", ["day"])
    assert sorted(tuple(r) for r in got.select("pair", "i", "v_a", "v_b").collect()) == want
    flow = d.select("symbol", "day", "i", F.log(F.col("v") + 1).alias("lm"), F.col("v").alias("trade_ofi"), F.lit(2.0).alias("buy"), F.lit(3.0).alias("sell"))
    two = {(r["pair"], r["i"]): r for r in N.two_leg_flow(flow, pairs, 4).collect()}
    at = sorted(i for p, i in two if p == "A_C")
    for n, i in enumerate(at):
        assert abs(two["A_C", i]["ofi"] - sum(value["A", j] / 5 - 2 * value["C", j] / 5 for j in at[max(0, n - 3):n + 1] if j > i - 4)) < 1e-9 or any(b - a != 1 for a, b in zip(at[max(0, n - 3):n + 1], at[max(0, n - 3) + 1:n + 1]))
