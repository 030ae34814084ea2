"""Signs and sweeps in one pass over the tape, in chunks of a few trades, against loops; and the pass itself is counted."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import tape as Q


def rows_of(seed, n=400):
    r = np.random.default_rng(seed)
    t = np.cumsum(r.integers(0, 90_000, n))
    price = 100 + np.cumsum(r.integers(-1, 2, n) * (r.random(n) < 0.4)) / 10
    side = r.choice(["buy", "sell", ""], n)
    return [("ABC"[int(r.integers(0, 3))], i, int(t[i]), float(price[i]), str(side[i])) for i in range(n)]


def trades(spark, rows):
    d = spark.createDataFrame(rows, "symbol string, trade_id long, us long, price double, side string").repartition(3)
    return d.withColumns({"ts": F.timestamp_micros("us"), "notional": F.col("price"), "amount": F.lit(1.0)})


def quotes(rows, seed):
    r = np.random.default_rng(seed)
    return [(s, n, int(us + r.integers(-1, 2) * (n % 3)), p - 0.05 * int(r.integers(0, 3)), p + 0.05 * int(r.integers(0, 3))) for n, (s, _, us, p, _) in enumerate(rows) if r.random() < 0.5]


def loop(rows, book, max_gap_ms):
    ticks, signs, last, tick, runs = {}, {}, {}, {}, {}
    for s, i, us, p, side in sorted(rows, key=lambda x: (x[2], x[1])):
        if s in last and p != last[s]:
            tick[s] = 1 if p > last[s] else -1
        last[s] = p
        ticks[i] = tick.get(s, 0)
        mid = [(b + a) / 2 for q, n, at, b, a in sorted(book, key=lambda x: (x[2], x[1])) if q == s and at <= us]
        quote = ticks[i] if not mid or p == mid[-1] else 1 if p > mid[-1] else -1
        signs[i] = {"buy": 1, "sell": -1}.get(side, quote)
        own = {"buy": 1, "sell": -1}.get(side, ticks[i])
        run = runs.setdefault(s, [])
        if run and run[-1][-1][3] == own and (us - run[-1][-1][1]) // 1000 <= max_gap_ms:
            run[-1].append((i, us, p, own))
        else:
            run.append([(i, us, p, own)])
    kept = sorted((s, r[0][1], r[-1][1], r[0][3], len(r), len({x[2] for x in r})) for s, v in runs.items() for r in v if len(r) > 1 and len({x[2] for x in r}) > 1)
    return ticks, signs, kept


@pytest.mark.parametrize("width", [300_000, 10**12])
def test_signs_and_sweeps(spark, width):
    rows = rows_of(width % 97)
    book = quotes(rows, 4)
    ticks, signs, kept = loop(rows, book, 50)
    d = trades(spark, rows)
    b = spark.createDataFrame(book, "symbol string, seq long, us long, bid_px_1 double, ask_px_1 double").withColumn("ts", F.timestamp_micros("us"))
    assert {r["trade_id"]: r["tick_sign"] for r in Q.tick_rule(d, width_us=width).collect()} == ticks
    got = Q.signed_trades(d, b, width)
    assert got.columns == [*d.columns, "trade_sign", "signed_notional", "bucket"]
    assert {r["trade_id"]: r["trade_sign"] for r in got.collect()} == signs
    s = Q.sweeps(d, 50, width).select("symbol", F.unix_micros("start_ts"), F.unix_micros("end_ts"), "side", "n_trades", "levels_walked_est")
    assert sorted(tuple(r) for r in s.collect()) == kept


def test_one_scan_and_one_exchange_of_the_rows(spark, tmp_path):
    rows = rows_of(1)
    trades(spark, rows).write.parquet(f"{tmp_path}/t")
    b = spark.createDataFrame(quotes(rows, 4), "symbol string, seq long, us long, bid_px_1 double, ask_px_1 double").withColumn("ts", F.timestamp_micros("us"))
    b.write.parquet(f"{tmp_path}/b")
    t, b = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/b")
    for df, scans in ((Q.tick_rule(t), 1), (Q.signed_trades(t, b), 2), (Q.sweeps(t), 1)):
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert text.count("FileScan") == scans, text
        assert text.count("REPARTITION_BY_COL") >= 1 and "ReusedExchange" in text
