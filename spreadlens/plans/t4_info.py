"""Information features, cancellations, hidden liquidity, impact, lead-lag, execution study (INF, BK12-20, INR10-25, EX)."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..core.ordered import DAY_US, HOUR_US, MINUTE_US
from ..operators import bars as B, book as K, execution as E, inference as I, info as N, tape as Q
from ..operators.panel import bar_index
from .base_tables import tape_pairs
from .registry import query, rnd, rnd_sql as R, rounded, unit_sql as U
from .t2_book_tape import PRICE_FEATS, VAR_SQL, walk_sql

c = F.col
_H = "make_timestamp((epoch_us(ts) + 3599999999) // 3600000000 * 3600000000)"


def tb(t):
    return t.store("trade_bars_1m", lambda: B.trade_bars(t.trades, MINUTE_US))


def dense(t):
    return t.store("dense_flow_1m", lambda: N.dense_flow(t.book, t.trades, MINUTE_US, 30, (1, 10)))


def minute(t):
    return t.store("minute_mid", lambda: B.dense_mid(t.book, MINUTE_US))


def episodes(t):
    return t.store("episodes", lambda: N.episodes(t.book, t.trades))


def har(t):
    return t.store("hourly_measures", lambda: B.realised_measures(t.book, t.trades))


@query("bk12_cancel_buckets", "SELECT symbol, i, CAST(book_ofi AS BIGINT) AS book_ofi, CAST(bid_dec AS BIGINT) AS bid_dec, CAST(ask_dec AS BIGINT) AS ask_dec, CAST(bid_cancel AS BIGINT) AS bid_cancel, CAST(ask_cancel AS BIGINT) AS ask_cancel, CAST(cancel_imb AS BIGINT) AS cancel_imb FROM v_cancel")
def _(t):
    d = N.cancel_buckets(t.book, t.trades, MINUTE_US)
    return d.select("symbol", "i", *[c(x).cast("long").alias(x) for x in ("book_ofi", "bid_dec", "ask_dec", "bid_cancel", "ask_cancel", "cancel_imb")])


@query("bk13_cancel_share", f"""WITH d AS (SELECT symbol, day, sum(bid_dec) AS bd, sum(ask_dec) AS ad, sum(buy) AS b, sum(sell) AS s, sum(bid_cancel + ask_cancel) AS ca FROM v_cancel GROUP BY 1, 2)
SELECT symbol, {R('CAST(sum(ca) AS DOUBLE) / nullif(sum(bd + ad), 0)')} AS cancel_share, {R('CAST(sum(greatest(bd - s, 0) + greatest(ad - b, 0)) AS DOUBLE) / nullif(sum(bd + ad), 0)')} AS cancel_share_day FROM d GROUP BY symbol""")
def _(t):
    return rounded(N.cancel_share(N.cancel_buckets(t.book, t.trades, MINUTE_US)), "cancel_share", "cancel_share_day")


@query("bk18_episodes", "SELECT symbol, side, price, max_disp, exec_vol, start_ts, end_ts, hidden FROM v_episodes")
def _(t):
    return episodes(t).select("symbol", "side", "price", "max_disp", "exec_vol", "start_ts", "end_ts", "hidden")


@query("bk19_hidden_summary", f"""SELECT symbol, count(*) AS traded_episodes, count(*) FILTER (hidden > 0) AS iceberg_episodes, sum(exec_vol) AS exec_vol, sum(hidden) AS hidden_vol, {R('sum(hidden) / sum(exec_vol)')} AS hidden_frac,
 {R('sum(hidden * price) / sum(exec_vol * price)')} AS hidden_frac_notional, {R('count(*) FILTER (hidden > 0) * 1e0 / count(*)')} AS iceberg_rate FROM v_episodes GROUP BY symbol""")
def _(t):
    return rounded(N.hidden_summary(episodes(t)), "hidden_frac", "hidden_frac_notional", "iceberg_rate")


_PANEL = PRICE_FEATS + """, hp AS (SELECT e.symbol, epoch_us(start_ts) // 3600000000 AS hour, sum(exec_vol) AS exec_vol, sum(hidden) AS hidden, count(*) AS n_ep, count(*) FILTER (hidden > 0) AS n_ice,
 coalesce(sum(hidden) FILTER (side = 'ask'), 0) AS ha, coalesce(sum(hidden) FILTER (side = 'bid'), 0) AS hb FROM v_episodes e GROUP BY 1, 2),
pn AS (SELECT hp.symbol, hp.hour, hidden / exec_vol AS hidden_fraction, n_ice * 1e0 / n_ep AS iceberg_rate, (ha - hb) / exec_vol AS signed_hidden, pf.rv, pf.ret, pf.trade_count, pf.ofi_norm, nx.rv AS rv_next, nx.ret AS ret_next, nx.hour IS NOT NULL AS contig
 FROM hp JOIN pf ON pf.symbol = hp.symbol AND pf.hour = hp.hour LEFT JOIN (SELECT a.symbol, a.hour, a.rv, a.ret FROM pf a JOIN hp b ON a.symbol = b.symbol AND a.hour = b.hour) nx ON nx.symbol = hp.symbol AND nx.hour = hp.hour + 1)"""


def hidden_panel(t):
    return t.store("hidden_panel", lambda: N.hidden_hourly(episodes(t), B.hourly_price_features(t.book, t.trades)))


@query("bk20_hidden_hourly", _PANEL + f" SELECT symbol, hour, {R('hidden_fraction')} AS hidden_fraction, {R('iceberg_rate')} AS iceberg_rate, {R('signed_hidden')} AS signed_hidden, {R('rv_next', 9)} AS rv_next, {R('ret_next', 9)} AS ret_next, contig FROM pn")
def _(t):
    d = rounded(hidden_panel(t), "hidden_fraction", "iceberg_rate", "signed_hidden")
    return rounded(d, "rv_next", "ret_next", digits=9).select("symbol", "hour", "hidden_fraction", "iceberg_rate", "signed_hidden", "rv_next", "ret_next", "contig")


@query("inr25_hidden_regressions")
def _(t):
    d = hidden_panel(t).where(c("contig")).dropna(subset=["rv", "rv_next", "ret_next", "trade_count", "rel_spread"])
    d = t.store("hidden_winsorised", lambda d=d: I.winsorise(d, ["rv", "rv_next"], upper=0.999))
    d = I.standardise(d, ["hidden_fraction", "iceberg_rate", "signed_hidden", "rv", "trade_count", "ofi_norm", "ret", "rv_next", "ret_next"], ["symbol"])
    from ..core.ordered import row_index
    from ..operators.panel import index_ts
    d = t.store("hidden_regressors", lambda d=d: row_index(d.withColumn("ts", index_ts("hour", HOUR_US)), [], ["ts", "symbol"], "i"))
    runs = {"vol_base": ("rv_next_z", ["rv_z", "trade_count_z"]), "vol_full": ("rv_next_z", ["rv_z", "trade_count_z", "hidden_fraction_z", "iceberg_rate_z"]),
            "ret_now": ("ret_z", ["signed_hidden_z", "ofi_norm_z"]), "ret_next": ("ret_next_z", ["signed_hidden_z", "ofi_norm_z"])}
    out = None
    for k, (y, xs) in runs.items():
        r = I.ols_hac(d, [], y, xs, 3, standardise=False).withColumn("model", F.lit(k))
        out = r if out is None else out.unionByName(r)
    return out


@query("inf1_hourly_ofi", f"SELECT symbol, {_H} AS ts, {R('sum(volume_quote)', 2)} AS volume_quote, CAST(sum(trade_count) AS BIGINT) AS trade_intensity, {R('sum(signed) / sum(volume_base)')} AS order_flow_imbalance FROM v_tb GROUP BY 1, 2")
def _(t):
    d = N.hourly_flow(tb(t))
    return d.select("symbol", "ts", rnd("volume_quote", 2).alias("volume_quote"), "trade_intensity", rnd("order_flow_imbalance").alias("order_flow_imbalance"))


_VP = f"""WITH b AS (SELECT *, {_H} AS hts FROM v_tb), k AS (SELECT *, sum(buy + sell) OVER (PARTITION BY symbol, hts ORDER BY ts) AS cum, sum(buy + sell) OVER (PARTITION BY symbol, hts) AS tot FROM b),
g AS (SELECT symbol, hts, least(floor(cum * 50 / tot), 49) AS bk, sum(abs(buy - sell)) AS im, sum(buy + sell) AS v FROM k WHERE tot > 0 GROUP BY ALL),
vp AS (SELECT symbol, hts AS ts, avg(im / v) AS vpin FROM g WHERE v > 0 GROUP BY 1, 2)"""


@query("inf2_vpin_hour", _VP + f" SELECT symbol, ts, {R('vpin')} AS vpin FROM vp")
def _(t):
    return rounded(N.vpin_hour(tb(t)), "vpin")


@query("inf3_vpin_tape", f"""WITH k AS (SELECT *, floor(sum(abs(signed_notional)) OVER (PARTITION BY symbol ORDER BY ts, trade_id) / 1e6) AS bk FROM v_signed),
g AS (SELECT symbol, CAST(bk AS BIGINT) AS bucket_no, max(ts) AS end_ts, abs(sum(greatest(signed_notional, 0e0)) - sum(greatest(-signed_notional, 0e0))) / 1e6 AS imb FROM k GROUP BY 1, 2)
SELECT symbol, bucket_no, end_ts, {R('imb', 9)} AS imbalance, {R('avg(imb) OVER (PARTITION BY symbol ORDER BY bucket_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 9)} AS vpin FROM g""")
def _(t):
    return rounded(rounded(Q.vpin_tape(Q.signed_trades(t.trades, t.book), 1e6, 10), "imbalance", digits=9), "vpin", digits=9)


@query("inf4_vpin_day", f"""WITH k AS (SELECT *, CAST(ts AS DATE) AS day, sum(volume_base) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS cum, sum(volume_base) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS tot FROM v_tb),
g AS (SELECT symbol, day, least(floor(cum * 50 / tot), 49) AS bk, sum(buy) AS b, sum(sell) AS s, sum(volume_base) AS v, max(ts) AS cts FROM k GROUP BY ALL HAVING sum(volume_base) > 0),
r AS (SELECT *, count(*) OVER (PARTITION BY symbol, day) AS n, count(*) OVER f AS m, avg(abs(b - s) / v) OVER f AS vpin FROM g WINDOW f AS (PARTITION BY symbol, day ORDER BY bk ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT symbol, date_trunc('hour', cts) AS hour_ts, {R('avg(vpin)')} AS vpin FROM r WHERE n >= 6 AND m >= 5 GROUP BY 1, 2""")
def _(t):
    return rounded(N.vpin_day(tb(t)), "vpin")


_KY = """mf AS (SELECT symbol, ts, mid, sv FROM (SELECT coalesce(b.symbol, f.symbol) AS symbol, coalesce(b.ts, f.ts) AS ts, last_value(mid IGNORE NULLS) OVER (PARTITION BY coalesce(b.symbol, f.symbol) ORDER BY coalesce(b.ts, f.ts)) AS mid, coalesce(sv, 0e0) AS sv
 FROM (SELECT symbol, ts, (bid_px_1 + ask_px_1) / 2e0 AS mid FROM v_book) b FULL JOIN (SELECT symbol, ts, signed AS sv FROM v_tb) f ON b.symbol = f.symbol AND b.ts = f.ts) WHERE mid IS NOT NULL),
kr AS (SELECT symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, sv, mid / lag(mid) OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts) - 1 AS r FROM mf),
ky AS (SELECT symbol, ts, count(*) AS n, regr_slope(r, sv) AS kyle FROM kr WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND var_pop(sv) > 0)"""


@query("inf5_kyle_lambda", "WITH " + _KY + f" SELECT symbol, ts, n, {R('kyle * 1e6', 5)} AS kyle_lambda FROM ky")
def _(t):
    d = N.kyle_lambda(N.mid_flow_rows(t.book, tb(t)), 3)
    return d.select("symbol", "ts", "n", rnd(c("kyle_lambda") * 1e6, 5).alias("kyle_lambda"))


@query("inf6_mid_flow_rows", "WITH " + _KY + f" SELECT symbol, ts, {R('mid')} AS mid, sv, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_ts FROM mf")
def _(t):
    return rounded(N.mid_flow_rows(t.book, tb(t)), "mid")


_INFO = _VP + ", " + _KY + f""", hf AS (SELECT symbol, {_H} AS ts, sum(volume_quote) AS volume_quote, CAST(sum(trade_count) AS BIGINT) AS trade_intensity, sum(signed) / sum(volume_base) AS ofi FROM v_tb GROUP BY 1, 2),
qs AS (SELECT symbol, {_H} AS ts, avg((ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2e0) * 1e4) AS qsp FROM v_book GROUP BY 1, 2),
inf AS (SELECT hf.*, vp.vpin, ky.kyle, qs.qsp FROM hf LEFT JOIN vp ON vp.symbol = hf.symbol AND vp.ts = hf.ts LEFT JOIN ky ON ky.symbol = hf.symbol AND ky.ts = hf.ts LEFT JOIN qs ON qs.symbol = hf.symbol AND qs.ts = hf.ts)"""


def info(t):
    return t.store("hourly_info", lambda: N.hourly_information(t.book, tb(t), 3))


@query("inf7_hourly_information", _INFO + f" SELECT symbol, ts, {R('volume_quote', 2)} AS volume_quote, trade_intensity, {R('ofi')} AS order_flow_imbalance, {R('vpin')} AS vpin, {R('kyle * 1e6', 5)} AS kyle_lambda, {R('qsp')} AS quoted_spread_bps FROM inf")
def _(t):
    d = info(t).withColumn("kyle_lambda", rnd(c("kyle_lambda") * 1e6, 5))
    d = rounded(rounded(d, "volume_quote", digits=2), "order_flow_imbalance", "vpin", "quoted_spread_bps")
    return d.select("symbol", "ts", "volume_quote", "trade_intensity", "order_flow_imbalance", "vpin", "kyle_lambda", "quoted_spread_bps")


@query("inf8_enrich_pairs", _INFO + f""" SELECT a.symbol || '_' || b.symbol AS pair, a.ts, {R('ia.ofi')} AS ofi_a, {R('ib.vpin')} AS vpin_b FROM v_bars_1h a JOIN v_bars_1h b ON a.ts = b.ts AND a.symbol < b.symbol
 LEFT JOIN inf ia ON ia.symbol = a.symbol AND ia.ts = a.ts LEFT JOIN inf ib ON ib.symbol = b.symbol AND ib.ts = b.ts""")
def _(t):
    d = B.pair_bars(t.bars_1h.select("symbol", "ts", "close"), tape_pairs(t))
    return N.enrich_pairs(d, info(t)).select("pair", "ts", rnd("micro_order_flow_imbalance_a").alias("ofi_a"), rnd("micro_vpin_b").alias("vpin_b"))


@query("inf9_cross_leg", _INFO + f" SELECT a.symbol || '_' || b.symbol AS pair, a.ts, {R('a.ofi - b.ofi')} AS ofi_divergence, {R('greatest(a.vpin, b.vpin)')} AS vpin_max, {R('a.volume_quote / nullif(b.volume_quote, 0e0)')} AS volume_quote_ratio FROM inf a JOIN inf b ON a.ts = b.ts AND a.symbol < b.symbol")
def _(t):
    d = N.cross_leg_signals(info(t), tape_pairs(t))
    return rounded(d, "ofi_divergence", "vpin_max", "volume_quote_ratio").select("pair", "ts", "ofi_divergence", "vpin_max", "volume_quote_ratio")


@query("src23_precomputed_panel", _INFO + f" SELECT symbol, ts, {R('ofi')} AS order_flow_imbalance FROM inf WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def _(t):
    from ..sources import lake as L
    path = L.scratch_folder(t.spark)
    L.write_store(info(t), path)
    return rounded(L.load_range(t.spark.read.parquet(path), "2024-01-05", "2024-01-09").select("symbol", "ts", "order_flow_imbalance"), "order_flow_imbalance")


@query("inf10_trailing_flow", f"SELECT symbol, i, CAST(bofi_tr AS BIGINT) AS book_ofi_tr, CAST(tofi_tr AS BIGINT) AS trade_ofi_tr, CAST(cimb_tr AS BIGINT) AS cancel_imb_tr, {R('fwd10', 9)} AS fwd10 FROM v_dense WHERE bofi_tr <> 0")
def _(t):
    d = dense(t).where("book_ofi_tr <> 0")
    return d.select("symbol", "i", *[c(x).cast("long").alias(x) for x in ("book_ofi_tr", "trade_ofi_tr", "cancel_imb_tr")], rnd("fwd10", 9).alias("fwd10"))


_TWO = """WITH tl AS MATERIALIZED (SELECT p.pair, a.day, a.i, a.lm - p.beta * b.lm AS sp, coalesce(a.trade_ofi / nullif(a.buy + a.sell, 0), 0e0) - p.beta * coalesce(b.trade_ofi / nullif(b.buy + b.sell, 0), 0e0) AS flow FROM v_legs p JOIN v_dense a ON a.symbol = p.sym_a JOIN v_dense b ON b.symbol = p.sym_b AND a.i = b.i),
tw AS MATERIALIZED (SELECT *, sum(flow) OVER (PARTITION BY pair ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ofi, (sp - lag(sp) OVER w) * 1e4 AS y_now, (lead(sp, 1) OVER w - sp) * 1e4 AS y1, (lead(sp, 5) OVER w - sp) * 1e4 AS y5 FROM tl WINDOW w AS (PARTITION BY pair ORDER BY i))"""


def two_leg(t):
    return N.two_leg_flow(dense(t), tape_pairs(t), 10)


@query("inf11_two_leg_flow", _TWO + f" SELECT pair, i, {R('ofi')} AS ofi, {R('sp', 8)} AS spread FROM tw WHERE abs(ofi) > 1e-9")
def _(t):
    d = two_leg(t).where(F.abs("ofi") > 1e-9)     # before rounding: a small hedge leaves flows below the last digit
    return rounded(rounded(d, "ofi"), "spread", digits=8).select("pair", "i", "ofi", "spread")


def _hac_slope(name: str, y: str, lag: int) -> str:
    """Slope, Newey-West t, R2 per pair; rows without a return keep their place with a zero score."""
    auto = " + ".join(f"2 * {1 - j / (lag + 1)!r} * sum(u * u{j})" for j in range(1, lag + 1))
    lags = ", ".join(f"lag(u, {j}) OVER w AS u{j}" for j in range(1, lag + 1))
    return f"""SELECT pair, '{name}' AS h, {R('any_value(b)', 5)} AS slope_bps, {R(f'any_value(b) / sqrt((sum(u * u) + {auto}) / (any_value(sxx) * any_value(sxx)))', 4)} AS t, {R('any_value(r2)', 8)} AS r2, any_value(n) AS n
 FROM (SELECT *, {lags} FROM (SELECT t.pair, i, b, sxx, r2, n, coalesce(({y} - my - b * (ofi - mx)) * (ofi - mx), 0e0) AS u FROM tw t
  JOIN (SELECT pair, regr_slope({y}, ofi) AS b, regr_sxx({y}, ofi) AS sxx, regr_r2({y}, ofi) AS r2, regr_count({y}, ofi) AS n, regr_avgx({y}, ofi) AS mx, regr_avgy({y}, ofi) AS my FROM tw GROUP BY pair) f ON f.pair = t.pair)
 WINDOW w AS (PARTITION BY pair ORDER BY i)) GROUP BY pair"""


@query("inr24_spread_return_on_flow", _TWO + " " + " UNION ALL ".join(_hac_slope(*x) for x in (("now", "y_now", 5), ("h1", "y1", 1), ("h5", "y5", 5))))
def _(t):
    d = N.spread_return_on_flow(two_leg(t), (1, 5))
    return rounded(rounded(rounded(d, "slope_bps", digits=5), "t", digits=4), "r2", digits=8)


@query("inf12_size_flow_corr", f"""WITH f AS (SELECT symbol, epoch_us(ts) // 3600000000 AS hour, coalesce(sum(CASE side WHEN 'buy' THEN notional WHEN 'sell' THEN -notional ELSE 0 END) FILTER (notional >= 1e5), 0) AS big,
 coalesce(sum(CASE side WHEN 'buy' THEN notional WHEN 'sell' THEN -notional ELSE 0 END) FILTER (notional < 1e5), 0) AS small FROM v_trades GROUP BY 1, 2), m AS (SELECT symbol, i // 60 AS hour, ln(arg_max(mid, i)) - ln(arg_min(mid, i)) AS r FROM v_minute WHERE mid IS NOT NULL GROUP BY 1, 2)
SELECT f.symbol, {R('corr(big, r)')} AS corr_big, {R('corr(small, r)')} AS corr_small FROM f JOIN m ON m.symbol = f.symbol AND m.hour = f.hour GROUP BY f.symbol""")
def _(t):
    s = Q.aggressor_sign() * c("notional")
    f = t.trades.groupBy("symbol", bar_index("ts", HOUR_US).alias("hour")).agg(B.sum_if(s, c("notional") >= 1e5).alias("big"), B.sum_if(s, c("notional") < 1e5).alias("small"))
    m = minute(t).where("mid IS NOT NULL").groupBy("symbol", F.floor(c("i") / 60).alias("hour")).agg((F.log(F.max_by("mid", "i")) - F.log(F.min_by("mid", "i"))).alias("r"))
    return f.join(m, ["symbol", "hour"]).groupBy("symbol").agg(rnd(I.safe_corr("big", "r")).alias("corr_big"), rnd(I.safe_corr("small", "r")).alias("corr_small"))


_IMP = """WITH o AS (SELECT symbol, ts, side, sum(notional) AS notional FROM v_trades WHERE side <> '' GROUP BY ALL),
x AS (SELECT *, epoch_us(ts) // 60000000 AS i, CASE WHEN notional < 1000 THEN 'retail' WHEN notional >= 10000 THEN 'institutional' ELSE 'mid' END AS size_class FROM o),
r AS (SELECT x.*, h, CASE side WHEN 'buy' THEN 1 ELSE -1 END * (b.mid - a.mid) / a.mid AS r FROM x JOIN (SELECT unnest([0, 1, 10, 60]) AS h) ON x.i % 1440 + 60 < 1440 JOIN v_minute a ON a.symbol = x.symbol AND a.i = x.i JOIN v_minute b ON b.symbol = x.symbol AND b.i = x.i + h WHERE a.mid IS NOT NULL AND b.mid IS NOT NULL),
s AS (SELECT symbol, size_class, h, count(*) AS n, avg(r) * 1e4 AS bps, avg(r / notional) * 1e10 AS ppm FROM r GROUP BY ALL)"""


def responses(t):
    return N.impact_response(Q.marketable_orders(t.trades), minute(t), (0, 1, 10, 60), MINUTE_US)


@query("inf13_impact_response", _IMP + f" SELECT symbol, size_class, h, n, {R('bps')} AS bps, {R('ppm', 3)} AS bps_per_million FROM s")
def _(t):
    return rounded(rounded(N.impact_summary(responses(t)), "bps"), "bps_per_million", digits=3)


@query("inf14_impact_decomposition", _IMP + f""" SELECT symbol, size_class, {R('max(bps)')} AS peak, arg_max(h, CASE WHEN h = h THEN bps * 1e6 - h * 1e-6 END) AS peak_h, {R('max(bps) FILTER (h = 60)')} AS permanent, {R('max(bps) - max(bps) FILTER (h = 60)')} AS transient FROM s GROUP BY 1, 2""")
def _(t):
    d = N.impact_decomposition(N.impact_summary(responses(t)), 60)
    return rounded(d, "peak", "permanent", "transient").drop("permanent_pct")


def _r2j(y, a, b):
    ra, rb, rab = f"corr({y}, {a})", f"corr({y}, {b})", f"corr({a}, {b})"
    return f"(({ra} ** 2 + {rb} ** 2 - 2 * {ra} * {rb} * {rab}) / nullif(1 - {rab} ** 2, 0e0))"


@query("inr11_incremental_r2", f"""SELECT symbol, {R('corr(fwd10, tofi_tr) ** 2', 8)} AS r2_trade, {R('corr(fwd10, bofi_tr) ** 2', 8)} AS r2_book, {R(_r2j('fwd10', 'tofi_tr', 'bofi_tr'), 8)} AS r2_joint,
 {R(_r2j('fwd10', 'tofi_tr', 'bofi_tr') + ' - corr(fwd10, tofi_tr) ** 2', 8)} AS incr_book FROM v_dense WHERE fwd10 IS NOT NULL GROUP BY symbol""")
def _(t):
    a, b, j = I.two_regressor_r2("fwd10", "trade_ofi_tr", "book_ofi_tr")
    return dense(t).where("fwd10 IS NOT NULL").groupBy("symbol").agg(rnd(a, 8).alias("r2_trade"), rnd(b, 8).alias("r2_book"), rnd(j, 8).alias("r2_joint"), rnd(j - a, 8).alias("incr_book"))


@query("inr10_hac_regression")
def _(t):
    return I.ols_hac(dense(t), ["symbol"], "fwd10", ["trade_ofi_tr", "book_ofi_tr", "cancel_imb_tr"], 10, min_n=100)


@query("inr10_two_regressor_r2", f"SELECT symbol, {R(_r2j('ret', 'trade_ofi', 'book_ofi'), 8)} AS r2, count(*) AS n FROM v_dense WHERE ret IS NOT NULL GROUP BY symbol")
def _(t):
    d = I.ols_fit(dense(t), ["symbol"], "ret", ["trade_ofi", "book_ofi"])
    return d.select("symbol", rnd("r2", 8).alias("r2"), "n")


@query("inr12_deep_book_regressions")
def _(t):
    b = t.book.select("symbol", "ts", "seq", K.fair_value_tilt().alias("tilt"), K.imbalance(10).alias("deep"), K.imbalance(10, 2).alias("deep_only"), K.slope_asymmetry().alias("slope"), K.imbalance(1).alias("top"), K.mid().alias("mid"))
    last = b.groupBy("symbol", F.to_date("ts").alias("day"), bar_index("ts", MINUTE_US).alias("i")).agg(F.max_by(F.struct("tilt", "deep", "deep_only", "slope", "top"), F.struct("ts", "seq")).alias("_s"))
    d = dense(t).select("symbol", "day", "i", "fwd1", "fwd10").join(last.select("symbol", "day", "i", "_s.*"), ["symbol", "day", "i"])
    from ..core.ordered import row_index
    from ..operators.panel import index_ts
    d = t.store("deep_book_rows", lambda d=d: row_index(d.withColumn("ts", index_ts("i", MINUTE_US)), ["symbol"], ["ts"], "k"))
    out = None
    for name, xs in (("top", ["top"]), ("joint", ["tilt", "deep_only", "slope", "top"])):
        r = I.ols_hac(d, ["symbol"], "fwd10", xs, 10, idx="k").withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


_LL = """WITH g AS (SELECT symbol, day, i // 5 AS i, ln(mid) - lag(ln(mid)) OVER (PARTITION BY symbol, day ORDER BY i) AS ret FROM v_minute WHERE i % 5 = 0 AND mid IS NOT NULL),
x AS (SELECT f.symbol, lag AS lag, corr(l.ret, f.ret) AS corr, count(*) AS n FROM (SELECT i, ret FROM g WHERE symbol = 'S0' AND ret IS NOT NULL) l JOIN (SELECT unnest(generate_series(-6, 6)) AS lag) ON true JOIN g f ON f.i = l.i + lag AND f.symbol <> 'S0' AND f.ret IS NOT NULL GROUP BY ALL)"""


@query("inr13_lead_lag", _LL + f" SELECT symbol, CAST(lag AS INTEGER) AS lag, {R('corr')} AS corr, n FROM x")
def _(t):
    return rounded(N.lead_lag(N.grid_returns(minute(t), 5), "S0", 6), "corr")


@query("inr13_peak_lag", _LL + f" SELECT symbol, CAST(arg_max(lag, corr) AS INTEGER) AS peak_lag, {R('max(corr)')} AS peak_corr, {R('max(corr) FILTER (lag = 0)')} AS corr_0, {R('max(corr) FILTER (lag > 0)')} AS best_lead, {R('max(corr) FILTER (lag < 0)')} AS best_follow FROM x GROUP BY symbol")
def _(t):
    return rounded(N.peak_lag(N.lead_lag(N.grid_returns(minute(t), 5), "S0", 6)), "peak_corr", "corr_0", "best_lead", "best_follow")


@query("inr14_leader_regression")
def _(t):
    d = dense(t)
    lead = d.where("symbol = 'S0'").select("i", c("ret").alias("lead_ret"), c("trade_ofi_tr").alias("lead_flow"))
    return I.ols_hac(d.where("symbol <> 'S0'").join(lead, "i"), ["symbol"], "fwd10", ["lead_ret", "lead_flow"], 10, min_n=100)


_C3 = "CASE WHEN notional < 1000 THEN 'retail' WHEN notional >= 10000 THEN 'institutional' ELSE 'mid' END"


@query("inr23_class_flow_r2", f"""WITH f AS (SELECT symbol, epoch_us(ts) // 3600000000 AS i, sum(CASE side WHEN 'buy' THEN notional WHEN 'sell' THEN -notional ELSE 0 END) AS ft, coalesce(sum(CASE side WHEN 'buy' THEN notional WHEN 'sell' THEN -notional ELSE 0 END) FILTER ({_C3} = 'institutional'), 0) AS fi FROM v_trades GROUP BY 1, 2),
m AS (SELECT symbol, day, i // 60 AS i, arg_max(mid, i) AS mid FROM v_minute WHERE mid IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT m.symbol, lead(ln(mid)) OVER (PARTITION BY m.symbol, day ORDER BY m.i) - ln(mid) AS nxt, ln(mid) - lag(ln(mid)) OVER (PARTITION BY m.symbol, day ORDER BY m.i) AS mom, coalesce(fi, 0) AS fi, coalesce(ft, 0) AS ft FROM m LEFT JOIN f ON f.symbol = m.symbol AND f.i = m.i),
k AS (SELECT * FROM j WHERE nxt IS NOT NULL AND mom IS NOT NULL), d AS (SELECT nxt - avg(nxt) OVER w AS y, fi - avg(fi) OVER w AS x1, mom - avg(mom) OVER w AS x2 FROM k WINDOW w AS (PARTITION BY symbol))
SELECT {R('corr(y, x1) ** 2', 8)} AS r2_inst, {R(_r2j('y', 'x1', 'x2'), 8)} AS r2_with_momentum, count(*) AS n FROM d""")
def _(t):
    d = B.class_flow_bars(t.book, t.trades, HOUR_US).select("symbol", "ret", "ret_next", c("flow_institutional").alias("fi")).dropna(subset=["ret", "ret_next"])
    d = I.demean(d, ["ret_next", "fi", "ret"], ["symbol"])
    a, _b, j = I.two_regressor_r2("ret_next_d", "fi_d", "ret_d")
    return d.agg(rnd(a, 8).alias("r2_inst"), rnd(j, 8).alias("r2_with_momentum"), F.count(F.lit(1)).alias("n"))


_HARF = VAR_SQL + f""", hf AS (SELECT symbol, hour, ts, rv, lag(rv) OVER o AS har_h, CASE WHEN count(rv) OVER d >= 24 THEN avg(rv) OVER d END AS har_d, CASE WHEN count(rv) OVER w >= 168 THEN avg(rv) OVER w END AS har_w, ln(1 + greatest(CAST(lag(tcnt) OVER o AS DOUBLE), 0e0)) AS m_tcnt, lag(spr_m) OVER o AS m_spr_m FROM har
 WINDOW o AS (PARTITION BY symbol ORDER BY hour), d AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))"""


@query("inr15_har_features", _HARF + f" SELECT symbol, ts, {R('har_h', 8)} AS har_h, {R('har_d', 8)} AS har_d, {R('har_w', 8)} AS har_w, {R('m_tcnt')} AS m_tcnt, {R('m_spr_m', 9)} AS m_spr_m FROM hf")
def _(t):
    d = N.har_features(har(t))
    return rounded(rounded(rounded(d, "har_h", "har_d", "har_w", digits=8), "m_tcnt"), "m_spr_m", digits=9).select("symbol", "ts", "har_h", "har_d", "har_w", "m_tcnt", "m_spr_m")


@query("inr15_har_r2")
def _(t):
    d = N.har_features(har(t)).dropna(subset=["har_w", "har_d", "har_h"])
    out = None
    for k, xs in (("har", ["har_h", "har_d", "har_w"]), ("har_micro", ["har_h", "har_d", "har_w", "m_tcnt", "m_spr_m", "m_absflow"])):
        r = I.ols_fit(d, ["symbol"], "rv", xs).select("symbol", F.lit(k).alias("model"), "n", "r2")
        out = r if out is None else out.unionByName(r)
    return out


@query("inr17_vol_target", _HARF + f""", q AS (SELECT symbol, quantile_cont(har_d, 1e-2) AS q FROM hf WHERE har_d IS NOT NULL GROUP BY symbol), p AS (SELECT hf.symbol, rv, greatest(har_d, q) AS p FROM hf JOIN q ON q.symbol = hf.symbol WHERE har_d IS NOT NULL),
m AS (SELECT symbol, median(p) AS m FROM p GROUP BY symbol) SELECT p.symbol, {R('stddev_pop(m / p * rv) / avg(m / p * rv)')} AS cv, {R('stddev_pop(rv) / avg(rv)')} AS cv_flat FROM p JOIN m ON m.symbol = p.symbol GROUP BY p.symbol""")
def _(t):
    return rounded(N.vol_target_cv(N.har_features(har(t)).where("har_d IS NOT NULL"), "rv", "har_d", ["symbol"]), "cv", "cv_flat")


@query("inr16_expanding_oos")
def _(t):
    from ..operators.screens import expanding_oos
    d = N.har_features(har(t)).dropna(subset=["har_w", "har_d", "har_h"])
    return expanding_oos(d, "rv", ["har_h", "har_d", "har_w"], refit=168, min_train=336)


@query("inr18_vpin_splits", f"""WITH k AS (SELECT *, CAST(ts AS DATE) AS day, sum(volume_base) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS cum, sum(volume_base) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS tot FROM v_tb),
g AS (SELECT symbol, day, least(floor(cum * 50 / tot), 49) AS bk, sum(buy) AS b, sum(sell) AS s, sum(volume_base) AS v, max(ts) AS cts FROM k GROUP BY ALL HAVING sum(volume_base) > 0),
r AS (SELECT *, count(*) OVER (PARTITION BY symbol, day) AS n, count(*) OVER f AS m, avg(abs(b - s) / v) OVER f AS vpin FROM g WINDOW f AS (PARTITION BY symbol, day ORDER BY bk ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
vp AS (SELECT symbol, date_trunc('hour', cts) AS ts, avg(vpin) AS vpin FROM r WHERE n >= 6 AND m >= 5 GROUP BY 1, 2), rp AS ({VAR_SQL} SELECT symbol, ts, rv FROM har), z AS (SELECT rp.symbol, rv, vpin, median(vpin) OVER (PARTITION BY rp.symbol) AS md FROM rp JOIN vp ON vp.symbol = rp.symbol AND vp.ts = rp.ts)
SELECT symbol, {R('avg(rv) FILTER (vpin > md)', 8)} AS rv_high, {R('avg(rv) FILTER (vpin <= md)', 8)} AS rv_low, {R('corr(rv, vpin) ** 2', 7)} AS r2, count(*) AS n FROM z GROUP BY symbol""".replace("rp AS (WITH ", "rp AS (WITH "))
def _(t):
    v = N.vpin_day(tb(t)).withColumnRenamed("hour_ts", "ts")
    d = har(t).select("symbol", "ts", "rv").join(v, ["symbol", "ts"])
    d = d.join(d.groupBy("symbol").agg(F.median("vpin").alias("md")), "symbol")
    return d.groupBy("symbol").agg(rnd(F.avg(F.when(c("vpin") > c("md"), c("rv"))), 8).alias("rv_high"), rnd(F.avg(F.when(c("vpin") <= c("md"), c("rv"))), 8).alias("rv_low"),
                                   rnd(I.safe_corr("rv", "vpin") * I.safe_corr("rv", "vpin"), 7).alias("r2"), F.count(F.lit(1)).alias("n"))


@query("inr18_decoupling_logit")
def _(t):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    v = N.vpin_day(tb(t)).withColumnRenamed("hour_ts", "ts")
    d = har(t).select("symbol", "ts", "rv", "spr_m").join(v, ["symbol", "ts"])
    d = d.join(d.groupBy("symbol").agg(F.percentile("rv", 0.9).alias("q")), "symbol").withColumn("label", (c("rv") >= c("q")).cast("double"))
    d = I.standardise(d.dropna(subset=["vpin", "spr_m"]), ["vpin", "spr_m"], ["symbol"])
    x = VectorAssembler(inputCols=["vpin_z", "spr_m_z"], outputCol="features").transform(d)
    m = LogisticRegression(regParam=0.0).fit(x)
    return t.spark.createDataFrame([(float(m.intercept), *map(float, m.coefficients))], "intercept double, b_vpin double, b_spread double")


# ---- two-leg phase-2 features ------------------------------------------------------------------------------

@query("pf7_leg_flow", f"""WITH j AS (SELECT a.symbol || '_' || b.symbol AS pair, a.ts, a.midprice - b.midprice AS spread, a.ib AS iba, a.isl AS isa, b.ib AS ibb, b.isl AS isb FROM v_bars15 a JOIN v_bars15 b ON a.ts = b.ts AND a.symbol < b.symbol)
SELECT pair, ts, {R('iba - isa', 2)} AS inst_signed_a, {R('coalesce((iba - isa) / nullif(iba + isa, 0), 0)')} AS inst_imb_a, {R('CASE WHEN spread > 0 THEN coalesce((iba - isa) / nullif(iba + isa, 0), 0) ELSE coalesce((ibb - isb) / nullif(ibb + isb, 0), 0) END')} AS over_leg_inst_imb FROM j""")
def _(t):
    from ..operators.features import leg_flow_features
    p = B.pair_bars(B.bars(t.book, t.trades, 15 * MINUTE_US), tape_pairs(t)).withColumn("spread", c("midprice_a") - c("midprice_b"))
    return leg_flow_features(p).select("pair", "ts", rnd("inst_signed_a", 2).alias("inst_signed_a"), rnd("inst_imb_a").alias("inst_imb_a"), rnd("over_leg_inst_imb").alias("over_leg_inst_imb"))


# ---- execution study -----------------------------------------------------------------------------------------

H1 = HOUR_US
_U, _B2, _ = walk_sql("ask")
_UB, _BB, _ = walk_sql("bid")


def _vwap(side_col="side"):
    u, b = f"CASE WHEN {side_col} = 'buy' THEN {_U} ELSE {_UB} END", f"CASE WHEN {side_col} = 'buy' THEN {_B2} ELSE {_BB} END"
    last = f"CASE WHEN {side_col} = 'buy' THEN ask_px_10 ELSE bid_px_10 END"
    return f"(({u}) + greatest(q - ({u}), 0e0)) / (({b}) + greatest(q - ({u}), 0e0) / ({last}))"


_EXB = f"""WITH o AS (SELECT symbol, day, t0, ts, side, notional, q, m0, sgn, post_px, queue, (ask_px_1 - bid_px_1) / m0 * 1e4 AS spread_bps, sgn * ({_vwap()} - m0) / m0 * 1e4 AS cost_agg FROM v_parents),
h AS (SELECT o.symbol, o.t0, o.notional, epoch_us(t.ts) AS u, sum(t.amount) OVER (PARTITION BY o.symbol, o.t0, o.notional ORDER BY t.ts, t.trade_id) AS cum, queue + o.notional / m0 AS need
 FROM o JOIN v_trades t ON t.symbol = o.symbol AND epoch_us(t.ts) > t0 AND epoch_us(t.ts) <= t0 + 3600000000 AND ((o.side = 'buy' AND t.side = 'sell' AND t.price <= post_px) OR (o.side = 'sell' AND t.side = 'buy' AND t.price >= post_px))),
fl AS (SELECT symbol, t0, notional, min(u) AS fu FROM h WHERE cum >= need GROUP BY ALL),
lt AS (SELECT e.symbol, e.t0, e.notional, {_vwap('e.side')} AS late FROM (SELECT symbol, t0, notional, side, q, make_timestamp(t0 + 3600000000) AS t1 FROM o) e ASOF JOIN v_book b ON e.symbol = b.symbol AND e.t1 >= b.ts),
sg AS (SELECT o.symbol, o.t0, o.notional, coalesce(sum(ofi), 0) AS book_ofi, coalesce(CAST(sum(ask_dec) - sum(bid_dec) AS DOUBLE) / nullif(sum(ask_dec) + sum(bid_dec), 0), 0e0) AS cancel_imb FROM o LEFT JOIN v_flow f ON f.symbol = o.symbol AND epoch_us(f.ts) > t0 - 3600000000 AND epoch_us(f.ts) <= t0 GROUP BY ALL),
p0 AS (SELECT o.*, fu IS NOT NULL AS filled, (fu - o.t0) / 1e6 AS fill_dt, sgn * (CASE WHEN fu IS NOT NULL THEN post_px ELSE late END - m0) / m0 * 1e4 AS cost_passive, book_ofi, cancel_imb,
 CASE WHEN side = 'buy' THEN book_ofi >= 0 AND cancel_imb >= 0 ELSE book_ofi <= 0 AND cancel_imb <= 0 END AS posted FROM o LEFT JOIN fl ON fl.symbol = o.symbol AND fl.t0 = o.t0 AND fl.notional = o.notional
 LEFT JOIN lt ON lt.symbol = o.symbol AND lt.t0 = o.t0 AND lt.notional = o.notional JOIN sg ON sg.symbol = o.symbol AND sg.t0 = o.t0 AND sg.notional = o.notional),
p AS (SELECT *, CASE WHEN posted THEN cost_passive ELSE cost_agg END AS cost_timed, CASE WHEN posted THEN cost_agg ELSE cost_passive END AS cost_flip, least(cost_passive, cost_agg) AS cost_oracle, greatest(cost_passive, cost_agg) AS cost_anti FROM p0)"""


def study(t):
    def build():
        o = t.store("orders_priced", lambda: E.immediate_cost(E.parent_orders(t.book, 2 * H1, (1e3, 2e4), 7), t.book))
        o = t.store("orders_signalled", lambda o=o: E.window_signals(o, K.flow_events(t.book), H1))
        return E.policies(E.passive_outcome(o, t.trades, t.book, H1))
    return t.store("order_study", build)


@query("ex1_parent_orders", "SELECT symbol, t0, side, notional FROM v_parents")
def _(t):
    return E.parent_orders(t.book, 2 * H1, (1e3, 2e4), 7).select("symbol", "t0", "side", "notional")


@query("ex2_immediate_cost", _EXB + f" SELECT symbol, t0, notional, {R('m0')} AS m0, {R('spread_bps')} AS spread_bps, {R('cost_agg')} AS cost_agg FROM o")
def _(t):
    return rounded(study(t).select("symbol", "t0", "notional", "m0", "spread_bps", "cost_agg"), "m0", "spread_bps", "cost_agg")


@query("ex3_passive_outcome", _EXB + f" SELECT symbol, t0, notional, filled, {R('fill_dt', 6)} AS fill_dt, {R('cost_passive')} AS cost_passive FROM p")
def _(t):
    return rounded(rounded(study(t).select("symbol", "t0", "notional", "filled", "fill_dt", "cost_passive"), "cost_passive"), "fill_dt", digits=6)


@query("bk14_window_signals", _EXB + f" SELECT symbol, t0, notional, CAST(book_ofi AS BIGINT) AS book_ofi, {R('cancel_imb')} AS cancel_imb FROM p")
def _(t):
    return study(t).select("symbol", "t0", "notional", c("book_ofi").cast("long").alias("book_ofi"), rnd("cancel_imb").alias("cancel_imb"))


@query("ex4_policies", _EXB + f" SELECT symbol, t0, notional, posted, {R('cost_timed')} AS cost_timed, {R('cost_flip')} AS cost_flip, {R('cost_oracle')} AS cost_oracle, {R('cost_anti')} AS cost_anti FROM p")
def _(t):
    return rounded(study(t).select("symbol", "t0", "notional", "posted", "cost_timed", "cost_flip", "cost_oracle", "cost_anti"), "cost_timed", "cost_flip", "cost_oracle", "cost_anti")


@query("ex5_cost_table", _EXB + f""" SELECT coalesce(symbol, 'ALL') AS symbol, coalesce(CAST(CAST(notional AS BIGINT) AS VARCHAR), 'ALL') AS notional, count(*) AS n, {R('avg(cost_agg)')} AS cost_agg, {R('avg(cost_passive)')} AS cost_passive, {R('avg(cost_timed)')} AS cost_timed,
 {R('median(cost_passive)', 5)} AS p50, {R('quantile_cont(cost_passive, 9e-1)', 5)} AS p90, {R('quantile_cont(cost_passive, 95e-2)', 5)} AS p95, {R('avg(CAST(filled AS INTEGER)) * 100', 4)} AS fill_pct, {R('avg(CAST(posted AS INTEGER)) * 100', 4)} AS post_pct FROM p GROUP BY ROLLUP (symbol, notional)""")
def _(t):
    d = E.cost_table(study(t).withColumn("notional", c("notional").cast("long")), ["symbol", "notional"])
    d = rounded(rounded(rounded(d, "cost_agg", "cost_passive", "cost_timed"), "p50", "p90", "p95", digits=5), "fill_pct", "post_pct", digits=4)
    return d.select("symbol", "notional", "n", "cost_agg", "cost_passive", "cost_timed", "p50", "p90", "p95", "fill_pct", "post_pct")


@query("ex6_signal_correlations", _EXB + f" SELECT {R('corr(book_ofi * sgn, cost_passive - cost_agg)')} AS ofi_vs_cost, {R('corr(cancel_imb * sgn, cost_passive - cost_agg)')} AS cancel_vs_cost, {R('corr(book_ofi * sgn, CAST(filled AS DOUBLE))')} AS ofi_vs_fill, count(*) AS n FROM p")
def _(t):
    return rounded(E.signal_correlations(study(t)), "ofi_vs_cost", "cancel_vs_cost", "ofi_vs_fill").select("ofi_vs_cost", "cancel_vs_cost", "ofi_vs_fill", "n")


@query("sur7_random_policy", _EXB + f""", x AS (SELECT rep, avg(CASE WHEN {U("symbol || '|' || t0 || '|' || CAST(notional AS BIGINT) || '|' || rep || '|11'")} < (SELECT avg(CAST(posted AS DOUBLE)) FROM p) THEN cost_passive ELSE cost_agg END) AS m FROM p, range(1, 201) r(rep) GROUP BY rep)
SELECT {R('avg(m)')} AS placebo_mean, {R('stddev_pop(m)')} AS placebo_sd FROM x""")
def _(t):
    return rounded(E.random_policy(study(t), 200, 11), "placebo_mean", "placebo_sd")
