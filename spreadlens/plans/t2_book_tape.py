"""Books, tape and bars (BK, TR, BAR) with the as-of join."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.ordered import DAY_US, HOUR_US, MINUTE_US
from ..operators import bars as B, book as K, tape as Q
from .base_tables import tape_pairs
from .registry import query, rnd, rnd_sql as R, rounded

c = F.col
M15 = 15 * MINUTE_US
_MID = "(bid_px_1 + ask_px_1) / 2e0"


def level_sum(side: str, lo: int, hi: int) -> str:
    return "(" + " + ".join(f"{side}_sz_{i}" for i in range(lo, hi + 1)) + ")"


def imb_sql(hi: int, lo: int = 1) -> str:
    b, a = level_sum("bid", lo, hi), level_sum("ask", lo, hi)
    return f"CAST({b} - {a} AS DOUBLE) / ({b} + {a})"


@query("bk1_mid", f"SELECT symbol, seq, {R(_MID)} AS mid FROM v_book")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.mid()).alias("mid"))


@query("bk2_microprice", f"""SELECT symbol, seq, {R('(bid_sz_1 * ask_px_1 + ask_sz_1 * bid_px_1) / (bid_sz_1 + ask_sz_1)')} AS micro_1,
 {R('(bid_sz_3 * ask_px_3 + ask_sz_3 * bid_px_3) / (bid_sz_3 + ask_sz_3)')} AS micro_3 FROM v_book""")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.microprice(1)).alias("micro_1"), rnd(K.microprice(3)).alias("micro_3"))


@query("bk3_quoted_spread", f"SELECT symbol, seq, {R(f'(ask_px_1 - bid_px_1) / ({_MID}) * 1e4')} AS spread_bps, {R(f'(ask_px_1 - bid_px_1) / ({_MID})', 9)} AS rel FROM v_book")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.quoted_spread_bps()).alias("spread_bps"), rnd(K.relative_spread(), 9).alias("rel"))


@query("bk4_imbalance", f"SELECT symbol, seq, {R(imb_sql(5))} AS obi_5 FROM v_book")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.imbalance(5)).alias("obi_5"))


@query("bk5_depth_imbalance", f"SELECT symbol, seq, {R(imb_sql(1))} AS i_top, {R(imb_sql(10))} AS i_deep, {R(imb_sql(10, 2))} AS i_deep_only FROM v_book")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.imbalance(1)).alias("i_top"), rnd(K.imbalance(10)).alias("i_deep"),
                         rnd(K.imbalance(10, 2)).alias("i_deep_only"))


def _wsum(side, expr):
    return "(" + " + ".join(expr.format(px=f"{side}_px_{i}", sz=f"{side}_sz_{i}") for i in range(1, 11)) + ")"


_FAIR = f"(({_wsum('bid', '{px} * {sz}')} + {_wsum('ask', '{px} * {sz}')}) / ({level_sum('bid', 1, 10)} + {level_sum('ask', 1, 10)}))"


@query("bk6_fair_value", f"SELECT symbol, seq, {R(_FAIR, 8)} AS fair, {R(f'({_FAIR} - {_MID}) / ({_MID})', 9)} AS tilt FROM v_book")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.depth_fair_value(), 8).alias("fair"), rnd(K.fair_value_tilt(), 9).alias("tilt"))


def _slope(side):
    size = level_sum(side, 1, 10)
    dist = _wsum(side, "{sz} * abs({px} - mid) / mid")
    return f"({size} / ({dist} / ({size} + 1e-12) + 1e-12))"


@query("bk7_book_slope", f"""SELECT symbol, seq, {R(_slope('bid'), 3)} AS slope_bid, {R(_slope('ask'), 3)} AS slope_ask,
 {R(f"({_slope('bid')} - {_slope('ask')}) / ({_slope('bid')} + {_slope('ask')} + 1e-12)")} AS slope_net FROM (SELECT *, {_MID} AS mid FROM v_book)""")
def _(t):
    return t.book.select("symbol", "seq", rnd(K.slope("bid"), 3).alias("slope_bid"), rnd(K.slope("ask"), 3).alias("slope_ask"),
                         rnd(K.slope_asymmetry()).alias("slope_net"))


@query("bk8_best_bid_ask", "SELECT symbol, ts, seq, bid_px_1, bid_sz_1, ask_px_1, ask_sz_1 FROM v_book")
def _(t):
    return K.best(t.book)


@query("bk9_valid_rows", "SELECT symbol, count(*) AS n FROM (SELECT symbol, CASE WHEN seq % 14 = 0 THEN ask_px_1 + 1 ELSE bid_px_1 END AS b, ask_px_1 AS a FROM v_book) WHERE a > b AND b > 0 GROUP BY symbol")
def _(t):
    broken = t.book.withColumn("bid_px_1", F.when(c("seq") % 14 == 0, c("ask_px_1") + 1).otherwise(c("bid_px_1")))
    return K.valid(broken).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("bk10_flow_events", "SELECT symbol, seq, CAST(ofi AS BIGINT) AS ofi FROM v_flow")
def _(t):
    return K.flow_events(t.book).select("symbol", "seq", c("ofi").cast("long").alias("ofi"))


@query("bk11_size_decrease", "SELECT symbol, seq, CAST(bid_dec AS BIGINT) AS bid_dec, CAST(ask_dec AS BIGINT) AS ask_dec FROM v_flow")
def _(t):
    return K.flow_events(t.book).select("symbol", "seq", c("bid_dec").cast("long").alias("bid_dec"), c("ask_dec").cast("long").alias("ask_dec"))


# walking the book in SQL: cumulative notional before level i decides what level i gives
def walk_sql(side: str, n: int = 10) -> tuple[str, str, str]:
    cum, base, usd, used = "0e0", [], [], []
    for i in range(1, n + 1):
        lv = f"{side}_px_{i} * {side}_sz_{i}"
        take = f"least({lv}, greatest(q - ({cum}), 0e0))"
        base.append(f"{take} / {side}_px_{i}")
        usd.append(take)
        used.append(f"CASE WHEN q - ({cum}) > 1e-9 THEN 1 ELSE 0 END")
        cum = f"{cum} + {lv}"
    return " + ".join(usd), " + ".join(base), " + ".join(used)


_WU, _WB, _WN = walk_sql("ask")
_WUB, _WBB, _WNB = walk_sql("bid")
_ORD = """WITH o AS (SELECT t.trade_id, t.symbol, t.side, t.notional * 20 AS q, b.* EXCLUDE (symbol, ts, seq)
 FROM (SELECT * FROM v_trades WHERE side <> '') t ASOF JOIN v_book b ON t.symbol = b.symbol AND t.ts >= b.ts)"""


@query("bk15_walk_book", _ORD + f""", w AS (SELECT *, CASE WHEN side = 'buy' THEN {_WU} ELSE {_WUB} END AS usd, CASE WHEN side = 'buy' THEN {_WB} ELSE {_WBB} END AS base,
  CASE WHEN side = 'buy' THEN ask_px_10 ELSE bid_px_10 END AS last, {_MID} AS mid FROM o)
SELECT trade_id, {R("greatest(CASE side WHEN 'buy' THEN 1 ELSE -1 END * ((usd + greatest(q - usd, 0e0)) / (base + greatest(q - usd, 0e0) / last) - mid) / mid * 1e4, 0e0)")} AS slippage_bps FROM w""")
def _(t):
    o = t.trades.where(c("side") != "").select("symbol", "ts", "trade_id", "side", (c("notional") * 20).alias("q"))
    d = K.book_at(o, t.book, K.book_columns(), "trade_id").where("bid_px_1 IS NOT NULL")
    return d.select("trade_id", rnd(K.slippage_bps(c("q"), c("side"))).alias("slippage_bps"))


@query("bk16_partial_fill", _ORD + f""", w AS (SELECT *, CASE WHEN side = 'buy' THEN {_WU} ELSE {_WUB} END AS usd, CASE WHEN side = 'buy' THEN {_WB} ELSE {_WBB} END AS base,
  CASE WHEN side = 'buy' THEN {_WN} ELSE {_WNB} END AS used FROM o)
SELECT trade_id, {R('usd / base')} AS vwap, {R('usd', 3)} AS filled, CAST(used AS INTEGER) AS levels_used FROM w""")
def _(t):
    o = t.trades.where(c("side") != "").select("symbol", "ts", "trade_id", "side", (c("notional") * 20).alias("q"))
    d = K.book_at(o, t.book, K.book_columns(), "trade_id").where("bid_px_1 IS NOT NULL")
    return K.fill_columns(d, c("q"), c("side")).select("trade_id", rnd("vwap").alias("vwap"), rnd("filled", 3).alias("filled"), "levels_used")


@query("bk17_book_at", "SELECT t.trade_id, b.bid_px_1, b.ask_px_1 FROM v_trades t ASOF LEFT JOIN v_book b ON t.symbol = b.symbol AND t.ts >= b.ts")
def _(t):
    d = K.book_at(t.trades.select("symbol", "ts", "trade_id"), t.book, ["bid_px_1", "ask_px_1"], "trade_id")
    return d.select("trade_id", "bid_px_1", "ask_px_1")


@query("bk21_update_share", f"""SELECT symbol, day, {R('avg(CASE WHEN mid <> p THEN 1e0 ELSE 0e0 END)')} AS update_share, count(*) AS n FROM
 (SELECT symbol, day, mid, lag(mid) OVER (PARTITION BY symbol, day ORDER BY i) AS p FROM v_minute) WHERE p IS NOT NULL AND mid IS NOT NULL GROUP BY symbol, day""")
def _(t):
    d = B.dense_mid(t.book, MINUTE_US).where("mid IS NOT NULL").select("symbol", "day", "i", "mid")
    return rounded(K.update_share(d), "update_share")


@query("bk22_book_resample", """SELECT symbol, make_timestamp((epoch_us(ts) + 3599999999) // 3600000000 * 3600000000) AS ts, arg_max(bid_px_1, ts) AS bid_px_1, arg_max(ask_px_1, ts) AS ask_px_1,
 arg_max(bid_sz_2, ts) AS bid_sz_2 FROM v_book GROUP BY ALL""")
def _(t):
    s = F.max_by(F.struct("bid_px_1", "ask_px_1", "bid_sz_2"), F.struct("ts", "seq")).alias("_s")
    return t.book.groupBy("symbol", B.right_edge("ts", HOUR_US).alias("ts")).agg(s).select("symbol", "ts", "_s.*")


@query("tr1_aggressor_sign", "SELECT trade_id, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS s FROM v_trades")
def _(t):
    return t.trades.select("trade_id", Q.aggressor_sign().alias("s"))


@query("tr2_tick_rule", "SELECT trade_id, tick_sign FROM v_tick")
def _(t):
    return Q.tick_rule(t.trades.select("symbol", "ts", "trade_id", "price")).select("trade_id", "tick_sign")


@query("tr3_quote_rule", "SELECT trade_id, CAST(quote_sign AS INTEGER) AS quote_sign FROM v_signed")
def _(t):
    return Q.quote_rule(t.trades.select("symbol", "ts", "trade_id", "price"), t.book).select("trade_id", "quote_sign")


@query("tr4_signed_trades", f"SELECT trade_id, CAST(trade_sign AS INTEGER) AS trade_sign, {R('signed_notional', 2)} AS signed_notional, bucket FROM v_signed")
def _(t):
    return Q.signed_trades(t.trades, t.book).select("trade_id", "trade_sign", rnd("signed_notional", 2).alias("signed_notional"), "bucket")


@query("tr5_size_bucket", f"SELECT symbol, bucket, count(*) AS n, {R('sum(notional)', 2)} AS notional FROM v_signed GROUP BY symbol, bucket")
def _(t):
    return t.trades.groupBy("symbol", Q.size_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("notional"), 2).alias("notional"))


_C3 = "CASE WHEN notional < 1000 THEN 'retail' WHEN notional >= 10000 THEN 'institutional' ELSE 'mid' END"


@query("tr6_size_class3", f"SELECT {_C3} AS size_class, count(*) AS n FROM v_trades GROUP BY 1")
def _(t):
    return t.trades.groupBy(Q.size_class3().alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


_T100 = "(SELECT * REPLACE (make_timestamp(epoch_us(ts) // 600000000 * 600000000) AS ts) FROM v_trades)"


def coarse_ticks(t, us=600_000_000):
    """Ticks on a coarse clock, so that several share a time stamp."""
    return t.trades.withColumn("ts", B.left_edge("ts", us))


@query("tr7_marketable_orders", f"""SELECT symbol, ts, side, {R('sum(notional)', 2)} AS notional, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n_fills,
 arg_max(price, trade_id) AS last_price FROM {_T100} WHERE side <> '' GROUP BY symbol, ts, side""")
def _(t):
    return rounded(Q.marketable_orders(coarse_ticks(t)).drop("order_id"), "notional", digits=2)


@query("tr8_sweeps", f"""WITH s AS (SELECT *, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE tick_sign END AS sign FROM v_tick),
l AS (SELECT *, lag(sign) OVER w AS ps, lag(ts) OVER w AS pt FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)),
r AS (SELECT *, sum(CASE WHEN ps IS NULL OR sign <> ps OR (epoch_us(ts) - epoch_us(pt)) // 1000 > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS run FROM l)
SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, CAST(any_value(sign) AS INTEGER) AS side, {R('sum(notional)', 2)} AS notional, count(*) AS n_trades, count(DISTINCT price) AS levels_walked_est
FROM r GROUP BY symbol, run HAVING count(*) >= 2 AND count(DISTINCT price) >= 2""")
def _(t):
    return rounded(Q.sweeps(t.trades, 3_600_000), "notional", digits=2)


@query("tr9_size_distribution", f"""SELECT symbol, {R('quantile_cont(notional, 5e-1)', 1)} AS p50, {R('quantile_cont(notional, 9e-1)', 1)} AS p90, {R('quantile_cont(notional, 99e-2)', 1)} AS p99, {R('quantile_cont(notional, 999e-3)', 1)} AS p999,
 {R('sum(CASE WHEN notional >= 1e3 THEN notional ELSE 0 END) / sum(notional)')} AS share_ge_1000, {R('sum(CASE WHEN notional >= 1e4 THEN notional ELSE 0 END) / sum(notional)')} AS share_ge_10000,
 {R('sum(CASE WHEN notional >= 1e5 THEN notional ELSE 0 END) / sum(notional)')} AS share_ge_100000 FROM v_trades GROUP BY symbol""")
def _(t):
    d = rounded(Q.size_distribution(t.trades), "p50", "p90", "p99", "p999", digits=1)
    return rounded(d, "share_ge_1000", "share_ge_10000", "share_ge_100000")


@query("tr10_class_shares", f"""SELECT symbol, size_class, n, {R('n * 1e0 / sum(n) OVER (PARTITION BY symbol)')} AS count_share, {R('usd / sum(usd) OVER (PARTITION BY symbol)')} AS volume_share
 FROM (SELECT symbol, {_C3} AS size_class, count(*) AS n, sum(notional) AS usd FROM v_trades GROUP BY ALL)""")
def _(t):
    return rounded(Q.class_shares(t.trades), "count_share", "volume_share")


@query("bar1_trade_bars", f"""SELECT symbol, make_timestamp((epoch_us(ts) + 899999999) // 900000000 * 900000000) AS ts, count(*) AS trade_count, CAST(sum(amount) AS DOUBLE) AS volume_base,
 {R('sum(notional)', 2)} AS volume_quote, CAST(coalesce(sum(amount) FILTER (side = 'buy'), 0) AS DOUBLE) AS buy_volume_base, CAST(coalesce(sum(amount) FILTER (side = 'sell'), 0) AS DOUBLE) AS sell_volume_base,
 CAST(coalesce(sum(amount) FILTER (side = 'buy'), 0) - coalesce(sum(amount) FILTER (side = 'sell'), 0) AS DOUBLE) AS signed_volume_base, {R('sum(notional) / sum(amount)')} AS vwap
 FROM v_trades GROUP BY 1, 2""")
def _(t):
    return rounded(rounded(B.trade_bars(t.trades, M15), "volume_quote", digits=2), "vwap")


@query("bar2_book_bars", f"""SELECT symbol, make_timestamp((epoch_us(ts) + 899999999) // 900000000 * 900000000) AS ts, {R('arg_max((bid_sz_1 * ask_px_1 + ask_sz_1 * bid_px_1) / (bid_sz_1 + ask_sz_1), ts)')} AS microprice,
 {R(f'arg_max({_MID}, ts)')} AS midprice, {R(f'arg_max((ask_px_1 - bid_px_1) / ({_MID}) * 1e4, ts)')} AS quoted_spread_bps, {R(f'arg_max({imb_sql(5)}, ts)')} AS obi_5 FROM v_book GROUP BY 1, 2""")
def _(t):
    return rounded(B.book_bars(t.book, M15), "microprice", "midprice", "quoted_spread_bps", "obi_5")


_FLOWSEL = ", ".join(f"{R(a, 2)} AS {b}" for a, b in [
    ("trade_notional", "trade_notional"), ("buy_notional", "buy_notional"), ("sell_notional", "sell_notional"),
    ("signed_notional", "signed_notional"), ("s_ret", "signed_notional_retail"), ("s_mid", "signed_notional_mid"),
    ("s_lar", "signed_notional_large"), ("s_inst", "signed_notional_institutional"), ("ib", "inst_buy_notional"),
    ("isl", "inst_sell_notional"), ("rb", "retail_buy_notional"), ("rs", "retail_sell_notional")])
_FLOW_ROUND = [f for f in B.FLOW if f != "trade_count"]


@query("bar3_flow_bars", f"SELECT symbol, ts, CAST(trade_count AS BIGINT) AS trade_count, {_FLOWSEL} FROM v_bars15 WHERE trade_count > 0")
def _(t):
    b = K.book_at  # noqa: F841
    f = B.flow_bars(Q.signed_trades(t.trades, t.book), M15)
    first = t.book.groupBy("symbol").agg(F.min(B.right_edge("ts", M15)).alias("_b0"))
    return rounded(f.join(first, "symbol").where(c("ts") >= c("_b0")).drop("_b0"), *_FLOW_ROUND, digits=2)


@query("bar4_bars", f"SELECT symbol, ts, CAST(trade_count AS DOUBLE) AS trade_count, {_FLOWSEL}, {R('microprice')} AS microprice, {R('midprice')} AS midprice, {R('spread_bps')} AS quoted_spread_bps, {R('obi')} AS obi_5 FROM v_bars15")
def _(t):
    d = rounded(B.bars(t.book, t.trades, M15), *_FLOW_ROUND, digits=2)
    return rounded(d, "microprice", "midprice", "quoted_spread_bps", "obi_5")


@query("bar5_pair_bars", f"""SELECT a.symbol || '_' || b.symbol AS pair, a.ts, {R('a.midprice')} AS mid_a, {R('b.midprice')} AS mid_b, {R('a.signed_notional', 2)} AS flow_a, {R('b.signed_notional', 2)} AS flow_b
FROM v_bars15 a JOIN v_bars15 b ON a.ts = b.ts AND a.symbol < b.symbol""")
def _(t):
    d = B.pair_bars(B.bars(t.book, t.trades, M15), tape_pairs(t))
    return d.select("pair", "ts", rnd("midprice_a").alias("mid_a"), rnd("midprice_b").alias("mid_b"),
                    rnd("signed_notional_a", 2).alias("flow_a"), rnd("signed_notional_b", 2).alias("flow_b"))


@query("bar6_dense_mid", f"SELECT symbol, ts, {R('mid')} AS mid FROM v_minute")
def _(t):
    return rounded(B.dense_mid(t.book, MINUTE_US).select("symbol", "ts", "mid"), "mid")


@query("bar7_hourly_mid_flow", f"""SELECT m.symbol, m.ts, {R('mid')} AS mid, signed_volume, volume, trade_count FROM
 (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max({_MID}, ts) AS mid FROM v_book GROUP BY 1, 2) m JOIN
 (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(sum(CASE side WHEN 'buy' THEN amount WHEN 'sell' THEN -amount ELSE 0 END) AS BIGINT) AS signed_volume, CAST(sum(amount) AS BIGINT) AS volume, count(*) AS trade_count FROM v_trades GROUP BY 1, 2) f
 ON m.symbol = f.symbol AND m.ts = f.ts""")
def _(t):
    return rounded(B.hourly_mid_flow(t.book, t.trades), "mid")


@query("bar8_class_flow", f"""WITH f AS (SELECT symbol, epoch_us(ts) // 900000000 AS i, sum(notional) AS v, sum(CASE side WHEN 'buy' THEN notional WHEN 'sell' THEN -notional ELSE 0 END) AS ft,
  {', '.join(f"coalesce(sum(CASE side WHEN 'buy' THEN notional WHEN 'sell' THEN -notional ELSE 0 END) FILTER ({_C3} = '{k}'), 0) AS f_{k}" for k in ('retail', 'mid', 'institutional'))} FROM v_trades GROUP BY 1, 2),
m AS (SELECT symbol, day, i // 15 AS i, arg_max(mid, i) AS mid FROM v_minute GROUP BY ALL HAVING arg_max(mid, i) IS NOT NULL),
j AS (SELECT m.*, ln(mid) - lag(ln(mid)) OVER w AS ret, lead(ln(mid)) OVER w - ln(mid) AS ret_next FROM m WINDOW w AS (PARTITION BY symbol, day ORDER BY i))
SELECT j.symbol, make_timestamp(j.i * 900000000) AS ts, {R('mid')} AS mid, {R('ret', 8)} AS ret, {R('ret_next', 8)} AS ret_next, {R('coalesce(ft, 0)', 2)} AS flow_total,
 {R('f_retail / v')} AS share_retail, {R('f_mid / v')} AS share_mid, {R('f_institutional / v')} AS share_institutional
FROM j LEFT JOIN f ON f.symbol = j.symbol AND f.i = j.i""")
def _(t):
    d = B.class_flow_bars(t.book, t.trades, M15)
    d = rounded(rounded(d, "ret", "ret_next", digits=8), "flow_total", digits=2)
    return rounded(d, "mid", "share_retail", "share_mid", "share_institutional").select(
        "symbol", "ts", "mid", "ret", "ret_next", "flow_total", "share_retail", "share_mid", "share_institutional")


VAR_SQL = """WITH r AS (SELECT *, ln(mid) - lag(ln(mid)) OVER w AS r1, CASE WHEN i % 5 = 4 THEN ln(mid) - lag(ln(mid), 5) OVER w END AS r5,
  CASE WHEN abs(mid - lag(mid) OVER w) > 0 THEN 1e0 WHEN lag(mid) OVER w IS NOT NULL THEN 0e0 END AS chg FROM v_minute WINDOW w AS (PARTITION BY symbol, day ORDER BY i)),
r2 AS (SELECT *, abs(r1) * abs(lag(r1) OVER (PARTITION BY symbol, day ORDER BY i)) AS bp FROM r),
g AS (SELECT symbol, i // 60 AS hour, coalesce(sum(r1 * r1), 0e0) AS rv1_var, coalesce(sum(r5 * r5), 0e0) AS rv5_var, coalesce(sum(bp), 0e0) * pi() / 2 AS bpv, coalesce(sum(chg), 0e0) AS qupd,
  avg(spr) AS spr_m, stddev_samp(spr) AS spr_s, avg(imb) AS imb_m, stddev_samp(imb) AS imb_s FROM r2 GROUP BY 1, 2),
f AS (SELECT symbol, epoch_us(ts) // 3600000000 AS hour, count(*) AS tcnt, CAST(sum(amount) AS BIGINT) AS tvol, coalesce(sum(amount) FILTER (side = 'buy'), 0) AS b, coalesce(sum(amount) FILTER (side = 'sell'), 0) AS s FROM v_trades GROUP BY 1, 2),
har AS (SELECT g.*, make_timestamp(g.hour * 3600000000) AS ts, coalesce(tcnt, 0) AS tcnt, coalesce(tvol, 0) AS tvol, coalesce(abs(b - s), 0) AS absflow, CAST(abs(b - s) AS DOUBLE) / nullif(b + s, 0) AS toxicity,
  greatest(rv1_var - bpv, 0e0) AS jump, sqrt(rv1_var) AS rv FROM g LEFT JOIN f ON f.symbol = g.symbol AND f.hour = g.hour)"""


@query("bar9_realised_measures", VAR_SQL + f""" SELECT symbol, ts, {R('rv1_var', 10)} AS rv1_var, {R('rv5_var', 10)} AS rv5_var, {R('bpv', 10)} AS bpv, {R('jump', 10)} AS jump, qupd, {R('spr_m', 9)} AS spr_m, {R('spr_s', 9)} AS spr_s,
 {R('imb_m')} AS imb_m, {R('imb_s')} AS imb_s, tcnt, tvol, CAST(absflow AS BIGINT) AS absflow, {R('toxicity')} AS toxicity FROM har""")
def _(t):
    d = rounded(B.realised_measures(t.book, t.trades), "rv1_var", "rv5_var", "bpv", "jump", digits=10)
    d = rounded(rounded(d, "spr_m", "spr_s", digits=9), "imb_m", "imb_s", "toxicity")
    return d.drop("hour", "rv")


PRICE_FEATS = """WITH m AS (SELECT symbol, epoch_us(ts) // 3600000000 AS hour, epoch_us(ts) // 60000000 AS minute, arg_min(price, trade_id) AS p0, arg_max(price, trade_id) AS p1, count(*) AS n, sum(amount) AS v,
 sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS s FROM v_trades WHERE side <> '' GROUP BY ALL),
r AS (SELECT *, ln(p1) - lag(ln(p1)) OVER (PARTITION BY symbol, hour ORDER BY minute) AS r FROM m),
pf AS (SELECT symbol, hour, sqrt(sum(r * r)) AS rv, ln(arg_max(p1, minute)) - ln(arg_min(p0, minute)) AS ret, CAST(sum(n) AS BIGINT) AS trade_count, CAST(sum(s) AS DOUBLE) / sum(v) AS ofi_norm FROM r GROUP BY 1, 2),
sp AS (SELECT symbol, epoch_us(ts) // 3600000000 AS hour, avg((ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2e0)) AS rel_spread FROM v_book GROUP BY 1, 2)"""


@query("bar10_hourly_price_features", PRICE_FEATS + f""" SELECT pf.symbol, pf.hour, {R('rv', 9)} AS rv, {R('ret', 9)} AS ret, trade_count, {R('ofi_norm')} AS ofi_norm, {R('rel_spread', 9)} AS rel_spread
 FROM pf LEFT JOIN sp ON sp.symbol = pf.symbol AND sp.hour = pf.hour""")
def _(t):
    d = rounded(B.hourly_price_features(t.book, t.trades), "rv", "ret", "rel_spread", digits=9)
    return rounded(d, "ofi_norm")


MIN_SPREAD = """WITH sm AS (SELECT a.symbol || '_' || b.symbol AS pair, a.i, a.ts, ln(a.mid) - p.beta * ln(b.mid) AS sp FROM v_legs p JOIN v_minute a ON a.symbol = p.sym_a JOIN v_minute b ON b.symbol = p.sym_b AND a.i = b.i WHERE a.mid IS NOT NULL AND b.mid IS NOT NULL)"""


def minute_spread(t):
    """Minute spread of every pair with its hedge, on the dense day grid."""
    d = B.dense_mid(t.book, MINUTE_US).where("mid IS NOT NULL").select("symbol", "i", "ts", F.log("mid").alias("lm"))
    d = B.pair_legs(d, tape_pairs(t), "i", ["ts"])
    return d.select("pair", "i", "ts", (c("lm_a") - c("beta") * c("lm_b")).alias("spread"))


@query("bar11_spread_targets", MIN_SPREAD + f""", d AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 OR true THEN sp - lag(sp) OVER w END AS d FROM sm WINDOW w AS (PARTITION BY pair ORDER BY i))
SELECT pair, date_trunc('hour', ts) AS hour_ts, {R('stddev_samp(d) * 1e4')} AS spread_vol_bps, {R('(arg_max(sp, i) - arg_min(sp, i)) * 1e4')} AS move_bps, count(d) AS n, {R('abs((arg_max(sp, i) - arg_min(sp, i)) * 1e4)')} AS abs_move_bps
FROM d GROUP BY pair, date_trunc('hour', ts) HAVING count(d) >= 30""")
def _(t):
    return rounded(B.hourly_spread_targets(minute_spread(t), 30), "spread_vol_bps", "move_bps", "abs_move_bps")


@query("jn3_full_outer", "SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, a.close AS c1, b.close AS c2 FROM (SELECT * FROM v_bars_1h WHERE ts < TIMESTAMP '2024-01-20') a FULL JOIN (SELECT * FROM v_bars_1h WHERE ts >= TIMESTAMP '2024-01-10') b ON a.symbol = b.symbol AND a.ts = b.ts")
def _(t):
    d = t.bars_1h.select("symbol", "ts", "close")
    a = d.where(c("ts") < F.lit("2024-01-20").cast("timestamp")).withColumnRenamed("close", "c1")
    b = d.where(c("ts") >= F.lit("2024-01-10").cast("timestamp")).withColumnRenamed("close", "c2")
    return a.join(b, ["symbol", "ts"], "full_outer")


@query("jn4_asof", "SELECT t.trade_id, b.seq FROM v_trades t ASOF LEFT JOIN v_book b ON t.symbol = b.symbol AND t.ts >= b.ts")
def _(t):
    d = K.asof_backward(t.trades.select("symbol", "ts", "trade_id"), t.book.withColumn("bseq", c("seq")), ["symbol"], ["bseq"], "ts", "trade_id", "seq")
    return d.select("trade_id", c("bseq").alias("seq"))


@query("bar1_trade_bars_1m", "SELECT symbol, make_timestamp((epoch_us(ts) + 59999999) // 60000000 * 60000000) AS ts, count(*) AS trade_count, CAST(sum(amount) AS DOUBLE) AS volume_base FROM v_trades GROUP BY 1, 2")
def _(t):
    return B.trade_bars(t.trades, MINUTE_US).select("symbol", "ts", "trade_count", "volume_base")
