"""Pair screens, expressions, generic aggregates, features, samples, signals and P&L (ST, EXP, AGG, WIN, PF, BT)."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..core.ordered import DAY_US, HOUR_US, block_window, core_rows, halo_blocks
from ..operators import backtest as T, bars as B, features as X, inference as I, pairs as P, panel as N
from .base_tables import daily_panel, pair_legs, selected_pairs, spreads, tape_pairs
from .registry import query, rnd, rnd_sql as R, rounded
from .t1_sources import win_sql, windows

c = F.col
FCFG = X.FeatureConfig(z_window=60, min_rows=200)
SCFG = X.SampleConfig(window=32, label_cutoff="1998-01-01")


def features(t):
    return X.pair_features(spreads(t), FCFG, X.market_return(daily_panel(t), "P0"))


def ready(t):
    """The feature store: complete rows of pairs with enough of them."""
    return t.store("features", lambda: X.finish_features(features(t), FCFG.min_rows))


def preds(t):
    d = X.spread_features(spreads(t), FCFG).where("spread_z IS NOT NULL")
    return d.select("pair", "sym_a", "sym_b", "ts", "i", "close_a", "close_b", "la", "lb", "beta",
                    c("spread").alias("current_spread"), c("spread_z").alias("latest_spread_z"),
                    (F.floor(c("i") / 7) % 3).cast("int").alias("pred_class"))


def signals(t):
    return preds(t).withColumn("signal", T.class_signal())


def pnl(t):
    return T.pair_pnl(signals(t), T.Costs())


def zscored(t):
    return X.spread_features(spreads(t), FCFG).withColumnRenamed("spread_z", "z")


def unit(t, stop=4.0):
    return T.unit_pnl(T.hysteresis(zscored(t), "z", ["pair"], stop=stop), 15.0)


def portfolio(t):
    return unit(t).groupBy("ts", "i").agg(F.avg("net").alias("pnl"), F.avg("gross").alias("gross"))


# ---- screens -------------------------------------------------------------------------------------

@query("st1_return_correlation", f"SELECT pair, {R('corr')} AS corr FROM v_pair_fit WHERE corr >= 2e-1")
def _(t):
    return P.pair_fit(P.pair_moments(daily_panel(t))).where("corr >= 0.2").select("pair", rnd("corr").alias("corr"))


@query("st2_ols_hedge", f"SELECT pair, {R('alpha')} AS alpha, {R('beta')} AS beta FROM v_pair_fit")
def _(t):
    return P.pair_fit(P.pair_moments(daily_panel(t))).select("pair", rnd("alpha").alias("alpha"), rnd("beta").alias("beta"))


@query("st3_residual_std", f"SELECT pair, {R('spread_vol')} AS spread_vol FROM v_pair_fit WHERE spread_vol >= 2e-3")
def _(t):
    return P.pair_fit(P.pair_moments(daily_panel(t))).where("spread_vol >= 0.002").select("pair", rnd("spread_vol").alias("spread_vol"))


_AR = """WITH s AS (SELECT r.pair, r.i, r.la - (p.alpha + p.beta * r.lb) AS x FROM v_pair_rows r JOIN v_pair_fit p ON p.pair = r.pair),
l AS (SELECT pair, x, lag(x) OVER (PARTITION BY pair ORDER BY i) AS p FROM s),
ar AS (SELECT pair, regr_slope(x - p, p) AS b, sqrt(greatest(regr_syy(x - p, p) - regr_sxy(x - p, p) * regr_sxy(x - p, p) / regr_sxx(x - p, p), 0e0) / regr_count(x - p, p)) AS rsd FROM l WHERE p IS NOT NULL GROUP BY pair)"""


@query("st4_half_life_ar", _AR + f" SELECT pair, {R('b', 8)} AS b, {R('CASE WHEN b < 0 THEN -ln(2e0) / b END', 3)} AS half_life FROM ar")
def _(t):
    f = P.pair_fit(P.pair_moments(daily_panel(t)))
    return f.select("pair", rnd("ar_b", 8).alias("b"), rnd(P.half_life_ar(c("ar_b")), 3).alias("half_life"))


@query("st5_half_life_ou", _AR + f" SELECT pair, {R('-ln(2e0) / ln(1 + b)', 3)} AS half_life, {R('rsd', 8)} AS resid_sd FROM ar WHERE b > -1 AND b < 0")
def _(t):
    f = P.pair_fit(P.pair_moments(daily_panel(t))).where("ar_b > -1 AND ar_b < 0 AND n >= 100")
    return f.select("pair", rnd(P.half_life_ou(c("ar_b")), 3).alias("half_life"), rnd("ar_resid_sd", 8).alias("resid_sd"))


@query("st6_ou_kappa", _AR + f" SELECT pair, {R('CASE WHEN 1 + b >= 1 THEN 0e0 WHEN 1 + b <= 0 THEN 5e0 ELSE -ln(1 + b) END', 8)} AS kappa FROM ar")
def _(t):
    return P.pair_fit(P.pair_moments(daily_panel(t))).select("pair", rnd(P.ou_kappa(c("phi")), 8).alias("kappa"))


_SEG = """WITH g AS (SELECT r.pair, r.la, r.lb, row_number() OVER (PARTITION BY r.pair ORDER BY r.i) - 1 AS k, count(*) OVER (PARTITION BY r.pair) AS n FROM v_pair_rows r JOIN v_pairs p ON p.pair = r.pair),
b AS (SELECT pair, ((k + 1) * 4 - 1) // n AS seg, regr_slope(la, lb) AS b FROM g GROUP BY ALL),
inst AS (SELECT pair, count(*) AS n_seg, stddev_samp(b) / (abs(avg(b)) + 1e-9) AS beta_instability FROM b GROUP BY pair)"""


@query("st7_beta_stability", _SEG + f" SELECT pair, n_seg, {R('beta_instability')} AS beta_instability FROM inst")
def _(t):
    return rounded(P.beta_segments(pair_legs(t), 4), "beta_instability")


_SCORE = _SEG + """, s AS (SELECT pair, i, spread AS x FROM v_spread), l AS (SELECT pair, x, lag(x) OVER (PARTITION BY pair ORDER BY i) AS p FROM s),
ar AS (SELECT pair, regr_slope(x - p, p) AS b FROM l WHERE p IS NOT NULL GROUP BY pair),
m AS (SELECT f.pair, f.corr, f.spread_vol, -inst.beta_instability AS stab, -abs(ln(-ln(2e0) / ar.b / 48e0)) AS hl FROM v_pairs f JOIN inst ON inst.pair = f.pair JOIN ar ON ar.pair = f.pair WHERE ar.b < 0)"""


def _zs(x):
    return f"(CASE WHEN stddev_pop({x}) OVER () > 1e-12 THEN ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () ELSE 0e0 END)"


@query("st9_composite_score", _SCORE + f" SELECT pair, {R('25e-2 * ' + _zs('hl') + ' + 20e-2 * ' + _zs('spread_vol') + ' + 10e-2 * ' + _zs('stab') + ' + 5e-2 * ' + _zs('corr'))} AS score FROM m")
def _(t):
    panel = daily_panel(t)
    fit = P.score_candidates(P.pair_moments(panel), 0.2)
    inst = P.beta_segments(P.pair_legs(panel, fit.select("pair", "sym_a", "sym_b"), ["lp"]), 4)
    d = fit.join(inst, "pair").withColumn("hl", P.half_life_ar(c("ar_b"))).where("hl IS NOT NULL")
    parts = {"hl": (0.25, -F.abs(F.log(c("hl") / 48.0))), "vol": (0.20, c("spread_vol")),
             "stab": (0.10, -c("beta_instability")), "corr": (0.05, c("corr"))}
    return P.composite_score(d, parts).select("pair", rnd("score").alias("score"))


@query("st10_rank_by_correlation", f"""SELECT pair, sym_a, sym_b, {R('corr')} AS corr, {R('alpha')} AS alpha, {R('beta')} AS beta_a_on_b, CAST(NULL AS DOUBLE) AS beta_instability, {R('spread_vol')} AS spread_vol,
 CAST(NULL AS DOUBLE) AS adf_stat, CAST(NULL AS DOUBLE) AS adf_pvalue, CAST(NULL AS DOUBLE) AS half_life_hours, {R('corr')} AS score, 'correlation_fallback' AS selection_method
 FROM (SELECT * FROM v_pair_fit WHERE corr >= 2e-1 ORDER BY corr DESC, pair LIMIT 20)""")
def _(t):
    return rounded(P.rank_by_correlation(daily_panel(t), 20, 0.2), "corr", "alpha", "beta_a_on_b", "spread_vol", "score")


@query("st13_out_of_sample_residual", f"""WITH f AS (SELECT r.pair, regr_intercept(r.la, r.lb) AS a, regr_slope(r.la, r.lb) AS b FROM v_pair_rows r JOIN v_pairs p ON p.pair = r.pair WHERE r.ts < TIMESTAMP '2000-01-01' GROUP BY r.pair)
SELECT r.pair, r.ts, {R('r.la - (f.a + f.b * r.lb)')} AS resid FROM v_pair_rows r JOIN f ON f.pair = r.pair WHERE r.ts >= TIMESTAMP '2000-01-01'""")
def _(t):
    legs = pair_legs(t).drop("alpha", "beta")
    cut = F.lit("2000-01-01").cast("timestamp")
    fit = legs.where(c("ts") < cut).groupBy("pair").agg(F.regr_intercept("lp_a", "lp_b").alias("alpha"), F.regr_slope("lp_a", "lp_b").alias("beta"))
    return P.static_spread(legs.where(c("ts") >= cut).join(fit, "pair")).select("pair", "ts", rnd("spread").alias("resid"))


@query("st14_variance_ratio", f"""SELECT pair, {R('var_samp(d24) / (24 * var_samp(d1))')} AS vr FROM (SELECT pair, spread - lag(spread) OVER w AS d1, spread - lag(spread, 24) OVER w AS d24 FROM v_spread WINDOW w AS (PARTITION BY pair ORDER BY i)) GROUP BY pair""")
def _(t):
    return rounded(P.variance_ratio(spreads(t), ["pair"], "spread", 24), "vr")


@query("st21_wilson_interval", f"""WITH k AS (SELECT sym_a, count(*) FILTER (corr >= 74e-2) AS k, count(*) AS n FROM v_pair_fit GROUP BY sym_a)
SELECT sym_a, k, n, {R('(k * 1e0 / n + 38416e-4 / (2 * n)) / (1 + 38416e-4 / n) - 196e-2 * sqrt((k * 1e0 / n) * (1 - k * 1e0 / n) / n + 38416e-4 / (4e0 * n * n)) / (1 + 38416e-4 / n)')} AS lo,
 {R('(k * 1e0 / n + 38416e-4 / (2 * n)) / (1 + 38416e-4 / n) + 196e-2 * sqrt((k * 1e0 / n) * (1 - k * 1e0 / n) / n + 38416e-4 / (4e0 * n * n)) / (1 + 38416e-4 / n)')} AS hi FROM k""")
def _(t):
    g = P.pair_fit(P.pair_moments(daily_panel(t))).groupBy("sym_a").agg(F.count_if(c("corr") >= 0.74).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = P.wilson(c("k"), c("n"))
    return g.select("sym_a", "k", "n", rnd(lo).alias("lo"), rnd(hi).alias("hi"))


# ---- expressions ------------------------------------------------------------------------------------

@query("exp1_log_returns", f"SELECT symbol, ts, {R('lp - lag(lp, 1) OVER w')} AS r1, {R('lp - lag(lp, 5) OVER w')} AS r5 FROM v_panel WINDOW w AS (PARTITION BY symbol ORDER BY i)")
def _(t):
    h = halo_blocks(daily_panel(t), "i", back=5)
    w = block_window(["symbol"], "i")
    return core_rows(h.withColumns({"r1": rnd(c("lp") - F.lag("lp", 1).over(w)), "r5": rnd(c("lp") - F.lag("lp", 5).over(w))})).select("symbol", "ts", "r1", "r5")


@query("exp2_simple_returns", f"SELECT symbol, ts, {R('coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1, 0e0)')} AS r FROM v_panel")
def _(t):
    h = halo_blocks(daily_panel(t), "i", back=1)
    w = block_window(["symbol"], "i")
    return core_rows(h.withColumn("r", rnd(F.coalesce(c("close") / F.lag("close").over(w) - 1, F.lit(0.0))))).select("symbol", "ts", "r")


@query("exp3_scalar_math", f"""SELECT trade_id, CAST(sign(price - 1002e-1) AS DOUBLE) AS s, {R('abs(price - 1002e-1)')} AS a, {R('sqrt(notional)')} AS q, {R('greatest(least(notional, 1e5), 1e3)')} AS cl,
 {R('ln(1 + amount)')} AS l, {R('exp(amount / 1e3)')} AS e FROM v_trades""")
def _(t):
    return t.trades.select("trade_id", F.signum(c("price") - 100.2).alias("s"), rnd(F.abs(c("price") - 100.2)).alias("a"), rnd(F.sqrt("notional")).alias("q"),
                           rnd(F.greatest(F.least(c("notional"), F.lit(1e5)), F.lit(1e3))).alias("cl"), rnd(F.log1p("amount")).alias("l"), rnd(F.exp(c("amount") / 1e3)).alias("e"))


@query("exp4_safe_divide", f"SELECT trade_id, {R('notional / nullif(amount % 3, 0)')} AS q FROM v_trades")
def _(t):
    return t.trades.select("trade_id", rnd(F.try_divide(c("notional"), (c("amount") % 3).cast("double"))).alias("q"))


@query("exp5_time_units", """SELECT trade_id, date_trunc('minute', ts) AS m, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, make_timestamp((epoch_us(ts) + 3599999999) // 3600000000 * 3600000000) AS ceil_hour FROM v_trades""")
def _(t):
    from ..operators.bars import right_edge
    return t.trades.select("trade_id", F.date_trunc("minute", "ts").alias("m"), F.unix_micros("ts").alias("us"), F.unix_millis("ts").alias("ms"), right_edge("ts", HOUR_US).alias("ceil_hour"))


@query("exp6_strings", """SELECT DISTINCT lower(symbol) || '_' || upper(side) AS k, replace(symbol, 'S', 'SYM') AS renamed, symbol LIKE '%5' AS five FROM v_trades""")
def _(t):
    return t.trades.select(F.concat_ws("_", F.lower("symbol"), F.upper("side")).alias("k"), F.replace("symbol", F.lit("S"), F.lit("SYM")).alias("renamed"), F.endswith("symbol", F.lit("5")).alias("five")).distinct()


@query("exp7_case_labels", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'CALM' WHEN ts < TIMESTAMP '2024-01-21' THEN 'CRASH' ELSE 'AFTER' END AS regime, count(*) AS n FROM v_trades GROUP BY 1")
def _(t):
    ts = lambda s: F.lit(s).cast("timestamp")
    return t.trades.groupBy(F.when(c("ts") < ts("2024-01-11"), "CALM").when(c("ts") < ts("2024-01-21"), "CRASH").otherwise("AFTER").alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("exp8_bps_annualise", f"SELECT symbol, {R('avg(r) * 1e4', 4)} AS mean_bps, {R('stddev_samp(r) * sqrt(365e0)')} AS ann_vol FROM (SELECT symbol, lp - lag(lp) OVER (PARTITION BY symbol ORDER BY i) AS r FROM v_panel) GROUP BY symbol")
def _(t):
    h = halo_blocks(daily_panel(t), "i", back=1)
    d = core_rows(h.withColumn("r", c("lp") - F.lag("lp").over(block_window(["symbol"], "i"))))
    return d.groupBy("symbol").agg(rnd(F.avg("r") * 1e4, 4).alias("mean_bps"), rnd(F.stddev_samp("r") * F.sqrt(F.lit(365.0))).alias("ann_vol"))


@query("exp9_winsorise", f"SELECT trade_id, {R('least(notional, (SELECT quantile_cont(notional, 99e-2) FROM v_trades))', 3)} AS n FROM v_trades")
def _(t):
    return I.winsorise(t.trades, ["notional"], upper=0.99).select("trade_id", rnd("notional", 3).alias("n"))


@query("exp10_zscore", f"SELECT trade_id, {R('(notional - avg(notional) OVER w) / stddev_pop(notional) OVER w')} AS z FROM v_trades WINDOW w AS (PARTITION BY symbol)")
def _(t):
    return I.standardise(t.trades, ["notional"], ["symbol"]).select("trade_id", rnd("notional_z").alias("z"))


@query("exp11_demean", f"SELECT trade_id, {R('notional - avg(notional) OVER (PARTITION BY symbol)', 4)} AS d FROM v_trades")
def _(t):
    return I.demean(t.trades, ["notional"], ["symbol"]).select("trade_id", rnd("notional_d", 4).alias("d"))


@query("exp12_average_rank", f"SELECT trade_id, (rank() OVER (PARTITION BY symbol ORDER BY px_c) + (count(*) OVER (PARTITION BY symbol, px_c) - 1) / 2e0) AS r, (rank() OVER (ORDER BY px_c) + (count(*) OVER (PARTITION BY px_c) - 1) / 2e0) AS g FROM v_trades")
def _(t):
    d = t.trades.select("trade_id", "symbol", "px_c")
    d = I.tie_ranks(I.tie_ranks(d, "px_c", "r", ["symbol"]), "px_c", "g")
    return d.select("trade_id", c("r").cast("double").alias("r"), c("g").cast("double").alias("g"))


@query("exp14_predicates", "SELECT trade_id FROM v_trades WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' AND abs(price - 100) > 15e-2 AND symbol IN ('S1', 'S2') AND side IS NOT NULL AND symbol IN (SELECT symbol FROM v_book)")
def _(t):
    return (t.trades.where(c("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"))
                           & (F.abs(c("price") - 100) > 0.15) & c("symbol").isin("S1", "S2") & c("side").isNotNull())
            .join(t.book.select("symbol").distinct(), "symbol", "left_semi").select("trade_id"))


@query("exp15_arrays", f"SELECT seq, {R('(bid_sz_1 + bid_sz_2 + bid_sz_3)', 2)} AS top3, {R('bid_px_2 - ask_px_2', 4)} AS gap2 FROM v_book")
def _(t):
    sz = F.array(*[c(f"bid_sz_{k}").cast("double") for k in range(1, 11)])
    gap = F.zip_with(F.array(*[c(f"bid_px_{k}") for k in range(1, 4)]), F.array(*[c(f"ask_px_{k}") for k in range(1, 4)]), lambda a, b: a - b)
    return t.book.select("seq", rnd(F.aggregate(F.slice(sz, 1, 3), F.lit(0.0), lambda a, x: a + x), 2).alias("top3"), rnd(gap[1], 4).alias("gap2"))


@query("exp16_suffix_self_join", "SELECT a.symbol || '_' || b.symbol AS pair, a.ts, a.close AS close_a, b.close AS close_b FROM v_bars_1h a JOIN v_bars_1h b ON a.ts = b.ts WHERE a.symbol < b.symbol")
def _(t):
    return B.pair_legs(t.bars_1h.select("symbol", "ts", "close"), tape_pairs(t), "ts").select("pair", "ts", "close_a", "close_b")


# ---- joins, aggregates, windows, sets ------------------------------------------------------------------

@query("jn1_legs_inner", f"SELECT pair, ts, {R('close_a')} AS close_a, {R('close_b')} AS close_b FROM v_spread")
def _(t):
    return rounded(pair_legs(t).select("pair", "ts", "close_a", "close_b"), "close_a", "close_b")


@query("jn2_left_enrich", f"SELECT b.symbol, b.ts, b.close, {R('k.spread', 4)} AS spread FROM v_bars_1h b LEFT JOIN (SELECT symbol, date_trunc('hour', ts) AS ts, avg(ask_px_1 - bid_px_1) AS spread FROM v_book GROUP BY 1, 2) k ON b.symbol = k.symbol AND b.ts = k.ts")
def _(t):
    k = t.book.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(rnd(F.avg(c("ask_px_1") - c("bid_px_1")), 4).alias("spread"))
    return t.bars_1h.select("symbol", "ts", "close").join(k, ["symbol", "ts"], "left")


@query("jn6_unordered_pairs", "SELECT a.symbol || '_' || b.symbol AS pair FROM (SELECT DISTINCT symbol FROM v_daily) a JOIN (SELECT DISTINCT symbol FROM v_daily) b ON a.symbol < b.symbol")
def _(t):
    s = t.daily.select("symbol").distinct()
    b = s.select(c("symbol").alias("other"))
    return s.join(b, c("symbol") < c("other")).select(F.concat_ws("_", "symbol", "other").alias("pair"))


@query("jn7_semi_anti", "SELECT symbol, count(*) AS n, 'semi' AS kind FROM v_bars_1h WHERE symbol IN ('S1', 'S2') GROUP BY symbol UNION ALL SELECT symbol, count(*), 'anti' FROM v_bars_1h WHERE symbol NOT IN ('S1', 'S2') GROUP BY symbol")
def _(t):
    k = t.trades.where(c("symbol").isin("S1", "S2")).select("symbol").distinct()
    f = lambda how: t.bars_1h.join(k, "symbol", f"left_{how}").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.lit(how).alias("kind"))
    return f("semi").unionByName(f("anti"))


@query("jn8_lookup", f"SELECT s.pair, s.sym_a, count(*) AS n, {R('max(p.beta)')} AS beta FROM v_spread s JOIN v_pairs p ON p.pair = s.pair GROUP BY ALL")
def _(t):
    panel = daily_panel(t)
    pairs = selected_pairs(t)
    legs = P.pair_legs(panel, pairs.select("pair", "sym_a", "sym_b"), ["lp"])
    return legs.join(pairs.select("pair", "beta"), "pair").groupBy("pair", "sym_a").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("beta")).alias("beta"))


@query("jn9_offset_join", f"SELECT a.symbol, a.ts, {R('b.lp - a.lp')} AS fwd7 FROM v_panel a JOIN v_panel b ON a.symbol = b.symbol AND b.i = a.i + 7")
def _(t):
    p = daily_panel(t)
    b = p.select("symbol", (c("i") - 7).alias("i"), c("lp").alias("later"))
    return p.join(b, ["symbol", "i"]).select("symbol", "ts", rnd(c("later") - c("lp")).alias("fwd7"))


@query("agg1_group_stats", f"SELECT symbol, count(*) AS n, {R('sum(notional)', 2)} AS s, {R('avg(price)')} AS a, min(price) AS lo, max(price) AS hi, arg_max(price, trade_id) AS last_px, count(DISTINCT price) AS nu FROM v_trades GROUP BY symbol")
def _(t):
    return t.trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("notional"), 2).alias("s"), rnd(F.avg("price")).alias("a"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.max_by("price", "trade_id").alias("last_px"), F.countDistinct("price").alias("nu"))


@query("agg2_moments", f"""WITH m AS (SELECT symbol, avg(amount) AS mu, stddev_pop(amount) AS sp FROM v_trades GROUP BY symbol)
SELECT t.symbol, {R('stddev_samp(amount)')} AS s1, {R('stddev_pop(amount)')} AS s0, {R('median(amount)')} AS med, {R('quantile_cont(amount, 9e-1)')} AS q90, {R('corr(amount, price)')} AS r, {R('covar_samp(amount, price)')} AS cv,
 {R('avg(((amount - mu) / sp) ** 3)')} AS skew, {R('avg(((amount - mu) / sp) ** 4)')} AS kurt FROM v_trades t JOIN m ON m.symbol = t.symbol GROUP BY t.symbol""")
def _(t):
    return t.trades.groupBy("symbol").agg(rnd(F.stddev_samp("amount")).alias("s1"), rnd(F.stddev_pop("amount")).alias("s0"),
                                          rnd(F.corr("amount", "price")).alias("r"), rnd(F.covar_samp("amount", "price")).alias("cv"), rnd(F.skewness("amount")).alias("skew"), rnd(F.kurtosis("amount") + 3).alias("kurt")).join(
                                              rounded(I.exact_quantiles(t.trades, "amount", (0.5, 0.9), ["symbol"], ("med", "q90")), "med", "q90"), "symbol")


@query("agg3_distinct", "SELECT side, count(DISTINCT symbol) AS symbols, count(DISTINCT price) AS prices FROM v_trades GROUP BY side")
def _(t):
    return t.trades.groupBy("side").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("price").alias("prices"))


@query("agg4_mode", "SELECT symbol, arg_min(px_c, rk) AS mode_px FROM (SELECT symbol, px_c, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, px_c) AS rk FROM (SELECT symbol, px_c, count(*) AS n FROM v_trades GROUP BY ALL)) GROUP BY symbol")
def _(t):
    g = t.trades.groupBy("symbol", "px_c").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("symbol").agg(F.max_by("px_c", F.struct("n", -c("px_c"))).alias("mode_px"))


@query("agg5_grouping_sets", f"SELECT coalesce(symbol, 'ALL') AS symbol, coalesce(regime, 'ALL') AS regime, count(*) AS n, {R('sum(notional)', 2)} AS s FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'CALM' ELSE 'CRASH' END AS regime FROM v_trades) GROUP BY GROUPING SETS ((symbol, regime), (symbol), (regime), ())")
def _(t):
    d = t.trades.withColumn("regime", F.when(c("ts") < F.lit("2024-01-16").cast("timestamp"), "CALM").otherwise("CRASH"))
    g = d.cube("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("notional"), 2).alias("s"))
    return g.select(F.coalesce("symbol", F.lit("ALL")).alias("symbol"), F.coalesce("regime", F.lit("ALL")).alias("regime"), "n", "s")


@query("win1_lag_lead", f"SELECT symbol, ts, {R('lp - lag(lp, 3) OVER w')} AS d3, {R('lead(lp, 2) OVER w - lp')} AS f2 FROM v_panel WINDOW w AS (PARTITION BY symbol ORDER BY i)")
def _(t):
    h = halo_blocks(daily_panel(t), "i", back=3, fwd=2)
    w = block_window(["symbol"], "i")
    return core_rows(h.withColumns({"d3": rnd(c("lp") - F.lag("lp", 3).over(w)), "f2": rnd(F.lead("lp", 2).over(w) - c("lp"))})).select("symbol", "ts", "d3", "f2")


@query("win2_rolling", f"SELECT symbol, ts, {R('CASE WHEN count(lp) OVER w >= 10 THEN avg(lp) OVER w END')} AS m, {R('CASE WHEN count(lp) OVER w >= 10 THEN stddev_samp(lp) OVER w END')} AS s, {R('sum(volume_usdt) OVER w', 1)} AS v FROM v_panel WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def _(t):
    h = halo_blocks(daily_panel(t), "i", back=30)
    w = block_window(["symbol"], "i").rowsBetween(-29, 0)
    n = F.count("lp").over(w)
    return core_rows(h.withColumns({"m": rnd(X.at_least(F.avg("lp").over(w), n, 10)), "s": rnd(X.at_least(F.stddev_samp("lp").over(w), n, 10)), "v": rnd(F.sum("volume_usdt").over(w), 1)})).select("symbol", "ts", "m", "s", "v")


@query("win3_rolling_corr", f"SELECT pair, ts, {R('rolling_corr_24')} AS r FROM v_feat")
def _(t):
    return features(t).select("pair", "ts", rnd("rolling_corr_24").alias("r"))


@query("win4_excluding_current", f"SELECT symbol, ts, {R('avg(lp) OVER w')} AS m FROM v_panel WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(t):
    h = halo_blocks(daily_panel(t), "i", back=20)
    return core_rows(h.withColumn("m", rnd(F.avg("lp").over(block_window(["symbol"], "i").rowsBetween(-20, -1))))).select("symbol", "ts", "m")


@query("win5_cumulative", f"SELECT symbol, ts, CAST(sum(volume) OVER w AS BIGINT) AS cum, CAST(max(volume) OVER w AS BIGINT) AS peak, {R('avg(volume) OVER w', 4)} AS mean FROM v_bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def _(t):
    from ..core.ordered import running_sum
    d = t.bars_1h.withColumns({"v": c("volume").cast("long"), "one": F.lit(1).cast("long")})
    d = T.equity_curve(d.select("symbol", "ts", "v", "one"), ["symbol"], "v", DAY_US)  # peak of the running sum
    d = running_sum(d, ["symbol"], ["ts"], {"k": "one"}, DAY_US)
    top = t.bars_1h.select("symbol", "ts", c("volume").cast("long").alias("v"))
    from ..core.ordered import _scan, chunk_of
    w = Window.partitionBy("symbol", "_chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("_chunk", chunk_of("ts", DAY_US))
    pre = top.groupBy("symbol", "_chunk").agg(F.max("v").alias("_t"))
    pre = pre.select("symbol", "_chunk", F.max("_t").over(_scan(["symbol"]).rowsBetween(Window.unboundedPreceding, -1)).alias("_t"))
    peak = (top.withColumn("_p", F.max("v").over(w)).join(pre, ["symbol", "_chunk"], "left")
            .select("symbol", "ts", F.greatest("_p", F.coalesce("_t", "_p")).alias("peak")))
    return d.select("symbol", "ts", c("equity").alias("cum"), rnd(c("equity") / c("k"), 4).alias("mean")).join(peak, ["symbol", "ts"])


@query("win6_quintiles", "WITH m AS (SELECT symbol, split_part(CAST(ts AS VARCHAR), '-', 1) AS y, avg(lp) AS v FROM v_panel GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, symbol) AS rn, count(*) OVER (PARTITION BY y) AS n FROM m) SELECT y, symbol, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= greatest(1, n // 5)")
def _(t):
    m = daily_panel(t).groupBy("symbol", F.year("ts").cast("string").alias("y")).agg(F.avg("lp").alias("v"))
    w = Window.partitionBy("y")
    r = m.withColumns({"rn": F.row_number().over(w.orderBy(c("v").desc(), "symbol")), "n": F.count(F.lit(1)).over(w)})
    return r.where(c("rn") <= F.greatest(F.lit(1), F.floor(c("n") / 5))).select("y", "symbol", "rn")


@query("win7_first_last", "SELECT symbol, CAST(ts AS DATE) AS day, arg_min(price, trade_id) AS first_px, arg_max(price, trade_id) AS last_px FROM v_trades WHERE side <> '' GROUP BY ALL")
def _(t):
    d = t.trades.where("side <> ''")
    return d.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("price", "trade_id").alias("first_px"), F.max_by("price", "trade_id").alias("last_px"))


@query("srt1_top_n", "SELECT trade_id, notional FROM v_trades ORDER BY notional DESC, trade_id LIMIT 25")
def _(t):
    return t.trades.orderBy(c("notional").desc(), "trade_id").limit(25).select("trade_id", "notional")


@query("set1_union_all", "SELECT symbol, ts, price, CAST(NULL AS DOUBLE) AS close FROM v_trades UNION ALL SELECT symbol, ts, NULL, close FROM v_bars_1h")
def _(t):
    return t.trades.select("symbol", "ts", "price").unionByName(t.bars_1h.select("symbol", "ts", "close"), allowMissingColumns=True)


@query("set2_intersect_union", "(SELECT symbol FROM v_trades WHERE amount > 1990 INTERSECT SELECT symbol FROM v_book) UNION SELECT symbol FROM v_daily WHERE symbol < 'P2'")
def _(t):
    return (t.trades.where("amount > 1990").select("symbol").intersect(t.book.select("symbol"))
            .union(t.daily.where("symbol < 'P2'").select("symbol")).distinct())


@query("set3_except", "SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM v_trades EXCEPT SELECT DISTINCT symbol, CAST(ts AS DATE) FROM v_book WHERE ts < TIMESTAMP '2024-01-20'")
def _(t):
    b = t.book.where(c("ts") < F.lit("2024-01-20").cast("timestamp")).select("symbol", F.to_date("ts").alias("day")).distinct()
    return t.trades.select("symbol", F.to_date("ts").alias("day")).distinct().exceptAll(b)


# ---- pair features -----------------------------------------------------------------------------------

@query("pf1_static_spread", f"SELECT pair, ts, {R('spread')} AS spread FROM v_spread")
def _(t):
    return spreads(t).select("pair", "ts", rnd("spread").alias("spread"))


@query("pf2_rolling_z", f"SELECT pair, ts, {R('spread_z')} AS z FROM v_feat")
def _(t):
    return X.spread_features(spreads(t), FCFG).select("pair", "ts", rnd("spread_z").alias("z"))


@query("pf3_spread_diffs_vols", f"SELECT pair, ts, {R('spread_diff_1')} AS d1, {R('spread_diff_4')} AS d4, {R('spread_diff_24')} AS d24, {R('spread_vol_24')} AS v24, {R('spread_vol_z')} AS vz FROM v_feat")
def _(t):
    return X.spread_features(spreads(t), FCFG).select("pair", "ts", rnd("spread_diff_1").alias("d1"), rnd("spread_diff_4").alias("d4"), rnd("spread_diff_24").alias("d24"), rnd("spread_vol_24").alias("v24"), rnd("spread_vol_z").alias("vz"))


@query("pf4_volume_features", f"SELECT pair, ts, {R('volume_ratio', 5)} AS volume_ratio, {R('volume_z_a')} AS za, {R('volume_z_b')} AS zb, {R('pair_volume_sum', 1)} AS vs, {R('pair_volume_gmean', 1)} AS vg FROM v_feat")
def _(t):
    return features(t).select("pair", "ts", rnd("volume_ratio", 5).alias("volume_ratio"), rnd("volume_z_a").alias("za"), rnd("volume_z_b").alias("zb"), rnd("pair_volume_sum", 1).alias("vs"), rnd("pair_volume_gmean", 1).alias("vg"))


@query("pf5_market_context", f"SELECT pair, ts, {R('market_return_24')} AS m FROM v_feat")
def _(t):
    return features(t).select("pair", "ts", rnd("market_return_24").alias("m"))


@query("pf6_corr_and_vols", f"SELECT pair, ts, {R('rolling_corr_24')} AS r, {R('realized_vol_a_24')} AS va, {R('realized_vol_b_24')} AS vb FROM v_feat")
def _(t):
    return features(t).select("pair", "ts", rnd("rolling_corr_24").alias("r"), rnd("realized_vol_a_24").alias("va"), rnd("realized_vol_b_24").alias("vb"))


@query("pf8_targets", f"SELECT pair, ts, {R('target_change')} AS tc, {R('target_abs_change')} AS ta, target_reversion FROM v_feat")
def _(t):
    return X.spread_features(spreads(t), FCFG).select("pair", "ts", rnd("target_change").alias("tc"), rnd("target_abs_change").alias("ta"), "target_reversion")


@query("pf9_complete_features", f"SELECT pair, ts, {R('spread')} AS spread, {R('spread_z')} AS spread_z, {R('volume_ratio', 5)} AS volume_ratio, {R('rolling_corr_24')} AS rolling_corr_24 FROM v_ready WHERE pair IN (SELECT pair FROM v_ready GROUP BY pair HAVING count(*) >= 200)")
def _(t):
    return rounded(rounded(ready(t).select("pair", "ts", "spread", "spread_z", "volume_ratio", "rolling_corr_24"), "spread", "spread_z", "rolling_corr_24"), "volume_ratio", digits=5)


@query("pf11_samples", f"""SELECT pair, ts, {R('spread_z')} AS latest_spread_z, {R('mean_spread_z')} AS mean_spread_z, {R('min_spread_z')} AS min_spread_z, {R('max_spread_z')} AS max_spread_z, {R('mean_volume_ratio', 5)} AS mean_volume_ratio,
 {R('mean_pair_volume_sum', 1)} AS mean_pair_volume_sum, {R('target_change')} AS y_regression, target_reversion AS y_reversion FROM v_samples""")
def _(t):
    d = X.samples(ready(t), SCFG).select("pair", "ts", "latest_spread_z", "mean_spread_z", "min_spread_z", "max_spread_z", "mean_volume_ratio", "mean_pair_volume_sum", "y_regression", "y_reversion")
    d = rounded(d, "latest_spread_z", "mean_spread_z", "min_spread_z", "max_spread_z", "y_regression")
    return rounded(rounded(d, "mean_volume_ratio", digits=5), "mean_pair_volume_sum", digits=1)


@query("pf12_spread_slope", f"SELECT pair, ts, {R('spread_slope', 8)} AS spread_slope FROM v_samples")
def _(t):
    return X.samples(ready(t), SCFG).select("pair", "ts", rnd("spread_slope", 8).alias("spread_slope"))


@query("pf13_zero_crossing", "SELECT pair, ts, time_since_zero_crossing FROM v_samples")
def _(t):
    return X.samples(ready(t), SCFG).select("pair", "ts", "time_since_zero_crossing")


@query("pf14_class_label", "SELECT pair, ts, y_class FROM v_samples")
def _(t):
    return X.samples(ready(t), SCFG).select("pair", "ts", "y_class")


@query("pf15_label_threshold", f"SELECT pair, {R('threshold', 8)} AS threshold FROM v_thr")
def _(t):
    from ..core.ordered import YEAR_US, row_index
    return rounded(X.label_thresholds(row_index(ready(t), ["pair"], ["ts"], "rn", YEAR_US), SCFG), "threshold", digits=8)


@query("pf16_sequences", f"SELECT pair, ts, 32 AS steps, 16 AS width, {R('(SELECT 0e0) + sum(spread_z) OVER (PARTITION BY pair ORDER BY rn ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)', 1)} AS z_sum FROM v_ready QUALIFY rn >= 32")
def _(t):
    d = X.samples(ready(t), SCFG, sequences=True)
    z = X.FEATURES.index("spread_z")
    return d.select("pair", "ts", F.size("sequence").alias("steps"), F.size(c("sequence")[0]).alias("width"),
                    rnd(F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[z].cast("double")), 1).alias("z_sum"))


WSQL = win_sql("v_samples", 365, 90, 90)


@query("pf17_walk_windows", WSQL + " SELECT split_id, train_start, train_end, test_end FROM win")
def _(t):
    return windows(X.samples(ready(t), SCFG), 365, 90, 90)


@query("pf17_month_windows", """WITH b AS (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS lo, max(ts) AS hi FROM v_daily)
SELECT CAST(k AS INTEGER) AS split_id, CAST(lo + to_months(CAST(k * 2 AS INTEGER)) AS TIMESTAMP) AS train_start, CAST(lo + to_months(CAST(k * 2 + 6 AS INTEGER)) AS TIMESTAMP) AS train_end, CAST(lo + to_months(CAST(k * 2 + 8 AS INTEGER)) AS TIMESTAMP) AS test_end FROM b, range(1000) r(k)
WHERE lo + to_months(CAST(k * 2 + 8 AS INTEGER)) <= hi""")
def _(t):
    return N.windows_months(t.daily.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), 6, 2, 2)


@query("pf18_split_ids", WSQL + " SELECT pair, ts, list_sort(list(split_id)) AS walk_split_ids FROM v_samples JOIN win ON ts >= train_start AND ts < test_end GROUP BY pair, ts")
def _(t):
    s = X.samples(ready(t), SCFG).select("pair", "ts")
    return X.with_split_ids(N.assign_windows(s, windows(s, 365, 90, 90), 365, 90, 90), ["pair", "ts"])


@query("exp13_split_ids_json", WSQL + " SELECT pair, ts, '[' || array_to_string(list_sort(list(split_id)), ',') || ']' AS walk_split_ids FROM v_samples JOIN win ON ts >= train_start AND ts < test_end GROUP BY pair, ts")
def _(t):
    s = X.samples(ready(t), SCFG).select("pair", "ts")
    d = X.with_split_ids(N.assign_windows(s, windows(s, 365, 90, 90), 365, 90, 90), ["pair", "ts"])
    return d.withColumn("walk_split_ids", F.to_json("walk_split_ids"))


@query("jn5_interval_join", WSQL + " SELECT split_id, CASE WHEN ts < train_end THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM v_samples JOIN win ON ts >= train_start AND ts < test_end GROUP BY ALL")
def _(t):
    s = X.samples(ready(t), SCFG).select("pair", "ts")
    d = N.assign_windows(s, windows(s, 365, 90, 90), 365, 90, 90)
    return d.groupBy("split_id", F.when(c("ts") < c("train_end"), "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("pf19_chronological_split", "SELECT CASE WHEN ts >= (SELECT max(ts) FROM v_samples) - INTERVAL 90 DAY THEN 'test' ELSE 'train' END AS part, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM v_samples GROUP BY 1")
def _(t):
    d = X.chronological_split(X.samples(ready(t), SCFG), 90)
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("pf20_impute_scale", f"""WITH m AS (SELECT median(volume_ratio) AS m1, median(spread_z) AS m2 FROM v_ready WHERE ts < TIMESTAMP '2000-01-01'),
s AS (SELECT avg(volume_ratio) AS a1, stddev_pop(volume_ratio) AS s1, avg(spread_z) AS a2, stddev_pop(spread_z) AS s2 FROM v_ready WHERE ts < TIMESTAMP '2000-01-01')
SELECT pair, ts, {R('((CASE WHEN i % 11 = 0 THEN m1 ELSE volume_ratio END) - a1) / s1', 4)} AS volume_ratio, {R('(spread_z - a2) / s2', 5)} AS spread_z FROM v_ready, m, s WHERE ts >= TIMESTAMP '2000-01-01'""")
def _(t):
    d, cut = ready(t), F.lit("2000-01-01").cast("timestamp")
    rows = d.where(c("ts") >= cut).withColumn("volume_ratio", F.when(c("i") % 11 == 0, None).otherwise(c("volume_ratio")))
    out = X.impute_and_scale(d.where(c("ts") < cut), rows, ["volume_ratio", "spread_z"])
    return rounded(rounded(out.select("pair", "ts", "volume_ratio", "spread_z"), "volume_ratio", digits=4), "spread_z", digits=5)


# ---- signals and P&L -----------------------------------------------------------------------------------

@query("bt1_class_signal", "SELECT pair, ts, signal FROM v_signal")
def _(t):
    return signals(t).select("pair", "ts", "signal")


@query("bt2_gated_signal", "SELECT pair, ts, CASE WHEN abs(latest_spread_z) >= 1 THEN signal ELSE 0e0 END AS gated, CASE WHEN i % 2 = 0 THEN signal ELSE 0e0 END AS masked FROM v_signal")
def _(t):
    d = signals(t).withColumn("calm", c("i") % 2 == 0)
    return d.select("pair", "ts", T.gate_by_z(c("signal"), "latest_spread_z", 1.0).alias("gated"), T.gate_by_regime(c("signal"), "calm").alias("masked"))


@query("bt3_state_machine", """WITH RECURSIVE base AS MATERIALIZED (SELECT pair, rn, ts, latest_spread_z AS z, sign(current_spread) AS s, pred_class AS k FROM v_preds),
rec AS (SELECT pair, rn, CASE WHEN k = 0 AND abs(z) >= 15e-1 AND s <> 0 THEN -s ELSE 0 END AS pos, CASE WHEN k = 0 AND abs(z) >= 15e-1 AND s <> 0 THEN s ELSE 0 END AS es FROM base WHERE rn = 1
UNION ALL SELECT b.pair, b.rn,
 CASE WHEN r.pos = 0 THEN CASE WHEN k = 0 AND abs(z) >= 15e-1 AND s <> 0 THEN -s ELSE 0 END WHEN abs(z) <= 5e-1 OR k = 2 OR (s <> 0 AND s <> r.es) THEN 0 ELSE r.pos END,
 CASE WHEN r.pos = 0 THEN CASE WHEN k = 0 AND abs(z) >= 15e-1 AND s <> 0 THEN s ELSE 0 END WHEN abs(z) <= 5e-1 OR k = 2 OR (s <> 0 AND s <> r.es) THEN 0 ELSE r.es END
 FROM rec r JOIN base b ON b.pair = r.pair AND b.rn = r.rn + 1)
SELECT base.pair, base.ts, CAST(pos AS DOUBLE) AS signal FROM rec JOIN base ON base.pair = rec.pair AND base.rn = rec.rn""")
def _(t):
    return T.class_machine(preds(t), ["pair"]).select("pair", "ts", (c("signal") + F.lit(0.0)).alias("signal"))


@query("bt4_baseline_rule", "SELECT pair, ts, CASE WHEN abs(latest_spread_z) >= 15e-1 THEN 0 ELSE 1 END AS pred FROM v_preds")
def _(t):
    return preds(t).select("pair", "ts", T.baseline_rule().alias("pred"))


@query("bt6_hysteresis", "SELECT pair, ts, position FROM v_hyst")
def _(t):
    return T.hysteresis(zscored(t), "z", ["pair"]).select("pair", "ts", "position")


@query("bt5_price_alignment", """WITH d AS (SELECT p.pair, p.ts, a.close AS ca, b.close AS cb FROM v_preds p LEFT JOIN v_daily a ON a.symbol = p.sym_a AND a.ts = p.ts LEFT JOIN v_daily b ON b.symbol = p.sym_b AND b.ts = p.ts),
f AS (SELECT pair, ts, last_value(ca IGNORE NULLS) OVER w AS close_a, last_value(cb IGNORE NULLS) OVER w AS close_b FROM d WINDOW w AS (PARTITION BY pair ORDER BY ts))
SELECT pair, ts, """ + R("close_a") + " AS close_a, " + R("close_b") + " AS close_b FROM f WHERE close_a IS NOT NULL AND close_b IS NOT NULL")
def _(t):
    d = T.align_prices(preds(t).select("pair", "sym_a", "sym_b", "ts"), t.daily)
    return rounded(d.select("pair", "ts", "close_a", "close_b"), "close_a", "close_b")


@query("bt11_execution_lag", "SELECT pair, ts, held FROM v_signal")
def _(t):
    return pnl(t).select("pair", "ts", "held")


@query("bt12_pair_pnl", f"SELECT pair, ts, {R('gross', 5)} AS gross FROM v_pnl")
def _(t):
    return pnl(t).select("pair", "ts", rnd("gross", 5).alias("gross"))


@query("bt12_unit_pnl", f"SELECT pair, ts, {R('gross', 8)} AS gross, {R('net', 8)} AS net FROM v_unit")
def _(t):
    return rounded(unit(t).select("pair", "ts", "gross", "net"), "gross", "net", digits=8)


@query("bt13_turnover_cost", f"SELECT pair, ts, {R('turnover', 4)} AS turnover, {R('cost', 4)} AS cost FROM v_pnl")
def _(t):
    return rounded(pnl(t).select("pair", "ts", "turnover", "cost"), "turnover", "cost", digits=4)


@query("bt15_ledger", f"SELECT pair, ts, held AS from_signal, signal AS to_signal, {R('turnover', 4)} AS turnover FROM v_pnl WHERE signal <> held")
def _(t):
    return rounded(T.ledger(pnl(t)), "turnover", digits=4)


@query("bt16_active_cap", "SELECT pair, ts, CASE WHEN sum(CASE WHEN signal <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ts ORDER BY pair) <= 4 THEN signal ELSE 0e0 END AS signal FROM v_pnl")
def _(t):
    return T.cap_active(T.dense_book(pnl(t)), 4).select("pair", "ts", "signal")


@query("bt17_portfolio", f"SELECT ts, {R('sum(pnl)', 4)} AS pnl, count(*) FILTER (signal <> 0) AS active_pairs FROM v_pnl GROUP BY ts")
def _(t):
    return rounded(T.portfolio(T.dense_book(pnl(t))), "pnl", digits=4)


@query("bt18_metrics", f"""WITH p AS (SELECT ts, sum(pnl) AS pnl, count(*) FILTER (signal <> 0) AS act FROM v_pnl GROUP BY ts), e AS (SELECT *, sum(pnl) OVER (ORDER BY ts) AS eq FROM p),
d AS (SELECT *, max(eq) OVER (ORDER BY ts) AS pk FROM e), b AS (SELECT count(DISTINCT pair) * 2e4 AS base FROM v_pnl),
u AS (SELECT sum(abs(dx)) * 2e4 AS turn FROM (SELECT signal - lag(signal) OVER (PARTITION BY pair ORDER BY ts) AS dx FROM v_pnl))
SELECT {R('sum(pnl)', 3)} AS total_pnl_dollars, {R('avg(pnl) / max(base)', 9)} AS mean_bar_return, {R('stddev_samp(pnl) / max(base)', 9)} AS std_bar_return, {R('avg(pnl) / stddev_samp(pnl) * sqrt(365e0)')} AS sharpe_annualized,
 {R('min(eq - pk)', 3)} AS max_drawdown_dollars, {R('min((eq - pk) / greatest(pk, 1e0))', 4)} AS max_drawdown_pct_of_peak, count(*) AS bars, count(*) FILTER (act > 0) AS active_bars, (SELECT count(*) FROM v_pnl WHERE signal <> held) AS trades,
 {R('(SELECT turn FROM u)', 2)} AS turnover_dollars, {R('count(*) FILTER (pnl > 0) * 1e0 / greatest(1, count(*) FILTER (pnl <> 0))')} AS win_rate_bars FROM d, b""")
def _(t):
    d = pnl(t)
    m = T.metrics(T.dense_book(d), T.ledger(d), T.Costs(bars_per_year=365.0))
    m = rounded(m, "total_pnl_dollars", "max_drawdown_dollars", digits=3)
    m = rounded(m, "mean_bar_return", "std_bar_return", digits=9)
    return rounded(rounded(rounded(m, "sharpe_annualized", "win_rate_bars"), "turnover_dollars", digits=2), "max_drawdown_pct_of_peak", digits=4)


@query("bt20_drawdown", f"""WITH e AS (SELECT ts, sum(pnl) OVER (ORDER BY ts) AS eq FROM v_port) SELECT ts, {R('eq')} AS equity, {R('max(eq) OVER (ORDER BY ts)')} AS peak, {R('eq - max(eq) OVER (ORDER BY ts)')} AS drawdown FROM e""")
def _(t):
    return rounded(T.equity_curve(portfolio(t).select("ts", "pnl")), "equity", "peak", "drawdown").drop("pnl")


@query("bt21_round_trips", f"""WITH s AS (SELECT *, CASE WHEN position <> 0 AND coalesce(lag(position) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st, lead(i) OVER w IS NULL AS fin FROM v_unit WINDOW w AS (PARTITION BY pair ORDER BY i)),
g AS (SELECT *, sum(st) OVER (PARTITION BY pair ORDER BY i) AS trip FROM s)
SELECT pair, min(i) AS entry_i, count(*) AS bars_held, {R('sum(net)', 8)} AS trip_pnl, bool_or(fin) AS open_at_end FROM g WHERE position <> 0 GROUP BY pair, trip""")
def _(t):
    return rounded(T.round_trips(unit(t), ["pair"]), "trip_pnl", digits=8).drop("trip")


@query("bar12_period_pnl", f"SELECT date_trunc('month', ts)::TIMESTAMP AS period, {R('sum(pnl)', 8)} AS pnl FROM v_port GROUP BY 1 HAVING sum(pnl) <> 0")
def _(t):
    from ..operators.bars import period_pnl
    return rounded(period_pnl(portfolio(t), "month"), "pnl", digits=8)


@query("inr1_sharpe", f"""SELECT 'day' AS freq, {R('avg(pnl) / stddev_samp(pnl) * sqrt(365e0)')} AS sharpe FROM v_port UNION ALL
SELECT 'month', {R('avg(p) / stddev_samp(p) * sqrt(12e0)')} FROM (SELECT sum(pnl) AS p FROM v_port GROUP BY date_trunc('month', ts) HAVING sum(pnl) <> 0)""")
def _(t):
    from ..operators.bars import period_pnl
    p = portfolio(t)
    a = p.agg(rnd(I.sharpe("pnl", 365.0)).alias("sharpe")).select(F.lit("day").alias("freq"), "sharpe")
    b = period_pnl(p, "month").agg(rnd(I.sharpe("pnl", 12.0)).alias("sharpe")).select(F.lit("month").alias("freq"), "sharpe")
    return a.unionByName(b)


def hac_sql(src: str, key: str, val: str, lag: int) -> str:
    lags = ", ".join(f"lag(x, {j}) OVER w AS l{j}" for j in range(1, lag + 1))
    terms = " + ".join(f"2 * (1 - {j} / {lag + 1}e0) * coalesce(sum(x * l{j}), 0e0) / count(*)" for j in range(1, lag + 1))
    return f"""hm AS (SELECT {key}, avg({val}) AS mu, stddev_samp({val}) AS sd FROM {src} GROUP BY {key}),
hx AS (SELECT s.{key}, s.i, s.{val} - hm.mu AS x, hm.mu, hm.sd FROM {src} s JOIN hm ON hm.{key} = s.{key}), hl AS (SELECT *, {lags} FROM hx WINDOW w AS (PARTITION BY {key} ORDER BY i)),
hac AS (SELECT {key}, count(*) AS n, any_value(mu) AS mean, any_value(sd) AS sd, sum(x * x) / count(*) + {terms} AS hac_var FROM hl GROUP BY {key})"""


@query("inr2_hac_variance", "WITH " + hac_sql("v_unit", "pair", "net", 12) + f" SELECT pair, n, {R('hac_var * 1e6')} AS hac_var FROM hac")
def _(t):
    v = I.hac_variance(unit(t), ["pair"], "net", 12)
    return v.select("pair", "n", rnd(c("hac_var") * 1e6).alias("hac_var"))


@query("inr3_hac_sharpe", "WITH " + hac_sql("v_unit", "pair", "net", 24) + f" SELECT pair, n, {R('mean / sd * sqrt(365e0)')} AS iid_sharpe, {R('mean / sqrt(hac_var) * sqrt(365e0)')} AS hac_sharpe, {R('sqrt(hac_var) / sd')} AS inflation FROM hac")
def _(t):
    v = I.hac_sharpe(unit(t), ["pair"], "net", 24, 365.0)
    return rounded(v, "iid_sharpe", "hac_sharpe", "inflation").select("pair", "n", "iid_sharpe", "hac_sharpe", "inflation")


@query("inr9_simple_ols", f"""SELECT pair, {R('regr_slope(ra, rb)')} AS slope, {R('regr_slope(ra, rb) / sqrt((regr_syy(ra, rb) - regr_slope(ra, rb) * regr_sxy(ra, rb)) / (regr_count(ra, rb) - 2) / regr_sxx(ra, rb))', 4)} AS t, {R('corr(ra, rb) ** 2')} AS r2, regr_count(ra, rb) AS n FROM v_spread GROUP BY pair""")
def _(t):
    e = I.simple_ols("ra", "rb")
    d = features(t)
    return d.groupBy("pair").agg(rnd(e["slope"]).alias("slope"), rnd(e["t"], 4).alias("t"), rnd(e["r2"]).alias("r2"), e["n"].alias("n"))
