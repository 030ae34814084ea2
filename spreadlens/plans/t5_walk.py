"""Events, selectability, baselines and the walk-forward book (EV, ML baselines, ST11, ST15, BT7-30, INR4-21)."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..core.ordered import DAY_US
from ..operators import backtest as T, bars as B, events as V, features as X, inference as I, ml as M, pairs as P, panel as N, walk as W
from .base_tables import daily_panel, pair_legs, spreads, tape_pairs
from .registry import query, rnd, rnd_sql as R, rounded, unit_sql as U
from .t1_sources import windows
from .t2_book_tape import _WB, _WBB, _WU, _WUB
from .t3_pairs import FCFG, SCFG, WSQL, hac_sql, preds, ready, zscored

c = F.col
_UZ = "CASE WHEN x THEN NULL WHEN z >= 2 THEN -1e0 WHEN z <= -2 THEN 1e0 END"


def samples(t):
    return t.store("samples", lambda: X.samples(ready(t), SCFG))


def wins(t):
    return t.store("walk_windows", lambda: windows(daily_panel(t), 365, 90, 90))


def picks(t):
    return t.store("ou_picks", lambda: P.select_ou(daily_panel(t), wins(t), 5, 2.0, 90.0))


def walk(t):
    return t.store("walk_rows", lambda: W.test_rows(daily_panel(t), wins(t), picks(t)))


def unit(t, stop=4.0):
    return T.unit_pnl(T.hysteresis(walk(t), "z", W.KEYS, stop=stop), 15.0, W.KEYS)


# ---- events --------------------------------------------------------------------------------------------

_EV = """WITH RECURSIVE ev AS MATERIALIZED (SELECT pair, i, spread_z AS z, lead(spread_z, 10) OVER w AS z1, lead(i, 10) OVER w AS more FROM v_feat WHERE spread_z IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY i)),
e AS MATERIALIZED (SELECT pair, i, z, z1 FROM ev WHERE abs(z) > 2 AND more IS NOT NULL), nx AS MATERIALIZED (SELECT a.pair, a.i, b.i AS ni FROM e a ASOF JOIN e b ON a.pair = b.pair AND a.i + 10 <= b.i),
rec AS (SELECT pair, min(i) AS i FROM e GROUP BY pair UNION ALL SELECT r.pair, nx.ni FROM rec r JOIN nx ON nx.pair = r.pair AND nx.i = r.i)"""


def events(t):
    z = zscored(t).where("z IS NOT NULL").select("pair", "i", "z")
    return V.reversion_events(z, ["pair"], 10, 10)


@query("ev1_reversion_events", _EV + f" SELECT e.pair, e.i, {R('e.z')} AS z, {R('-sign(e.z) * (e.z1 - e.z)')} AS reversion FROM rec JOIN e ON e.pair = rec.pair AND e.i = rec.i")
def _(t):
    return rounded(events(t), "z", "reversion")


_CZ = """WITH RECURSIVE f AS MATERIALIZED (SELECT pair, i, spread, CASE WHEN count(spread) OVER w >= 60 THEN stddev_samp(spread) OVER w END AS sd, CASE WHEN count(spread) OVER w >= 60 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0e0) END AS z,
 vol_a - vol_b AS flow FROM v_spread WINDOW w AS (PARTITION BY pair ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
g AS MATERIALIZED (SELECT *, lag(z) OVER o AS pz, lead(i, 12) OVER o AS more, lead(spread, 6) OVER o AS s6, lead(spread, 12) OVER o AS s12, lead(z, 6) OVER o AS z6, lead(z, 12) OVER o AS z12 FROM f WHERE z IS NOT NULL WINDOW o AS (PARTITION BY pair ORDER BY i)),
e AS MATERIALIZED (SELECT pair, i, z, CAST(sign(flow) = sign(z) AS INTEGER) AS confirm, -sign(z) * (s6 - spread) / sd AS rev_6, -sign(z) * (s12 - spread) / sd AS rev_12, CAST(abs(z6) < abs(z) AS INTEGER) AS reverted_6, CAST(abs(z12) < abs(z) AS INTEGER) AS reverted_12 FROM g WHERE abs(z) > 2 AND abs(pz) <= 2 AND more IS NOT NULL),
nx AS MATERIALIZED (SELECT a.pair, a.i, b.i AS ni FROM e a ASOF JOIN e b ON a.pair = b.pair AND a.i + 12 <= b.i),
rec AS (SELECT pair, min(i) AS i FROM e GROUP BY pair UNION ALL SELECT r.pair, nx.ni FROM rec r JOIN nx ON nx.pair = r.pair AND nx.i = r.i), k AS (SELECT e.* FROM rec JOIN e ON e.pair = rec.pair AND e.i = rec.i)"""


def crossings(t):
    d = spreads(t).withColumn("flow", c("volume_usdt_a") - c("volume_usdt_b")).select("pair", "i", "spread", "flow")
    z = V.causal_z(d, ["pair"], 60).where("z IS NOT NULL")
    return V.crossing_events(z, ["pair"], (6, 12), 12)


@query("ev2_crossing_events", _CZ + f" SELECT pair, i, {R('z')} AS z, confirm, {R('rev_6')} AS rev_6, {R('rev_12')} AS rev_12, reverted_6, reverted_12 FROM k")
def _(t):
    return rounded(crossings(t).drop("flow_align"), "z", "rev_6", "rev_12")


@query("ev4_conditional_means", _CZ + f""" SELECT pair, count(*) AS n, {R('avg(rev_12)')} AS rev_all, {R('avg(rev_12) FILTER (confirm = 1)')} AS rev_confirm, {R('avg(rev_12) FILTER (confirm = 0)')} AS rev_oppose, {R('avg(reverted_12)')} AS rate_all FROM k GROUP BY pair""")
def _(t):
    d = V.conditional_means(crossings(t), (12,), ["pair"])
    return rounded(d.select("pair", "n", "rev_all", "rev_confirm", "rev_oppose", "rate_all"), "rev_all", "rev_confirm", "rev_oppose", "rate_all")


# train kappa of every pair against its out-of-sample kappa, per window
_SEL = """WITH oos AS (SELECT split_id, pair, regr_slope(x - p, p) AS b FROM (SELECT f.split_id, f.pair, r.la - f.alpha - f.beta * r.lb AS x, lag(r.la - f.alpha - f.beta * r.lb) OVER (PARTITION BY f.split_id, f.pair ORDER BY r.i) AS p
 FROM v_wfit f JOIN v_win w ON w.split_id = f.split_id JOIN v_pair_rows r ON r.pair = f.pair AND r.ts >= w.train_end AND r.ts < w.test_end) WHERE p IS NOT NULL GROUP BY 1, 2),
sel AS (SELECT f.split_id, f.pair, f.b AS tr, -oos.b AS oos_speed, f.sd FROM v_wfit f JOIN oos ON oos.split_id = f.split_id AND oos.pair = f.pair)"""


def selectability(t):
    """Per window and pair: train reversion speed and the same measured out of sample with the frozen hedge."""
    def build():
        p, w = daily_panel(t), wins(t)
        inside = lambda a, b: p.join(F.broadcast(w), (c("ts") >= c(a)) & (c("ts") < c(b)))
        cols = ["split_id", "pair", "sym_a", "sym_b"]
        tr = P.pair_fit(P.pair_moments(inside("train_start", "train_end").select("split_id", "symbol", "i", "lp"), keys=["split_id"]))
        tr = tr.select(*cols, "alpha", "beta", c("ar_b").alias("tr"), c("spread_sd0").alias("sd"))
        # the out-of-sample residual with a frozen hedge is bilinear in the same test moments
        te = P.pair_moments(inside("train_end", "test_end").select("split_id", "symbol", "i", "lp"), keys=["split_id"])
        d = te.join(tr.select("split_id", "sym_a", "sym_b", "pair", "alpha", "beta", "tr", "sd"), ["split_id", "sym_a", "sym_b"])
        b = c("beta")
        sl, sp = c("la") - b * c("lb"), c("pa") - b * c("pb")
        spp = c("paa") + b * b * c("pbb") - 2 * b * c("pab")
        slp = c("lapa") - b * c("lapb") - b * c("lbpa") + b * b * c("lbpb")
        slope = (slp - sl * sp / c("m")) / (spp - sp * sp / c("m"))
        return d.select("split_id", "pair", "tr", "sd", (-(slope - 1)).alias("oos_speed"))
    return t.store("selectability", build)


@query("ev5_quintile_spread", _SEL + f""", k AS (SELECT *, count(*) OVER (PARTITION BY split_id) AS n, row_number() OVER (PARTITION BY split_id ORDER BY tr, pair) AS rt, row_number() OVER (PARTITION BY split_id ORDER BY tr DESC, pair) AS rb FROM sel)
SELECT split_id, max(n) AS n, {R('avg(oos_speed) FILTER (rt <= greatest(1, n // 5))')} AS top, {R('avg(oos_speed) FILTER (rb <= greatest(1, n // 5))')} AS bottom, {R('avg(oos_speed) FILTER (rt <= greatest(1, n // 5)) - avg(oos_speed) FILTER (rb <= greatest(1, n // 5))')} AS spread FROM k GROUP BY split_id""")
def _(t):
    return rounded(V.quintile_spread(selectability(t), "tr", "oos_speed", True), "top", "bottom", "spread")


def _rk(x):
    return f"(rank() OVER (PARTITION BY split_id ORDER BY {x}) + (count(*) OVER (PARTITION BY split_id, {x}) - 1) / 2e0)"


@query("ev6_spearman", _SEL + f", k AS (SELECT split_id, {_rk('tr')} AS a, {_rk('oos_speed')} AS b FROM sel) SELECT split_id, {R('corr(a, b)')} AS rho, count(*) AS n FROM k GROUP BY split_id")
def _(t):
    return rounded(I.rank_correlation(selectability(t), "tr", "oos_speed", ["split_id"]), "rho")


@query("ev7_partial_spearman", _SEL + f", k AS (SELECT split_id, {_rk('tr')} AS a, {_rk('oos_speed')} AS b, {_rk('sd')} AS d FROM sel) SELECT split_id, count(*) AS n, {R('(corr(a, b) - corr(a, d) * corr(b, d)) / sqrt((1 - corr(a, d) ** 2) * (1 - corr(b, d) ** 2))')} AS partial_rho FROM k GROUP BY split_id")
def _(t):
    return rounded(I.partial_rank_correlation(selectability(t), "tr", "oos_speed", "sd", ["split_id"]), "partial_rho")


@query("ev8_rank_product")
def _(t):
    """Rank-product test: standardised ranks within pair, HAC variance per pair at three lags, combined."""
    d = ready(t).select("pair", "i", "ts", c("spread_z").alias("x"), c("target_change").alias("y"))
    d = d.withColumns({"rx": I.average_rank("x", ["pair"]), "ry": I.average_rank("y", ["pair"])})
    d = I.standardise(d, ["rx", "ry"], ["pair"]).withColumn("prod", c("rx_z") * c("ry_z"))
    from ..core.ordered import YEAR_US, row_index
    d = t.store("rank_products", lambda d=d: row_index(d.select("pair", "ts", "prod"), ["pair"], ["ts"], "k", YEAR_US))
    out = None
    for lag in (6, 12, 24):
        v = I.hac_variance(d, ["pair"], "prod", lag, "k")
        s = v.agg((F.sum(c("n") * c("mean")) / F.sum("n")).alias("rho"), (F.sqrt(F.sum(c("n") * c("hac_var"))) / F.sum("n")).alias("se"), F.sum("n").alias("n"))
        s = s.withColumns({"lag": F.lit(lag), "t": c("rho") / c("se")})
        out = s if out is None else out.unionByName(s)
    return out


# ---- baselines -------------------------------------------------------------------------------------------

def tagged(t):
    s = samples(t)
    return N.assign_windows(s, windows(s, 365, 90, 90), 365, 90, 90)


@query("ml1_majority", WSQL + " , n AS (SELECT split_id, y_class, count(*) AS n FROM v_samples JOIN win ON ts >= train_start AND ts < train_end GROUP BY ALL) SELECT split_id, CAST(arg_min(y_class, rk) AS INTEGER) AS pred_class FROM (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY n DESC, y_class) AS rk FROM n) GROUP BY split_id")
def _(t):
    return M.majority_class(tagged(t).where(c("ts") < c("train_end")), keys=["split_id"])


@query("ml2_stratified_random", """WITH sh AS (SELECT avg(CASE WHEN y_class = 0 THEN 1e0 ELSE 0e0 END) AS p0, avg(CASE WHEN y_class <= 1 THEN 1e0 ELSE 0e0 END) AS p1 FROM v_samples WHERE ts < TIMESTAMP '2000-01-01')
SELECT pair, ts, CASE WHEN (i * 7919 % 1000) / 1e3 < p0 THEN 0 WHEN (i * 7919 % 1000) / 1e3 < p1 THEN 1 ELSE 2 END AS pred_class FROM v_samples, sh WHERE ts >= TIMESTAMP '2000-01-01'""")
def _(t):
    cut, s = F.lit("2000-01-01").cast("timestamp"), samples(t)
    u = F.pmod(c("i") * 7919, F.lit(1000)) / 1e3
    return M.stratified_random(s.where(c("ts") < cut), s.where(c("ts") >= cut), ["pair", "i"], 1, uniform=u).select("pair", "ts", "pred_class")


_PRED = "SELECT CASE WHEN abs(spread_z) >= 15e-1 THEN 0 ELSE 1 END AS pred, y_class AS y, split_part(pair, '_', 1) AS m FROM v_samples"


@query("inr22_accuracy_macro_f1", f"""WITH p AS ({_PRED}), k AS (SELECT m, k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y = k) AS sup, count(*) FILTER (pred = k) AS prd FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY m, k)
SELECT m, CAST(sum(sup) AS BIGINT) AS n, {R('sum(tp) * 1e0 / sum(sup)')} AS accuracy, {R('avg(2e0 * tp / (sup + prd)) FILTER (sup + prd > 0)')} AS macro_f1 FROM k GROUP BY m""")
def _(t):
    d = samples(t).withColumns({"pred_class": T.baseline_rule(), "m": F.split_part("pair", F.lit("_"), F.lit(1))})
    return rounded(M.scores(d, ["m"]), "accuracy", "macro_f1")


@query("bt19_trading_scores", f"""WITH s AS (SELECT CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS model, ts, CASE WHEN abs(spread_z) >= 15e-1 THEN -sign(spread) ELSE 0e0 END AS sg, target_change FROM v_samples),
d AS (SELECT model, ts, sum(sg * target_change) AS x FROM s GROUP BY ALL), e AS (SELECT *, sum(x) OVER (PARTITION BY model ORDER BY ts) AS eq FROM d), k AS (SELECT *, max(eq) OVER (PARTITION BY model ORDER BY ts) AS pk FROM e),
dd AS (SELECT model, min(eq - pk) AS max_drawdown FROM k GROUP BY model)
SELECT s.model, count(*) FILTER (sg <> 0) AS trades, {R('avg(sg * target_change) FILTER (sg <> 0)', 8)} AS mean_trade, {R('sum(sg * target_change)')} AS total, {R('avg(sg * target_change) FILTER (sg <> 0) / stddev_samp(sg * target_change) FILTER (sg <> 0)')} AS mean_to_std,
 {R('avg(CASE WHEN sg * target_change > 0 THEN 1e0 ELSE 0e0 END) FILTER (sg <> 0)')} AS win_rate, {R('any_value(max_drawdown)')} AS max_drawdown FROM s JOIN dd ON dd.model = s.model GROUP BY s.model""")
def _(t):
    d = samples(t).withColumns({"pred_class": T.baseline_rule(), "model": F.when(c("i") % 2 == 0, "even").otherwise("odd")})
    return rounded(rounded(M.trading_scores(d), "total", "mean_to_std", "win_rate", "max_drawdown"), "mean_trade", digits=8)


@query("bt29_regime_filter", "SELECT pair, ts, CASE WHEN abs(spread_diff_1) < 5e-2 THEN CASE WHEN abs(spread_z) >= 15e-1 THEN 0 ELSE 1 END ELSE 1 END AS pred_class FROM v_ready")
def _(t):
    d = ready(t).withColumns({"pred_class": T.baseline_rule("spread_z"), "mean_reverting_state": F.abs("spread_diff_1") < 0.05})
    return M.mask_regime(d).select("pair", "ts", "pred_class")


@query("ml8_combine_results", "SELECT 'rule' AS model, pair, ts, CASE WHEN abs(spread_z) >= 15e-1 THEN 0 ELSE 1 END AS pred_class FROM v_samples UNION ALL SELECT 'persist', pair, ts, 1 FROM v_samples")
def _(t):
    s = samples(t)
    a = s.select(F.lit("rule").alias("model"), "pair", "ts", T.baseline_rule().alias("pred_class"))
    return a.unionByName(M.persist_class(s.select(F.lit("persist").alias("model"), "pair", "ts")))


# ---- walk-forward selection and simulation -----------------------------------------------------------------

@query("st11_ou_selection", f"SELECT split_id, pair, {R('alpha')} AS alpha, {R('beta')} AS beta, {R('sd')} AS sd, {R('half_life', 4)} AS half_life, {R('resid_ratio')} AS resid_ratio, rank FROM v_ou")
def _(t):
    d = rounded(rounded(picks(t), "alpha", "beta", "sd", "resid_ratio"), "half_life", digits=4)
    return d.select("split_id", "pair", "alpha", "beta", "sd", "half_life", "resid_ratio", "rank")


@query("sur5_random_selection", f"SELECT split_id, pair, {R('beta')} AS beta, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY split_id ORDER BY md5(pair || '|7|' || CAST(split_id AS VARCHAR))) AS INTEGER) AS rank FROM v_wfit WHERE n >= 365 * 9e-1 AND sd > 0) WHERE rank <= 5")
def _(t):
    return rounded(P.select_random(daily_panel(t), wins(t), 5, 7), "beta").select("split_id", "pair", "beta", "rank")


@query("st15_rolling_hedge", f"""WITH h AS (SELECT pair, ts, i, la, lb, CASE WHEN count(lb) OVER p >= 60 THEN covar_pop(la, lb) OVER p / nullif(var_pop(lb) OVER p, 0e0) END AS b, avg(la) OVER p AS ma, avg(lb) OVER p AS mb FROM v_spread WINDOW p AS (PARTITION BY pair ORDER BY i ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, la - (ma - b * mb) - b * lb AS sp FROM h)
SELECT pair, ts, {R('b')} AS beta_r, {R('CASE WHEN count(sp) OVER p >= 60 THEN (sp - avg(sp) OVER p) / nullif(stddev_samp(sp) OVER p, 0e0) END', 5)} AS z_r FROM s WINDOW p AS (PARTITION BY pair ORDER BY i ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)""")
def _(t):
    d = W.rolling_hedge(spreads(t), 120, 60)
    return d.select("pair", "ts", rnd("beta_r").alias("beta_r"), rnd("z_r", 5).alias("z_r"))


@query("bt7_recentred_z", f"SELECT split_id, pair, i, {R('CASE WHEN count(spread) OVER w >= 20 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0e0) END', 5)} AS z FROM v_walk WINDOW w AS (PARTITION BY split_id, pair ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)")
def _(t):
    return W.recentred(walk(t), 40, 20).select("split_id", "pair", "i", rnd("z", 5).alias("z"))


def _fold_sql(exit_cond: str, hold: str) -> str:
    enter = "CASE WHEN abs(z) >= stop THEN 0 WHEN z >= 2 THEN -1 WHEN z <= -2 THEN 1 ELSE 0 END"
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT split_id, pair, i, z, {hold} AS cap, row_number() OVER (PARTITION BY split_id, pair ORDER BY i) AS rn FROM v_walk), st AS (SELECT 6e0 AS stop),
rec AS (SELECT split_id, pair, rn, {enter} AS pos, 1 AS hold FROM base, st WHERE rn = 1
UNION ALL SELECT b.split_id, b.pair, b.rn, CASE WHEN r.pos = 0 THEN {enter} WHEN abs(z) >= stop OR {exit_cond} THEN 0 ELSE r.pos END, CASE WHEN r.pos = 0 THEN 1 ELSE r.hold + 1 END
FROM rec r JOIN base b ON b.split_id = r.split_id AND b.pair = r.pair AND b.rn = r.rn + 1, st)
SELECT base.split_id, base.pair, base.i, CAST(rec.pos AS DOUBLE) AS position FROM rec JOIN base ON base.split_id = rec.split_id AND base.pair = rec.pair AND base.rn = rec.rn"""


def _variant(t, name, mode, hold):
    d = W.with_variants(walk(t), [(name, mode, 6.0, hold)])
    return T.exit_variants(d, W.KEYS).select("split_id", "pair", "i", (c("position") + F.lit(0.0)).alias("position"))


@query("bt8_exit_on_convergence", _fold_sql("sign(z) <> -r.pos OR r.hold + 1 >= cap", "1000"))
def _(t):
    return _variant(t, "conv", "conv", 1000)


@query("bt8_exit_on_time", _fold_sql("r.hold + 1 >= cap", "greatest(2, round(2 * half_life))"))
def _(t):
    return _variant(t, "time", "time", 0)


@query("bt9_vol_target", f"""WITH v AS (SELECT *, CASE WHEN count(sr) OVER p >= 10 THEN stddev_samp(sr) OVER p END AS v FROM v_walk WINDOW p AS (PARTITION BY split_id, pair ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
m AS (SELECT split_id, pair, median(v) AS m FROM v GROUP BY 1, 2) SELECT v.split_id, v.pair, v.i, {R('least(greatest(coalesce(m / nullif(v, 0e0), 1e0), 0e0), 5e0)', 5)} AS size FROM v JOIN m ON m.split_id = v.split_id AND m.pair = v.pair""")
def _(t):
    return W.vol_target(walk(t), 30, 10).select("split_id", "pair", "i", rnd("size", 5).alias("size"))


_BREAK_ON = f"abs(b.z) > 5e-1 AND ((CASE WHEN r.held > 0 THEN b.la - r.a0 ELSE b.lb - r.b0 END) < -least({-math.log1p(-0.2)!r}, {-math.log1p(-0.3)!r}) OR (CASE WHEN r.held > 0 THEN b.lb - r.b0 ELSE b.la - r.a0 END) > {-math.log1p(-0.3)!r} OR r.gain + r.held * b.sr < -15e-2)"


@query("bt10_break_stops", f"""WITH RECURSIVE base AS MATERIALIZED (SELECT split_id, pair, i, z, la, lb, sr, row_number() OVER (PARTITION BY split_id, pair ORDER BY i) AS rn FROM v_walk),
rec AS (SELECT split_id, pair, rn, CASE WHEN abs(z) >= 2 THEN -sign(z) ELSE 0e0 END AS held, la AS a0, lb AS b0, 0e0 AS gain, false AS halted FROM base WHERE rn = 1
UNION ALL SELECT b.split_id, b.pair, b.rn, CASE WHEN r.held <> 0 THEN CASE WHEN abs(b.z) <= 5e-1 OR ({_BREAK_ON}) THEN 0e0 ELSE r.held END WHEN NOT r.halted AND abs(b.z) >= 2 THEN -sign(b.z) ELSE 0e0 END,
 CASE WHEN r.held = 0 THEN b.la ELSE r.a0 END, CASE WHEN r.held = 0 THEN b.lb ELSE r.b0 END, CASE WHEN r.held = 0 THEN 0e0 ELSE r.gain + r.held * b.sr END, r.halted OR (r.held <> 0 AND ({_BREAK_ON}))
 FROM rec r JOIN base b ON b.split_id = r.split_id AND b.pair = r.pair AND b.rn = r.rn + 1),
u AS (SELECT rec.split_id, rec.pair, held AS position, sr, coalesce(lag(held) OVER (PARTITION BY rec.split_id, rec.pair ORDER BY rec.rn), 0e0) AS h FROM rec JOIN base ON base.split_id = rec.split_id AND base.pair = rec.pair AND base.rn = rec.rn)
SELECT split_id, pair, {R('sum(h * sr - abs(position - h) * 2e0 * 15e0 / 1e4)', 8)} AS net, count(*) FILTER (abs(position - h) > 0) AS changes FROM u GROUP BY split_id, pair""")
def _(t):
    d = T.break_stops(walk(t), W.KEYS, crash=0.2, adverse=0.3, loss=0.15, halt=True)
    return T.unit_pnl(d, 15.0, W.KEYS).groupBy("split_id", "pair").agg(rnd(F.sum("net"), 8).alias("net"), F.count_if(c("dpos") > 0).alias("changes"))


_SLIP = f"""greatest(CASE side WHEN 'buy' THEN 1 ELSE -1 END * ((usd + greatest(q - usd, 0e0)) / (base + greatest(q - usd, 0e0) / last) - mid) / mid * 1e4, 0e0)"""
_BOOKED = f"""WITH hl AS MATERIALIZED (SELECT p.pair, p.sym_a, p.sym_b, p.beta, a.ts, a.close AS ca, b.close AS cb, ln(a.close) - p.beta * ln(b.close) AS spread FROM v_legs p JOIN v_bars_1h a ON a.symbol = p.sym_a JOIN v_bars_1h b ON b.symbol = p.sym_b AND a.ts = b.ts),
hz AS (SELECT *, CASE WHEN count(spread) OVER w >= 24 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0e0) END AS z FROM hl WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
hx AS (SELECT *, (z IS NULL OR abs(z) <= 5e-1 OR abs(z) >= 4) AS x FROM hz),
hg AS (SELECT *, sum(CASE WHEN x THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY ts) AS g, CASE WHEN x THEN NULL WHEN z >= 2 THEN -1e0 WHEN z <= -2 THEN 1e0 END AS e FROM hx),
hp AS (SELECT *, coalesce(first_value(e IGNORE NULLS) OVER (PARTITION BY pair, g ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS signal FROM hg),
hh AS MATERIALIZED (SELECT *, coalesce(lag(signal) OVER w, 0e0) AS held, coalesce(ca / lag(ca) OVER w - 1, 0e0) AS ret_a, coalesce(cb / lag(cb) OVER w - 1, 0e0) AS ret_b FROM hp WINDOW w AS (PARTITION BY pair ORDER BY ts)),
ho AS (SELECT pair, ts, 'a' AS leg, sym_a AS symbol, CASE WHEN signal >= held THEN 'buy' ELSE 'sell' END AS side, abs(signal - held) * 1e4 AS q FROM hh WHERE signal <> held
 UNION ALL SELECT pair, ts, 'b', sym_b, CASE WHEN signal >= held THEN 'sell' ELSE 'buy' END, abs(signal - held) * 1e4 * abs(beta) FROM hh WHERE signal <> held),
hb AS (SELECT o.*, b.* EXCLUDE (symbol, ts, seq) FROM ho o ASOF JOIN v_book b ON o.symbol = b.symbol AND o.ts >= b.ts),
hw AS (SELECT pair, ts, leg, {_SLIP} AS bps FROM (SELECT *, CASE WHEN side = 'buy' THEN {_WU} ELSE {_WUB} END AS usd, CASE WHEN side = 'buy' THEN {_WB} ELSE {_WBB} END AS base,
 CASE WHEN side = 'buy' THEN ask_px_10 ELSE bid_px_10 END AS last, (bid_px_1 + ask_px_1) / 2e0 AS mid FROM hb)),
hs AS (SELECT pair, ts, max(bps) FILTER (leg = 'a') AS sa, max(bps) FILTER (leg = 'b') AS sb FROM hw GROUP BY ALL),
hc AS (SELECT *, na + nb AS turnover, (na * (5 + coalesce(sa, 2e0)) + nb * (5 + coalesce(sb, 2e0))) / 1e4 AS cost FROM (SELECT hh.*, sa, sb, abs(signal - held) * 1e4 AS na, abs(signal - held) * 1e4 * abs(beta) AS nb FROM hh LEFT JOIN hs ON hs.pair = hh.pair AND hs.ts = hh.ts))"""


def booked(t):
    """Trades of every pair on hourly bars, by the causal z of its spread, with book-walk costs per leg and the flat fallback."""
    from ..operators import book as K
    from ..core.ordered import HOUR_US
    d = B.pair_legs(t.bars_1h.select("symbol", "ts", "close"), tape_pairs(t), "ts").withColumns({"i": N.bar_index("ts", HOUR_US), "spread": F.log("close_a") - c("beta") * F.log("close_b")})
    d = t.store("hourly_signals", lambda: T.hysteresis(V.causal_z(d, ["pair"], 24), "z", ["pair"], out="signal"))
    base = T.pair_pnl(d, T.Costs())
    side = F.when(c("signal") >= c("held"), "buy").otherwise("sell")
    q = F.abs(c("signal") - c("held")) * 1e4
    legs = base.where(c("signal") != c("held")).select("pair", "ts", "i", F.explode(F.array(
        F.struct(c("sym_a").alias("symbol"), side.alias("side"), q.alias("q"), F.lit("a").alias("leg")),
        F.struct(c("sym_b").alias("symbol"), F.when(side == "buy", "sell").otherwise("buy").alias("side"), (q * F.abs("beta")).alias("q"), F.lit("b").alias("leg")))).alias("s")).select("pair", "ts", "i", "s.*")
    w = K.book_at(legs.withColumn("lid", F.xxhash64("pair", "i", "leg")), t.book, K.book_columns(), "lid").withColumn("bps", K.slippage_bps(c("q"), c("side")))
    s = w.groupBy("pair", "i").agg(F.max(F.when(c("leg") == "a", c("bps"))).alias("sa"), F.max(F.when(c("leg") == "b", c("bps"))).alias("sb"))
    return T.pair_pnl(d.join(s, ["pair", "i"], "left"), T.Costs(), slip_a=F.coalesce("sa", F.lit(2.0)), slip_b=F.coalesce("sb", F.lit(2.0)))


@query("bt14_book_costs", _BOOKED + f" SELECT pair, ts, signal, turnover, {R('cost', 5)} AS cost, {R('held * 1e4 * (ret_a - beta * ret_b) - cost', 5)} AS pnl FROM hc")
def _(t):
    return booked(t).select("pair", "ts", (c("signal") + F.lit(0.0)).alias("signal"), "turnover", rnd("cost", 5).alias("cost"), rnd("pnl", 5).alias("pnl"))


@query("bt22_walk_forward", f"SELECT ts, split_id, {R('pnl', 8)} AS pnl, {R('gross', 8)} AS gross FROM v_wport")
def _(t):
    return rounded(W.stitched(unit(t)).drop("i"), "pnl", "gross", digits=8)


@query("bt22_strategy_summary", f"""WITH s AS (SELECT *, CASE WHEN position <> 0 AND coalesce(lag(position) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st FROM v_wunit WINDOW w AS (PARTITION BY split_id, pair ORDER BY i)),
g AS (SELECT *, sum(st) OVER (PARTITION BY split_id, pair ORDER BY i) AS trip FROM s), rt AS (SELECT split_id, pair, trip, sum(net) AS x FROM g WHERE position <> 0 GROUP BY ALL)
SELECT {R('(SELECT sum(pnl) FROM v_wport)')} AS net_pnl, (SELECT count(*) FROM v_wport) AS bars, count(*) FILTER (dpos > 0) AS trades, sum(dpos) AS turnover, (SELECT count(*) FROM rt) AS trips, {R('(SELECT count(*) FILTER (x > 0) * 1e0 / count(*) FROM rt)')} AS win_rate FROM v_wunit""")
def _(t):
    return rounded(W.strategy_summary(unit(t)), "net_pnl", "win_rate").select("net_pnl", "bars", "trades", "turnover", "trips", "win_rate")


VARIANTS = [("z_stop4", "z", 4, 1e9), ("z_stop6", "z", 6, 1e9), ("z_nostop", "z", math.inf, 1e9), ("conv", "conv", 4, 1000), ("conv_nostop", "conv", math.inf, 1000), ("time", "time", math.inf, 0)]


_VARIANT_ROWS = ", ".join(f"('{n}', '{m}', {'1e300' if math.isinf(s) else f'{s:.1e}'}, {h:.1e})" for n, m, s, h in VARIANTS)
_ENTER = "CASE WHEN abs({0}z) >= 2 AND abs({0}z) < {0}stop THEN -sign({0}z) ELSE 0e0 END"


@query("bt23_variant_matrix", f"""WITH RECURSIVE base AS MATERIALIZED (SELECT variant, mode, stop, CASE WHEN hold = 0 THEN greatest(2, round(2 * half_life)) ELSE hold END AS cap, split_id, pair, ts, i, z, sr, row_number() OVER (PARTITION BY variant, split_id, pair ORDER BY i) AS rn
 FROM v_walk, (VALUES {_VARIANT_ROWS}) AS v(variant, mode, stop, hold)),
rec AS (SELECT variant, split_id, pair, rn, {_ENTER.format('')} AS pos, 1 AS age FROM base WHERE rn = 1
UNION ALL SELECT b.variant, b.split_id, b.pair, b.rn, CASE WHEN r.pos = 0 THEN {_ENTER.format('b.')} WHEN abs(b.z) >= b.stop OR (mode = 'z' AND abs(b.z) <= 5e-1) OR (mode = 'time' AND r.age + 1 >= cap) OR (mode = 'conv' AND (sign(b.z) <> -r.pos OR r.age + 1 >= cap)) THEN 0e0 ELSE r.pos END,
 CASE WHEN r.pos = 0 THEN 1 ELSE r.age + 1 END FROM rec r JOIN base b ON b.variant = r.variant AND b.split_id = r.split_id AND b.pair = r.pair AND b.rn = r.rn + 1),
h AS (SELECT b.variant, b.split_id, b.pair, b.ts, b.i, b.sr, pos, coalesce(lag(pos) OVER w, 0e0) AS held FROM rec JOIN base b ON b.variant = rec.variant AND b.split_id = rec.split_id AND b.pair = rec.pair AND b.rn = rec.rn WINDOW w AS (PARTITION BY b.variant, b.split_id, b.pair ORDER BY b.rn)),
u AS (SELECT *, held * sr AS gross, abs(pos - held) AS dpos, held * sr - abs(pos - held) * 2e0 * 15e0 / 1e4 AS net, CASE WHEN pos <> 0 AND held = 0 THEN 1 ELSE 0 END AS st FROM h),
port AS (SELECT variant, split_id, ts, i, avg(net) AS pnl, avg(gross) AS gross FROM u GROUP BY ALL), one AS (SELECT * FROM port QUALIFY row_number() OVER (PARTITION BY variant, ts ORDER BY split_id) = 1),
g AS (SELECT *, sum(st) OVER (PARTITION BY variant, split_id, pair ORDER BY i) AS trip FROM u), rt AS (SELECT variant, split_id, pair, trip, sum(net) AS x FROM g WHERE pos <> 0 GROUP BY ALL)
SELECT p.variant, {R('any_value(p.net_pnl)')} AS net_pnl, {R('any_value(p.gross_pnl)')} AS gross_pnl, any_value(p.bars) AS bars, any_value(t.trades) AS trades, any_value(t.turnover) AS turnover, count(*) FILTER (x > 0) AS wins, count(*) AS trips, {R('count(*) FILTER (x > 0) * 1e0 / count(*)')} AS win_rate
 FROM (SELECT variant, sum(pnl) AS net_pnl, sum(gross) AS gross_pnl, count(*) AS bars FROM one GROUP BY variant) p JOIN (SELECT variant, count(*) FILTER (dpos > 0) AS trades, sum(dpos) AS turnover FROM u GROUP BY variant) t ON t.variant = p.variant JOIN rt ON rt.variant = p.variant GROUP BY p.variant""")
def _(t):
    k = ["variant", *W.KEYS]
    d = T.exit_variants(W.with_variants(walk(t), VARIANTS), k)
    s = W.strategy_summary(T.unit_pnl(d, 15.0, k), ["variant"])
    return rounded(s, "net_pnl", "gross_pnl", "win_rate").select("variant", "net_pnl", "gross_pnl", "bars", "trades", "turnover", "wins", "trips", "win_rate")


@query("bt24_window_returns", f"SELECT split_id, {R('sum(pnl)', 8)} AS ret, count(*) AS bars FROM v_wport GROUP BY split_id")
def _(t):
    return rounded(W.window_returns(unit(t)), "ret", digits=8)


_WR = "WITH r AS (SELECT split_id, sum(pnl) AS x FROM v_wport GROUP BY split_id)"


@query("inr19_sign_and_t", _WR + f", k AS (SELECT count(*) AS n, count(*) FILTER (x > 0) AS k, avg(x) AS m, stddev_samp(x) AS s FROM r) SELECT n, k, {R('m / (s / sqrt(n))')} AS t, {R('(SELECT least(1e0, 2 * sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2e0)))) FROM range(1000000) u(j) WHERE j <= n AND ((2 * k >= n AND j >= k) OR (2 * k < n AND j <= k)))')} AS p_sign FROM k")
def _(t):
    g = W.window_returns(unit(t)).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("ret") > 0).alias("k"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return g.select("n", "k", rnd(I.t_stat(c("m"), c("s"), c("n"))).alias("t"), rnd(I.sign_test_p(c("k"), c("n"))).alias("p_sign"))


@query("bt28_entry_sanity", f"""WITH p AS (SELECT split_id, pair, position, coalesce(lag(position) OVER w, 0) AS pp, lead(spread, 5) OVER w - spread AS fwd FROM (SELECT p.*, s.spread AS s2 FROM v_wpos p JOIN v_walk s ON s.split_id = p.split_id AND s.pair = p.pair AND s.i = p.i) WINDOW w AS (PARTITION BY split_id, pair ORDER BY i))
SELECT CASE WHEN position <> 0 AND pp = 0 THEN 'entry' WHEN position = 0 AND pp <> 0 THEN 'exit' ELSE 'other' END AS kind, count(fwd) AS n, {R('avg(fwd * CASE WHEN position <> 0 THEN position ELSE pp END)', 8)} AS signed_fwd FROM p GROUP BY 1""")
def _(t):
    d = T.hysteresis(walk(t), "z", W.KEYS)
    w = T.order_window(W.KEYS)
    d = d.withColumns({"pp": F.coalesce(F.lag("position").over(w), F.lit(0.0)), "fwd": F.lead("spread", 5).over(w) - c("spread")})
    kind = F.when((c("position") != 0) & (c("pp") == 0), "entry").when((c("position") == 0) & (c("pp") != 0), "exit").otherwise("other")
    side = F.when(c("position") != 0, c("position")).otherwise(c("pp"))
    return d.groupBy(kind.alias("kind")).agg(F.count("fwd").alias("n"), rnd(F.avg(c("fwd") * side), 8).alias("signed_fwd"))


@query("bt30_concentration", f"WITH g AS (SELECT pair, sum(net) AS p FROM v_wunit GROUP BY pair), b AS (SELECT p FROM g ORDER BY p DESC, pair LIMIT 3) SELECT {R('(SELECT sum(p) FROM g)')} AS total, {R('(SELECT max(p) FROM b) / (SELECT sum(p) FROM g)')} AS top1_share, {R('(SELECT sum(p) FROM b) / (SELECT sum(p) FROM g)')} AS topk_share")
def _(t):
    return rounded(W.concentration(unit(t))[0], "total", "top1_share", "topk_share")


@query("bt26_forced_collapse")
def _(t):
    p = daily_panel(t)
    drops = W.worst_drop(p, 7)
    partners = pair_legs(t).select("pair", "sym_a", "sym_b").distinct()
    d = W.collapse_rows(p, drops, partners, 180, 60)
    u = T.unit_pnl(T.hysteresis(d, "z", ["pair"], stop=None), 15.0)
    return u.groupBy("pair").agg(rnd(F.sum("net"), 8).alias("net"), F.count_if(c("dpos") > 0).alias("changes"), F.count(F.lit(1)).alias("bars"))


# ---- inference on the stitched series ------------------------------------------------------------------------

_LAG = "greatest(1, CAST(floor(4 * pow(n / 100e0, 2 / 9e0)) AS INTEGER))"
_G = ", ".join(f"avg(x * l{j}) AS q{j}" for j in range(1, 41))
_L = ", ".join(f"lag(x, {j}) OVER (ORDER BY i) AS l{j}" for j in range(1, 41))
_INF = " + ".join(f"CASE WHEN {j} <= lag THEN 2 * (1 - {j} / (lag + 1e0)) * q{j} ELSE 0 END" for j in range(1, 41))


@query("inr4_sharpe_hac_se", f"""WITH m AS (SELECT count(*) AS n, avg(pnl) AS mu, stddev_samp(pnl) AS sd, var_pop(pnl) AS g0 FROM v_wport), x AS (SELECT i, pnl - mu AS x FROM v_wport, m), l AS (SELECT x, {_L} FROM x), g AS (SELECT {_G} FROM l),
h AS (SELECT m.*, {_LAG} AS lag, g.* FROM m, g), k AS (SELECT *, (g0 + {_INF}) / g0 AS infl FROM h)
SELECT n, lag, {R('mu / sd * sqrt(365e0)')} AS sharpe_ann, {R('sqrt((1 + 5e-1 * (mu / sd) ** 2) * infl / n) * sqrt(365e0)')} AS se_ann, {R('infl')} AS inflation FROM k""")
def _(t):
    d = W.stitched(unit(t)).withColumn("k", F.lit("all"))
    return rounded(I.sharpe_with_se(d, ["k"], "pnl", 365.0).drop("k"), "sharpe_ann", "se_ann", "inflation")


@query("inr5_deflated_sharpe")
def _(t):
    k = ["variant", *W.KEYS]
    u = T.unit_pnl(T.exit_variants(W.with_variants(walk(t), VARIANTS), k), 15.0, k)
    g = W.stitched(u, ["variant"]).groupBy("variant").agg(I.sharpe("pnl", 1.0).alias("sr"), F.skewness("pnl").alias("skew"), (F.kurtosis("pnl") + 3).alias("kurt"), F.count(F.lit(1)).alias("n"))
    return I.deflated_sharpe(g)


@query("inr5_moments", f"""WITH m AS (SELECT split_id, avg(pnl) AS mu, stddev_pop(pnl) AS sp, stddev_samp(pnl) AS sd FROM v_wport GROUP BY split_id HAVING stddev_pop(pnl) > 0)
SELECT p.split_id, {R('any_value(mu / sd)')} AS sr, {R('avg(((pnl - mu) / sp) ** 3)')} AS skew, {R('avg(((pnl - mu) / sp) ** 4)')} AS kurt, count(*) AS n FROM v_wport p JOIN m ON m.split_id = p.split_id GROUP BY p.split_id""")
def _(t):
    g = W.stitched(unit(t)).groupBy("split_id").agg(F.avg("pnl").alias("_m"), F.stddev_samp("pnl").alias("_s"), F.skewness("pnl").alias("skew"), (F.kurtosis("pnl") + 3).alias("kurt"), F.count(F.lit(1)).alias("n"))
    g = g.where("_s > 0").withColumn("sr", c("_m") / c("_s"))
    return rounded(g, "sr", "skew", "kurt").select("split_id", "sr", "skew", "kurt", "n")


def _blocks_sql(kind, span, stat, point, wrap):
    return f"""(SELECT '{kind}' AS kind, (SELECT {point} FROM v_wport) AS point, (SELECT count(*) FROM v_wport) AS n, quantile_cont(st, 25e-3) AS lo, quantile_cont(st, 975e-3) AS hi, stddev_samp(st) AS se, count(st) AS reps FROM (
 SELECT rep, CASE WHEN '{stat}' = 'mean' THEN sum(s) / (count(*) * 20) ELSE coalesce(sum(s) / (count(*) * 20) / nullif(sqrt(greatest((sum(q) - sum(s) * sum(s) / (count(*) * 20)) / (count(*) * 20 - 1), 0e0)), 0e0) * sqrt(365e0), 0e0) END AS st
 FROM (SELECT rep, CAST(floor({U("rep || '|' || d || '|5'")} * ({span})) AS BIGINT) AS p FROM range(1, 501) r(rep), range(1, 100000) v(d), (SELECT count(*) AS n FROM v_wport) m WHERE d <= ceil(n / 20e0)) dr
 JOIN (SELECT p, n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, count(x) OVER w AS c FROM {wrap} WINDOW w AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) st USING (p) WHERE st.p < st.n AND st.c = 20 GROUP BY rep))"""


_BB = "WITH z AS (SELECT i - min(i) OVER () AS p, pnl AS x, count(*) OVER () AS n FROM v_wport), zz AS (SELECT * FROM z UNION ALL SELECT p + n, x, n FROM z WHERE p < 19), o AS (" + _blocks_sql(
    "circular mean", "n", "mean", "avg(pnl)", "zz") + " UNION ALL " + _blocks_sql("moving sharpe", "n - 19", "sharpe", "coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0e0) * sqrt(365e0), 0e0)", "z") + f""")
SELECT kind, {R('point')} AS point, n, {R('lo')} AS lo, {R('hi')} AS hi, {R('se')} AS se, reps FROM o"""


@query("inr6_block_bootstrap", _BB)
def _(t):
    p = W.stitched(unit(t)).select("i", "pnl")
    a = I.block_bootstrap(p, "pnl", 20, 500, 5).withColumn("kind", F.lit("circular mean"))
    a = a.unionByName(I.block_bootstrap(p, "pnl", 20, 500, 5, "sharpe", per_year=365.0, circular=False).withColumn("kind", F.lit("moving sharpe")))
    return rounded(a, "point", "lo", "hi", "se")


@query("inr7_market_beta", f"""WITH m AS (SELECT i, avg(r) AS x FROM (SELECT i, lp - lag(lp) OVER (PARTITION BY symbol ORDER BY i) AS r FROM v_panel) WHERE r IS NOT NULL GROUP BY i)
SELECT {R('covar_samp(p.pnl, m.x) / var_pop(m.x)', 8)} AS beta, {R('avg(p.pnl) - covar_samp(p.pnl, m.x) / var_pop(m.x) * avg(m.x)', 9)} AS alpha, {R('corr(m.x, p.pnl)')} AS corr, count(*) AS n FROM v_wport p JOIN m ON m.i = p.i""")
def _(t):
    p = daily_panel(t)
    prev = p.select("symbol", (c("i") + 1).alias("i"), c("lp").alias("_p"))
    m = p.join(prev, ["symbol", "i"]).groupBy("i").agg(F.avg(c("lp") - c("_p")).alias("x"))
    d = I.market_beta(W.stitched(unit(t)).join(m, "i"), "pnl", "x")
    return rounded(rounded(rounded(d, "beta", digits=8), "alpha", digits=9), "corr")


@query("inr8_cluster_bootstrap", _EV + f""", s AS (SELECT e.pair, sum(-sign(e.z) * (e.z1 - e.z)) AS s, count(*) AS n FROM rec JOIN e ON e.pair = rec.pair AND e.i = rec.i GROUP BY e.pair),
k AS (SELECT *, row_number() OVER (ORDER BY pair) - 1 AS k, count(*) OVER () AS m FROM s), d AS (SELECT rep, CAST(floor({U("rep || '|' || k || '|3'")} * m) AS BIGINT) AS pick FROM k, range(1, 1001) r(rep)),
b AS (SELECT rep, sum(k.s) / sum(k.n) AS stat FROM d JOIN k ON k.k = d.pick GROUP BY rep)
SELECT (SELECT {R('sum(s) / sum(n)')} FROM s) AS point, (SELECT count(*) FROM s) AS n_clusters, {R('quantile_cont(stat, 25e-3)')} AS lo, {R('quantile_cont(stat, 975e-3)')} AS hi, {R('stddev_samp(stat)')} AS se,
 {R('2 * least(avg(CAST(stat <= 0 AS DOUBLE)), avg(CAST(stat >= 0 AS DOUBLE)))')} AS p FROM b""")
def _(t):
    s = events(t).groupBy("pair").agg(F.sum("reversion").alias("s"), F.count(F.lit(1)).alias("n"))
    return rounded(I.cluster_bootstrap(s, "pair", 1000, 3), "point", "lo", "hi", "se", "p")


@query("inr21_cost_saving", _BOOKED + f" SELECT pair, {R('sum(turnover) * 7 / 1e4', 4)} AS flat_cost, {R('sum(cost)', 4)} AS book_cost, {R('sum(turnover) * 7 / 1e4 - sum(cost)', 4)} AS saving FROM hc GROUP BY pair")
def _(t):
    """Costs of the same trades at the flat slippage and by walking the book."""
    flat = T.Costs()
    g = booked(t).groupBy("pair").agg((F.sum("turnover") * (flat.taker_fee_bps + flat.slippage_bps) / 1e4).alias("flat_cost"), F.sum("cost").alias("book_cost"))
    return rounded(g.withColumn("saving", c("flat_cost") - c("book_cost")), "flat_cost", "book_cost", "saving", digits=4)


@query("inr20_factor_r2")
def _(t):
    from ..operators.screens import return_pca
    p = daily_panel(t)
    prev = p.select("symbol", (c("i") + 1).alias("i"), c("lp").alias("_p"))
    _load, sc = return_pca(p.join(prev, ["symbol", "i"]).select("symbol", "i", (c("lp") - c("_p")).alias("r")))
    d = sc.join(W.stitched(unit(t)).select("i", "pnl"), "i")
    return d.groupBy("pc").agg(rnd(I.safe_corr("score", "pnl") * I.safe_corr("score", "pnl"), 8).alias("r2"), F.count(F.lit(1)).alias("n"))


@query("src20_feature_store", "SELECT pair, count(*) AS n FROM v_ready GROUP BY pair HAVING count(*) >= 200")
def _(t):
    from ..sources import lake as L
    path = L.scratch_folder(t.spark)
    L.write_store(ready(t), path, by=("pair",))
    return t.spark.read.parquet(path).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("src21_dataset_sink", "SELECT pair, y_class, count(*) AS n, 32 AS steps FROM v_samples GROUP BY pair, y_class")
def _(t):
    from ..sources import lake as L
    path = L.scratch_folder(t.spark)
    L.write_store(X.samples(ready(t), SCFG, sequences=True), path, by=("pair",))
    L.write_receipt(t.spark, path + "_config", {"window": SCFG.window})
    return t.spark.read.parquet(path).groupBy("pair", "y_class").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("sequence")).alias("steps"))


@query("src22_result_tables", f"SELECT split_id, {R('sum(pnl)', 8)} AS ret FROM v_wport GROUP BY split_id")
def _(t):
    from ..sources import lake as L
    path = L.scratch_folder(t.spark)
    L.write_result(rounded(W.window_returns(unit(t)), "ret", digits=8).select("split_id", "ret"), path, "csv")
    return t.spark.read.option("header", True).schema("split_id int, ret double").csv(path)
