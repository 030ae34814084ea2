"""Unit-root and dynamic-hedge screens, placebos, stress runs, models (ST8-24, SUR, EV3, EV9, BT25, BT27, ML3-7, PF10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.ordered import DAY_US, block_window, core_rows, halo_blocks
from ..operators import backtest as T, controls as C, events as V, features as X, inference as I, ml as M, pairs as P, panel as N, regimes as G, screens as S, walk as W
from .base_tables import daily_panel, pair_legs, selected_pairs, spreads
from .registry import query, rnd, rnd_sql as R, rounded, unit_sql as U
from .t1_sources import windows
from .t3_pairs import FCFG, ready
from .t5_walk import _EV, _SEL, events, picks, samples, tagged, unit, walk, wins

c = F.col
CUT = "2000-01-01"
HELD_FROM = "1996-01-01"


@query("st8_adf")
def _(t):
    return S.adf(spreads(t), ["pair"], "spread")


@query("st12_engle_granger")
def _(t):
    return S.engle_granger(spreads(t))


@query("st13_static_oos_test")
def _(t):
    legs = spreads(t)
    cut = F.lit(CUT).cast("timestamp")
    f = legs.where(c("ts") < cut).groupBy("pair").agg(F.regr_intercept("la", "lb").alias("_a"), F.regr_slope("la", "lb").alias("_b"))
    return S.adf(legs.where(c("ts") >= cut).join(f, "pair").withColumn("r", c("la") - c("_a") - c("_b") * c("lb")), ["pair"], "r")


@query("st9_full_score")
def _(t):
    """All five parts of the composite score, the unit-root statistic included."""
    fit = P.score_candidates(P.pair_moments(daily_panel(t)), 0.2)
    legs = P.pair_legs(daily_panel(t), fit.select("pair", "sym_a", "sym_b", "alpha", "beta"), ["lp"])
    d = (fit.join(P.beta_segments(legs, 4), "pair").join(S.adf(P.static_spread(legs), ["pair"], "spread").drop("n"), "pair")
         .withColumn("half_life_hours", P.half_life_ar(c("ar_b"))).where("half_life_hours IS NOT NULL"))
    parts = {"adf": (0.40, -c("adf_stat")), "hl": (0.25, -F.abs(F.log(c("half_life_hours") / 48.0))), "vol": (0.20, c("spread_vol")),
             "stab": (0.10, -c("beta_instability")), "corr": (0.05, c("corr"))}
    return P.composite_score(d, parts).select("pair", "sym_a", "sym_b", "corr", "alpha", c("beta").alias("beta_a_on_b"), "beta_instability", "spread_vol",
                                              "adf_stat", "adf_pvalue", "half_life_hours", "score").orderBy(c("score").desc())


@query("st16_ljung_box")
def _(t):
    return S.ljung_box(spreads(t), ["pair"], "spread", 20)


_STEP = """SELECT b.pair, b.rn, b.i, r.al + (r.p0 + 1e-7 + b.x * r.pc) / s * d AS al, r.be + (r.pc + b.x * (r.p1 + 1e-5)) / s * d AS be,
 r.p0 + 1e-7 - (r.p0 + 1e-7 + b.x * r.pc) * (r.p0 + 1e-7 + b.x * r.pc) / s AS p0, r.pc - (r.p0 + 1e-7 + b.x * r.pc) * (r.pc + b.x * (r.p1 + 1e-5)) / s AS pc, r.p1 + 1e-5 - (r.pc + b.x * (r.p1 + 1e-5)) * (r.pc + b.x * (r.p1 + 1e-5)) / s AS p1, d AS e"""


@query("st17_dynamic_hedge", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT pair, regr_intercept(la, lb) AS al, regr_slope(la, lb) AS be FROM v_spread GROUP BY pair),
n AS MATERIALIZED (SELECT f.pair, any_value(f.al) AS al, any_value(f.be) AS be, CASE WHEN var_samp(la - f.al - f.be * lb) > 0 THEN var_samp(la - f.al - f.be * lb) ELSE 1e-4 END AS r FROM v_spread s JOIN f ON f.pair = s.pair GROUP BY f.pair),
base AS MATERIALIZED (SELECT s.pair, i, la AS y, lb AS x, n.r AS noise, row_number() OVER (PARTITION BY s.pair ORDER BY i) AS rn FROM v_spread s JOIN n ON n.pair = s.pair),
rec AS (SELECT pair, 0::BIGINT AS rn, 0::BIGINT AS i, al, be, 1e0 AS p0, 0e0 AS pc, 1e0 AS p1, 0e0 AS e FROM n
UNION ALL {_STEP} FROM rec r JOIN (SELECT * FROM base) b ON b.pair = r.pair AND b.rn = r.rn + 1, LATERAL (SELECT b.y - r.al - b.x * r.be AS d, r.p0 + 1e-7 + 2 * b.x * r.pc + b.x * b.x * (r.p1 + 1e-5) + b.noise AS s))
SELECT pair, i, {R('al', 4)} AS alpha_t, {R('be', 4)} AS beta_t, {R('e', 4)} AS innovation, {R('p0', 8)} AS var_alpha, {R('p1', 8)} AS var_beta FROM rec WHERE rn > 0""")
def _(t):
    d = rounded(S.dynamic_hedge(spreads(t)), "alpha_t", "beta_t", "innovation", digits=4)
    return rounded(d, "var_alpha", "var_beta", digits=8)


def fitted(t):
    return t.store("hedge_fits", lambda: S.fit_dynamic_hedge(spreads(t).where(c("ts") < F.lit(CUT).cast("timestamp"))))


@query("st18_noise_calibration")
def _(t):
    return fitted(t)


@query("st19_static_vs_dynamic")
def _(t):
    s = spreads(t)
    k = S.dynamic_hedge(s)
    first = k.groupBy("pair").agg(F.min("i").alias("_i0"))
    k2 = k.join(first, "pair").where(c("i") >= c("_i0") + 50)
    b = k.groupBy("pair").agg(F.avg("beta_t").alias("beta_mean"), F.stddev_samp("beta_t").alias("beta_std"))
    return S.adf(s, ["pair"], "spread", prefix="static").drop("n").join(S.adf(k2, ["pair"], "innovation", prefix="filter").drop("n"), "pair").join(b, "pair")


def screen(t):
    def build():
        """Every pair that passes the correlation gate."""
        s = S.train_test_screen(spreads(t), CUT)
        return s.join(selected_pairs(t).select("pair", "sym_a", "sym_b", "corr"), "pair")
    return t.store("screen", build)


@query("st20_screen_selection")
def _(t):
    return S.selected_schema(screen(t), 0.05, 5)


@query("st20_pass_counts")
def _(t):
    return S.pass_counts(screen(t), ["static_out_pvalue", "filter_out_pvalue"])


@query("st24_in_and_out_of_sample")
def _(t):
    return screen(t).select("pair", *[f"{a}_{b}_{x}" for a in ("static", "filter") for b in ("in", "out") for x in ("stat", "pvalue")])


@query("st22_anchor_screens")
def _(t):
    """The static screen repeated per anchor: the train window ends at the anchor, the test follows."""
    w = wins(t)
    d = spreads(t).select("pair", "ts", "i", "la", "lb").join(F.broadcast(w), (c("ts") >= c("train_start")) & (c("ts") < c("test_end")))
    k = ["split_id", "pair"]
    f = d.where(c("ts") < c("train_end")).groupBy(*k).agg(F.regr_intercept("la", "lb").alias("_a"), F.regr_slope("la", "lb").alias("_b"))
    r = d.where(c("ts") >= c("train_end")).join(f, k).withColumn("r", c("la") - c("_a") - c("_b") * c("lb"))
    p = S.adf(r, k, "r")
    lo, hi = P.wilson(c("k"), c("n"))
    return p.groupBy("split_id").agg(F.count_if(c("adf_pvalue") < 0.05).alias("k"), F.count(F.lit(1)).alias("n")).withColumns({"lo": lo, "hi": hi})


@query("st23_return_pca")
def _(t):
    p = daily_panel(t)
    prev = p.select("symbol", (c("i") + 1).alias("i"), c("lp").alias("_p"))
    return S.return_pca(p.join(prev, ["symbol", "i"]).select("symbol", "i", (c("lp") - c("_p")).alias("r")))[0]


@query("pf10_spread_override")
def _(t):
    cut = F.lit(CUT).cast("timestamp")
    k = S.forward_hedge(spreads(t).where(c("ts") >= cut), fitted(t)).select("pair", "i", c("innovation").alias("spread"))
    d = X.override_spread(spreads(t).where(c("ts") >= cut), k)
    return X.spread_features(d, FCFG).select("pair", "ts", "spread", "spread_z", "target_change")


# ---- surrogates --------------------------------------------------------------------------------------------

def increments(t):
    h = halo_blocks(spreads(t).select("pair", "i", "ts", "spread"), "i", back=1)
    return core_rows(h.withColumn("d", c("spread") - F.lag("spread").over(block_window(["pair"], "i"))))


_RW = "d.pair || '|1|' || d.i || '|1|"


@query("sur1_random_walk", f"""WITH d AS (SELECT pair, i, spread - lag(spread) OVER (PARTITION BY pair ORDER BY i) AS d FROM v_spread), s AS (SELECT pair, stddev_pop(d) AS sd FROM d GROUP BY pair),
e AS (SELECT d.pair, d.i, s.sd * sqrt(-2e0 * ln(greatest({U(_RW + "u'")}, 1e-12))) * cos(2 * pi() * {U(_RW + "v'")}) AS e FROM d JOIN s ON s.pair = d.pair)
SELECT pair, i, {R('sum(e) OVER (PARTITION BY pair ORDER BY i)')} AS walk FROM e""")
def _(t):
    d = increments(t)
    s = d.groupBy("pair").agg(F.stddev_pop("d").alias("sd"))
    return rounded(C.random_walks(d.select("pair", "i").join(s, "pair"), ["pair"], c("sd"), 1, DAY_US).select("pair", "i", "walk"), "walk")


_SH = """WITH b AS (SELECT pair, i, lb, i - min(i) OVER (PARTITION BY pair) AS k, min(i) OVER (PARTITION BY pair) AS i0, count(*) OVER (PARTITION BY pair) AS n FROM v_spread),
w AS (SELECT DISTINCT pair, k // 24 AS b FROM b WHERE (k // 24 + 1) * 24 <= n), r AS (SELECT pair, b, row_number() OVER (PARTITION BY pair ORDER BY md5(pair || '|' || CAST(b AS VARCHAR) || '|5')) - 1 AS t FROM w)
SELECT b.pair, CAST(i0 + coalesce(t, k // 24) * 24 + k % 24 AS BIGINT) AS i, (round(lb, 6) + 0e0) AS lb FROM b LEFT JOIN r ON r.pair = b.pair AND r.b = b.k // 24"""


@query("sur2_block_shuffle", _SH)
def _(t):
    return rounded(C.block_shuffle(spreads(t).select("pair", "i", "lb"), ["pair"], "lb", 24, 5), "lb")


@query("sur3_phase_randomised")
def _(t):
    return C.phase_randomised(daily_panel(t).select("symbol", "i", "lp"), ["symbol"], "lp", 3)


@query("sur4_positive_control")
def _(t):
    return C.cointegrated(spreads(t).select("pair", "i"), ["pair"], 1.2, 10.0, 0.02, 0.01, 9, DAY_US)


_PERM = f""", r AS (SELECT sel.*, rep FROM sel, range(1, 21) u(rep)), a AS (SELECT *, row_number() OVER (PARTITION BY split_id, rep ORDER BY pair) AS n1,
 row_number() OVER (PARTITION BY split_id, rep ORDER BY {U("pair || '|' || split_id || '|' || rep || '|4'")}, pair) AS n2 FROM r),
p AS (SELECT a.split_id, a.rep, a.pair, a.tr, b.oos_speed FROM a JOIN a b ON b.split_id = a.split_id AND b.rep = a.rep AND b.n2 = a.n1),
k AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY split_id, rep ORDER BY tr, pair) AS rt, row_number() OVER (PARTITION BY split_id, rep ORDER BY tr DESC, pair) AS rb FROM p WINDOW w AS (PARTITION BY split_id, rep)),
q AS (SELECT split_id, rep, avg(oos_speed) FILTER (rt <= greatest(1, n // 5)) - avg(oos_speed) FILTER (rb <= greatest(1, n // 5)) AS spread FROM k WHERE n >= 10 GROUP BY split_id, rep)
SELECT {R('avg(spread)')} AS mean, {R('stddev_pop(spread)')} AS sd, count(*) AS n FROM q"""


@query("sur6_label_permutation", _SEL + _PERM)
def _(t):
    from .t5_walk import selectability
    d = C.permute_labels(selectability(t), ["split_id"], "oos_speed", 4, reps=20)
    q = V.quintile_spread(d.withColumn("k", c("split_id") * 1000 + c("rep")), "tr", "oos_speed", True, split="k")
    return rounded(q.agg(F.avg("spread").alias("mean"), F.stddev_pop("spread").alias("sd"), F.count(F.lit(1)).alias("n")), "mean", "sd")


_BRK = "split_id || '|' || pair || '|2|"


@query("sur8_break_injection", f"""WITH s AS (SELECT split_id, pair, min(i) AS i0, count(*) AS n FROM v_walk GROUP BY ALL),
h AS (SELECT *, floor(n * 1e-1) + floor({U(_BRK + "t'")} * (floor(n * 7e-1) - floor(n * 1e-1) + 1)) AS tb, {U(_BRK + "p'")} < 5e-1 AND n >= 40 AS hit FROM s),
d AS (SELECT w.split_id, w.pair, w.spread, w.i - h.i0 AS k, tb, hit, greatest(2, floor((n - tb) * 3e-1)) AS len FROM v_walk w JOIN h ON h.split_id = w.split_id AND h.pair = w.pair),
a AS (SELECT split_id, pair, CASE WHEN hit AND k >= tb AND max(CASE WHEN k = tb THEN 1 END) OVER (PARTITION BY split_id, pair) = 1 THEN least(1e0, (k - tb) / (len - 1)) * 3e-1 ELSE 0e0 END AS x FROM d)
SELECT split_id, pair, {R('max(x)')} AS shift, count(*) AS bars FROM a GROUP BY ALL""")
def _(t):
    d = walk(t).withColumn("mu", F.lit(0.0))
    b = C.inject_breaks(d, W.KEYS, 0.3, 0.5, 2)
    return rounded(b.join(d.select(*W.KEYS, "i", c("la").alias("la0")), [*W.KEYS, "i"]).groupBy(*W.KEYS).agg(
        F.max(F.abs(c("la") - c("la0"))).alias("shift"), F.count(F.lit(1)).alias("bars")), "shift")


def floors(t, reps=20, window=60, horizon=10, gap=10, threshold=2.0):
    d = increments(t)
    s = d.groupBy("pair").agg(F.stddev_pop("d").alias("sd"))
    w = C.random_walks(d.select("pair", "i").join(s, "pair"), ["pair"], c("sd"), 21, DAY_US, reps=reps, out="spread")
    h = halo_blocks(w, "i", back=window)
    f = block_window(["pair", "rep"], "i").rowsBetween(-(window - 1), 0)
    z = core_rows(h.withColumn("z", X.at_least((c("spread") - F.avg("spread").over(f)) / F.nullif(F.stddev_samp("spread").over(f), F.lit(0.0)), F.count("spread").over(f), window)))
    e = V.reversion_events(z.where("z IS NOT NULL").select("pair", "rep", "i", "z"), ["pair", "rep"], horizon, gap, threshold)
    return e.groupBy("pair", "rep").agg(F.avg("reversion").alias("m")).groupBy("pair").agg(F.avg("m").alias("floor"), F.stddev_samp("m").alias("floor_sd"), F.count(F.lit(1)).alias("reps"))


_RF = "d.pair || '|' || rep || '|' || d.i || '|21|"
_FLOOR = f"""fd AS (SELECT pair, i, spread - lag(spread) OVER (PARTITION BY pair ORDER BY i) AS d FROM v_spread), fs AS (SELECT pair, stddev_pop(d) AS sd FROM fd GROUP BY pair),
fw AS (SELECT d.pair, rep, d.i, sum(s.sd * sqrt(-2e0 * ln(greatest({U(_RF + "u'")}, 1e-12))) * cos(2 * pi() * {U(_RF + "v'")})) OVER (PARTITION BY d.pair, rep ORDER BY d.i) AS x FROM fd d JOIN fs s ON s.pair = d.pair, range(1, 21) r(rep)),
fz AS (SELECT pair, rep, i, CASE WHEN count(x) OVER v >= 60 THEN (x - avg(x) OVER v) / nullif(stddev_samp(x) OVER v, 0e0) END AS z FROM fw WINDOW v AS (PARTITION BY pair, rep ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
fv AS (SELECT pair, rep, i, z, lead(z, 10) OVER w AS z1, lead(i, 10) OVER w AS more FROM fz WHERE z IS NOT NULL WINDOW w AS (PARTITION BY pair, rep ORDER BY i)),
fe AS MATERIALIZED (SELECT pair, rep, i, z, z1 FROM fv WHERE abs(z) > 2 AND more IS NOT NULL), fx AS MATERIALIZED (SELECT a.pair, a.rep, a.i, b.i AS ni FROM fe a ASOF JOIN fe b ON a.pair = b.pair AND a.rep = b.rep AND a.i + 10 <= b.i),
fr AS (SELECT pair, rep, min(i) AS i FROM fe GROUP BY pair, rep UNION ALL SELECT r.pair, r.rep, fx.ni FROM fr r JOIN fx ON fx.pair = r.pair AND fx.rep = r.rep AND fx.i = r.i),
fm AS (SELECT fe.pair, fe.rep, avg(-sign(z) * (z1 - z)) AS m FROM fr JOIN fe ON fe.pair = fr.pair AND fe.rep = fr.rep AND fe.i = fr.i GROUP BY fe.pair, fe.rep),
fl AS (SELECT pair, avg(m) AS floor, stddev_samp(m) AS floor_sd, count(*) AS reps FROM fm GROUP BY pair)"""


@query("sur9_mechanical_floor", f"WITH RECURSIVE {_FLOOR} SELECT pair, {R('floor')} AS floor, {R('floor_sd')} AS floor_sd, reps FROM fl")
def _(t):
    return rounded(floors(t), "floor", "floor_sd")


@query("ev3_excess_over_floor", _EV + f", {_FLOOR}, ob AS (SELECT e.pair, avg(-sign(e.z) * (e.z1 - e.z)) AS observed, count(*) AS n_events FROM rec JOIN e ON e.pair = rec.pair AND e.i = rec.i GROUP BY e.pair HAVING count(*) >= 10) "
       f"SELECT ob.pair, {R('observed')} AS observed, n_events, {R('floor')} AS floor, {R('floor_sd')} AS floor_sd, reps, {R('observed - floor')} AS excess FROM ob JOIN fl ON fl.pair = ob.pair")
def _(t):
    o = events(t).groupBy("pair").agg(F.avg("reversion").alias("observed"), F.count(F.lit(1)).alias("n_events")).where("n_events >= 10")
    return rounded(o.join(floors(t), "pair").withColumn("excess", c("observed") - c("floor")), "observed", "floor", "floor_sd", "excess")


@query("ev9_sensitivity")
def _(t):
    """Event reversion over a grid of thresholds and horizons: the settings travel as an array column."""
    z = X.spread_features(spreads(t), FCFG).select("pair", "i", c("spread_z").alias("z")).where("z IS NOT NULL")
    out = None
    for h in (5, 10, 20):
        hb = halo_blocks(z, "i", fwd=h)
        d = core_rows(hb.withColumns({"_z1": F.lead("z", h).over(block_window(["pair"], "i"))})).where("_z1 IS NOT NULL")
        d = d.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (1.5, 2.0, 2.5)]))).where(F.abs("z") > c("threshold"))
        e = V.cooldown(d.select("pair", "threshold", "i", "z", "_z1"), ["pair", "threshold"], h)
        g = e.groupBy("threshold").agg(F.avg(-F.signum("z") * (c("_z1") - c("z"))).alias("reversion"), F.count(F.lit(1)).alias("n")).withColumn("horizon", F.lit(h))
        out = g if out is None else out.unionByName(g)
    return out


@query("sur10_placebo_screen")
def _(t):
    """The same screen on real pairs, on a block-shuffled leg, on random walks and on a cointegrated control."""
    s = spreads(t).select("pair", "ts", "i", "la", "lb")
    keyed = lambda d, label: d.select(F.concat_ws(":", F.lit(label), "pair").alias("pair"), "ts", "i", "la", "lb")
    shuf = s.drop("lb").join(C.block_shuffle(s.select("pair", "i", "lb"), ["pair"], "lb", 24, 5), ["pair", "i"])
    g = s.select("pair", "i")
    rw = C.random_walks(g, ["pair"], F.lit(0.02), 31, DAY_US, out="la").drop("rep").join(C.random_walks(g, ["pair"], F.lit(0.02), 32, DAY_US, out="lb").drop("rep"), ["pair", "i"])
    ctl = C.cointegrated(g, ["pair"], 1.2, 10.0, 0.02, 0.01, 9, DAY_US)
    at = lambda d: d.withColumn("ts", N.index_ts("i", DAY_US))
    u = keyed(s, "real").unionByName(keyed(shuf, "block_shuffle")).unionByName(keyed(at(rw), "random_walk")).unionByName(keyed(at(ctl), "cointegrated"))
    r = S.train_test_screen(u, CUT)
    r = r.withColumn("label", F.split_part("pair", F.lit(":"), F.lit(1)))
    return S.pass_counts(r, ["static_out_pvalue", "filter_out_pvalue"], ["label"])


# ---- stress and locked evaluation -----------------------------------------------------------------------------

@query("bt25_break_stress")
def _(t):
    d = walk(t).withColumn("mu", F.lit(0.0))
    out = None
    for p in (0.0, 0.25, 0.5):
        b = C.inject_breaks(d, W.KEYS, 0.3, p, 2).withColumn("z", c("spread") / c("sd"))
        for name, stop in (("stop4", 4.0), ("nostop", None)):
            r = W.stitched(T.unit_pnl(T.hysteresis(b, "z", W.KEYS, stop=stop), 15.0, W.KEYS))
            g = r.agg(I.sharpe("pnl", 365.0).alias("sharpe"), F.sum("pnl").alias("net")).select(F.lit(p).alias("p_break"), F.lit(name).alias("rule"), "sharpe", "net")
            out = g if out is None else out.unionByName(g)
    return out


@query("bt27_locked_evaluation")
def _(t):
    """A fixed configuration on the held-out windows with its index beta."""
    held = unit(t, None).where(c("test_end") > F.lit(HELD_FROM).cast("timestamp"))
    p = daily_panel(t)
    prev = p.select("symbol", (c("i") + 1).alias("i"), c("lp").alias("_p"))
    m = p.join(prev, ["symbol", "i"]).groupBy("i").agg(F.avg(c("lp") - c("_p")).alias("x"))
    r = W.stitched(held)
    s = r.agg(I.sharpe("pnl", 365.0).alias("sharpe"), F.sum("pnl").alias("net"))
    return s.join(F.broadcast(I.market_beta(r.join(m, "i"), "pnl", "x")))


# ---- models -----------------------------------------------------------------------------------------------------

@query("ml3_boosted_trees")
def _(t):
    s, cut = samples(t), F.lit(CUT).cast("timestamp")
    p, _m = M.boosted_classes(s.where(c("ts") < cut), s.where(c("ts") >= cut), X.TABULAR, trees=3, depth=3)
    return M.scores(p)


@query("ml4_walk_forward_models")
def _(t):
    s = samples(t)
    w = windows(s, 730, 365, 365)
    assign = lambda d: N.assign_windows(d, w, 730, 365, 365)
    return M.scores(M.walk_forward(s, w, X.TABULAR, assign), ["model", "split_id"])


@query("ml5_feature_ablation")
def _(t):
    s, cut = samples(t), F.lit(CUT).cast("timestamp")
    tr, te = s.where(c("ts") < cut).cache(), s.where(c("ts") >= cut)
    out = None
    for drop in ("none", *X.TABULAR):
        p, _m = M.forest_classes(tr, te, [f for f in X.TABULAR if f != drop], trees=5, depth=4)
        g = M.scores(p).withColumn("dropped", F.lit(drop))
        out = g if out is None else out.unionByName(g)
    base = out.where("dropped = 'none'").select(c("macro_f1").alias("_b"))
    return out.join(F.broadcast(base)).withColumn("delta_f1", c("macro_f1") - c("_b")).drop("_b")


@query("ml6_importances")
def _(t):
    s = samples(t).where(c("ts") < F.lit(CUT).cast("timestamp"))
    _p, m = M.forest_classes(s, s, X.TABULAR, trees=5, depth=4)
    return M.importances(m, X.TABULAR, t.spark)


REGIMES = G.RegimeConfig(iterations=20)


def hidden_regimes(t):
    """(states of all rows, models) of every pair; the models see rows before the cut alone."""
    made = []

    def once():
        if not made:
            made.extend(G.regimes(ready(t).withColumn("early", c("ts") < F.lit(CUT).cast("timestamp")), "early", cfg=REGIMES))
        return made

    return t.store("regime_states", lambda: once()[0]), t.store("regime_models", lambda: once()[1])


@query("ml7_regimes")
def _(t):
    """Raw and masked calls after the cut, per pair."""
    s = ready(t).where(c("ts") >= F.lit(CUT).cast("timestamp")).withColumn("i", c("i").cast("bigint"))
    d = s.join(hidden_regimes(t)[0], ["pair", "i"], "left").withColumn("mean_reverting_state", F.coalesce("mean_reverting_state", F.lit(False)))
    d = d.withColumn("pred_class", T.baseline_rule("spread_z")).withColumn("y_class", F.when(c("target_abs_change") < 0, 0).otherwise(2))
    raw, masked = M.scores(d, ["pair"]).withColumn("kind", F.lit("raw")), M.scores(M.mask_regime(d), ["pair"]).withColumn("kind", F.lit("filtered"))
    return raw.unionByName(masked)


@query("ml7_transitions")
def _(t):
    return G.model_table(hidden_regimes(t)[1], ["pair"], REGIMES)


@query("ml7_states")
def _(t):
    return hidden_regimes(t)[0]
