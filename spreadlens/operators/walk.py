"""Walk-forward book: windows x selection x simulation x stitch as one plan over a windows table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import backtest as T, pairs as P
from ..core.ordered import block_window, core_rows, halo_blocks

c = F.col
KEYS = ["split_id", "pair"]


def test_rows(panel: DataFrame, windows: DataFrame, picks: DataFrame) -> DataFrame:
    """Test-window rows of the picked pairs with the frozen train hedge: ``spread`` and ``z``.

    Picks are at most N per window; each joins its legs by symbol inside the window bounds.
    """
    w = picks.join(F.broadcast(windows), "split_id")
    a = panel.select(c("symbol").alias("sym_a"), "ts", "i", c("lp").alias("la"))
    b = panel.select(c("symbol").alias("sym_b"), "ts", c("lp").alias("lb"))
    d = a.join(F.broadcast(w), "sym_a").where((c("ts") >= c("train_end")) & (c("ts") < c("test_end"))).join(b, ["sym_b", "ts"])
    spread = c("la") - c("alpha") - c("beta") * c("lb")
    return d.withColumn("spread", spread).withColumn("z", (c("spread") - c("mu")) / c("sd"))


def recentred(rows: DataFrame, window: int, min_rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """z from a trailing window inside the test period (the frame includes the current bar)."""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(-(window - 1), 0)
    n = F.count("spread").over(w)
    return rows.withColumn("z", F.when(n >= min_rows, (c("spread") - F.avg("spread").over(w)) / F.nullif(F.stddev_samp("spread").over(w), F.lit(0.0))))


def rolling_hedge(legs: DataFrame, window: int, min_rows: int, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Causal rolling OLS hedge (rows strictly before the bar) and the causal z of its spread."""
    keys = list(keys)
    h = halo_blocks(legs, "i", back=2 * window + 1)
    o = block_window(keys, "i")
    p = o.rowsBetween(-window, -1)
    n = F.count("lb").over(p)
    v = F.var_pop("lb").over(p)
    beta = F.when(n >= min_rows, F.covar_pop("la", "lb").over(p) / F.nullif(v, F.lit(0.0)))
    h = h.withColumns({"beta_r": beta, "_ma": F.avg("la").over(p), "_mb": F.avg("lb").over(p)})
    h = h.withColumn("alpha_r", c("_ma") - c("beta_r") * c("_mb")).withColumn("spread_r", c("la") - c("alpha_r") - c("beta_r") * c("lb"))
    m = F.count("spread_r").over(p)
    z = F.when(m >= min_rows, (c("spread_r") - F.avg("spread_r").over(p)) / F.nullif(F.stddev_samp("spread_r").over(p), F.lit(0.0)))
    return core_rows(h.withColumn("z_r", z)).drop("_ma", "_mb")


def vol_target(rows: DataFrame, window: int, min_rows: int, keys: Sequence[str] = KEYS, cap: float = 5.0) -> DataFrame:
    """Size = median / trailing volatility of the spread return, clipped to ``[0, cap]``, 1 where unknown."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("i")
    p = w.rowsBetween(-window, -1)
    r = lambda x: F.coalesce(c(x) - F.lag(x).over(w), F.lit(0.0))
    d = rows.withColumn("_r", r("la") - r("lb"))
    d = d.withColumn("_v", F.when(F.count("_r").over(p) >= min_rows, F.stddev_samp("_r").over(p)))
    med = d.groupBy(*keys).agg(F.median("_v").alias("_m"), F.stddev_pop("_r").alias("_f"))
    d = d.join(med, keys)
    m = F.when(c("_m") > 0, c("_m")).otherwise(F.coalesce(F.nullif(c("_f"), F.lit(0.0)), F.lit(1.0)))
    size = F.coalesce(m / F.nullif(c("_v"), F.lit(0.0)), F.lit(1.0))
    return d.withColumn("size", F.least(F.greatest(size, F.lit(0.0)), F.lit(cap))).drop("_r", "_v", "_m", "_f")


def with_variants(rows: DataFrame, variants: Sequence[tuple[str, str, float, int]]) -> DataFrame:
    """Each row under each fixed setting ``(name, exit_mode, stop, max_hold)``; a max_hold of 0 means twice
    the train half-life (at least 2 bars)."""
    structs = [F.struct(F.lit(n).alias("variant"), F.lit(m).alias("exit_mode"), F.lit(float(s)).alias("stop"), F.lit(float(h)).alias("max_hold"))
               for n, m, s, h in variants]
    d = rows.withColumn("_v", F.explode(F.array(*structs))).select("*", "_v.*").drop("_v")
    if "half_life" in d.columns:
        d = d.withColumn("max_hold", F.when(c("max_hold") == 0, F.greatest(F.lit(2.0), F.round(2 * c("half_life")))).otherwise(c("max_hold")))
    return d


def stitched(unit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-weight mean over a window's pairs, then the first window wins on overlapping bars."""
    keys = list(keys)
    g = unit.groupBy(*keys, "split_id", "ts", "i").agg(F.avg("net").alias("pnl"), F.avg("gross").alias("gross"))
    return g.groupBy(*keys, "ts", "i").agg(F.min_by(F.struct("pnl", "gross", "split_id"), "split_id").alias("_s")).select(*keys, "ts", "i", "_s.*")


def window_returns(unit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g = unit.groupBy(*keys, "split_id", "ts").agg(F.avg("net").alias("pnl"))
    return g.groupBy(*keys, "split_id").agg(F.sum("pnl").alias("ret"), F.count(F.lit(1)).alias("bars"))


def strategy_summary(unit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trades, turnover, round-trip win rate and total P&L per key."""
    keys = list(keys)
    p = stitched(unit, keys)
    t = unit.groupBy(*keys).agg(F.count_if(c("dpos") > 0).alias("trades"), F.sum("dpos").alias("turnover"))
    rt = T.round_trips(unit, [*keys, *KEYS]).groupBy(*keys).agg(F.count_if(c("trip_pnl") > 0).alias("wins"), F.count(F.lit(1)).alias("trips"))
    g = p.groupBy(*keys).agg(F.sum("pnl").alias("net_pnl"), F.sum("gross").alias("gross_pnl"), F.count(F.lit(1)).alias("bars"))
    join = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.join(F.broadcast(b)))
    return join(join(g, t), rt).withColumn("win_rate", c("wins") / c("trips"))


def concentration(unit: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Share of total P&L of the best pairs, and the P&L table without the best ``top``."""
    g = unit.groupBy("pair").agg(F.sum("net").alias("pnl"))
    best = g.orderBy(c("pnl").desc(), "pair").limit(top)
    total = g.agg(F.sum("pnl").alias("total"))
    shares = best.agg(F.max("pnl").alias("top1"), F.sum("pnl").alias("topk")).join(F.broadcast(total)).select(
        "total", (c("top1") / c("total")).alias("top1_share"), (c("topk") / c("total")).alias("topk_share"))
    return shares, unit.join(best.select("pair"), "pair", "left_anti")


def worst_drop(panel: DataFrame, h: int) -> DataFrame:
    """Per symbol the bar with the worst ``h``-bar log move, by an offset join."""
    past = panel.select("symbol", (c("i") + h).alias("i"), c("lp").alias("_p"))
    return panel.join(past, ["symbol", "i"]).groupBy("symbol").agg(
        F.min_by("i", F.struct(c("lp") - c("_p"), "i")).alias("drop_i"), F.min(c("lp") - c("_p")).alias("drop"))


def collapse_rows(panel: DataFrame, drops: DataFrame, partners: DataFrame, before: int, after: int) -> DataFrame:
    """Legs around each symbol's worst drop: hedge fitted on ``before`` bars ahead of it, evaluated across."""
    d = partners.join(drops.withColumnRenamed("symbol", "sym_a"), "sym_a")
    a = panel.select(c("symbol").alias("sym_a"), "i", "ts", c("lp").alias("la"))
    b = panel.select(c("symbol").alias("sym_b"), "i", c("lp").alias("lb"))
    x = (d.withColumn("i", F.explode(F.sequence(c("drop_i") - before, c("drop_i") + after)))
         .join(a, ["sym_a", "i"]).join(b, ["sym_b", "i"]))
    pre = c("i") < c("drop_i")
    fit = x.where(pre).groupBy("pair").agg(F.regr_intercept("la", "lb").alias("alpha"), F.regr_slope("la", "lb").alias("beta"), F.count(F.lit(1)).alias("_n"))
    x = x.join(fit.where(c("_n") >= before // 2).drop("_n"), "pair").withColumn("spread", c("la") - c("alpha") - c("beta") * c("lb"))
    sd = x.where(pre).groupBy("pair").agg(F.stddev_pop("spread").alias("sd")).where(c("sd") > 0)
    return x.join(sd, "pair").where(~pre).withColumns({"z": c("spread") / c("sd")})
