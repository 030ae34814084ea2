"""Signals, positions, P&L, ledger and portfolio metrics on long ``(pair, ts)`` tables.

Windows here hold one pair, or one pair inside one walk window; all have the same bounded length
(bars of the calendar or of the window), so no group is hot.  State machines run in chunks of bars.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import BLOCK_ROWS
from ..core.scan import chunked_scan
from .machines import BreakMachine, ClassMachine, ExitMachine

c = F.col


@dataclass(frozen=True)
class Costs:
    leg_notional: float = 10_000.0
    taker_fee_bps: float = 5.0
    slippage_bps: float = 2.0
    bars_per_year: float = 8760.0
    rf_annual: float = 0.0


def class_signal(pred: str = "pred_class", spread: str = "current_spread") -> Column:
    s = F.signum(spread)
    return F.when(s == 0, 0.0).when(c(pred) == 0, -s).when(c(pred) == 2, s).otherwise(0.0)


def gate_by_z(signal: Column, z: str, threshold: float) -> Column:
    return F.when(F.abs(z) >= threshold, signal).otherwise(0.0)


def gate_by_regime(signal: Column, state: str) -> Column:
    return F.when(c(state), signal).otherwise(0.0)


def baseline_rule(z: str = "latest_spread_z", entry: float = 1.5) -> Column:
    """|z| at or above the entry level predicts reversion, else persistence."""
    return F.when(F.abs(z) >= entry, 0).otherwise(1)


def order_window(keys: Sequence[str], idx: str = "i"):
    return Window.partitionBy(*keys).orderBy(idx)


def hysteresis(df: DataFrame, z: str, keys: Sequence[str], idx: str = "i", enter: float = 2.0, exit_: float = 0.5,
               stop: float | None = 4.0, out: str = "position") -> DataFrame:
    """Enter against |z| >= enter, leave at |z| <= exit, flat at |z| >= stop or missing z.

    Exits do not depend on the entry, so the state machine is two windows: number the exits, then
    take the first entry after each exit.
    """
    zz = c(z)
    leave = zz.isNull() | (F.abs(zz) <= exit_)
    if stop is not None:
        leave = leave | (F.abs(zz) >= stop)
    w = order_window(keys, idx)
    d = df.withColumns({"_x": leave.cast("int"),
                        "_e": F.when(leave, None).when(zz >= enter, -1.0).when(zz <= -enter, 1.0)})
    d = d.withColumn("_g", F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*keys, "_g").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.coalesce(F.first("_e", ignorenulls=True).over(g), F.lit(0.0))).drop("_x", "_e", "_g")


# ---- state machines whose exits depend on the entry: machines over chunks of bars -----------------

def class_machine(df: DataFrame, keys: Sequence[str], entry_z: float = 1.5, exit_z: float = 0.5, idx: str = "i",
                  out: str = "signal", chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Open on a revert class at |z| >= entry; close on small |z|, a diverge class or a sign flip;
    the exit bar itself never re-enters.  A missing class opens and closes nothing."""
    return chunked_scan(df, keys, ClassMachine(entry_z, exit_z, out), idx, chunk_rows)


def exit_variants(df: DataFrame, keys: Sequence[str], idx: str = "i", out: str = "position", enter: float = 2.0,
                  exit_z: float = 0.5, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Positions under per-key settings ``stop, exit_mode ('z' | 'time' | 'conv'), max_hold``."""
    return chunked_scan(df, keys, ExitMachine(enter, exit_z, out), idx, chunk_rows)


def break_stops(df: DataFrame, keys: Sequence[str], idx: str = "i", out: str = "position", enter: float = 2.0,
                exit_z: float = 0.5, crash: float | None = None, adverse: float | None = None,
                loss: float | None = None, halt: bool = False, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """No z-stop, but break stops: long-leg crash, either leg adverse, or position loss; optionally the
    pair halts for the rest of the group after one fires."""
    fall = -math.log1p(-crash) if crash else math.inf
    rise = -math.log1p(-adverse) if adverse else math.inf
    return chunked_scan(df, keys, BreakMachine(enter, exit_z, min(fall, rise), rise, loss or math.inf, halt, out), idx, chunk_rows)


# ---- P&L -----------------------------------------------------------------------------------------

def align_prices(preds: DataFrame, panel: DataFrame) -> DataFrame:
    """Attach both legs' closes to prediction rows, carried forward over missing bars, then drop rows
    before the first price.  The carry runs in index chunks of the pair."""
    from ..core.ordered import YEAR_US, carry_forward
    a = panel.select(c("symbol").alias("sym_a"), "ts", c("close").alias("close_a"))
    b = panel.select(c("symbol").alias("sym_b"), "ts", c("close").alias("close_b"))
    d = preds.join(a, ["sym_a", "ts"], "left").join(b, ["sym_b", "ts"], "left")
    d = carry_forward(d, ["pair"], ["ts"], ["close_a", "close_b"], YEAR_US)
    return d.dropna(subset=["close_a", "close_b"])


def pair_pnl(df: DataFrame, cfg: Costs, keys: Sequence[str] = ("pair",), idx: str = "i", slip_a: Column | None = None,
             slip_b: Column | None = None) -> DataFrame:
    """One-bar lag, dollar P&L of both legs, turnover and costs; needs ``signal, close_a, close_b, beta``."""
    w = order_window(keys, idx)
    ret = lambda x: F.coalesce(c(x) / F.lag(x).over(w) - 1, F.lit(0.0))
    d = df.withColumns({"ret_a": ret("close_a"), "ret_b": ret("close_b"),
                        "held": F.coalesce(F.lag("signal").over(w), F.lit(0.0))})
    delta = F.abs(c("signal") - c("held"))
    na, nb = delta * cfg.leg_notional, delta * cfg.leg_notional * F.abs("beta")
    sa = slip_a if slip_a is not None else F.lit(cfg.slippage_bps)
    sb = slip_b if slip_b is not None else F.lit(cfg.slippage_bps)
    cost = (na * (cfg.taker_fee_bps + sa) + nb * (cfg.taker_fee_bps + sb)) / 1e4
    gross = c("held") * cfg.leg_notional * (c("ret_a") - c("beta") * c("ret_b"))
    return d.withColumns({"turnover": na + nb, "cost": cost, "gross": gross, "pnl": gross - cost})


def unit_pnl(df: DataFrame, cost_bps: float, keys: Sequence[str] = ("pair",), idx: str = "i",
             position: str = "position") -> DataFrame:
    """Unit variant: held x (r_a - r_b) on log returns, cost of both legs on |position change|."""
    w = order_window(keys, idx)
    r = lambda x: F.coalesce(c(x) - F.lag(x).over(w), F.lit(0.0))
    d = df.withColumns({"_sr": r("la") - r("lb"), "held": F.coalesce(F.lag(position).over(w), F.lit(0.0))})
    return (d.withColumns({"dpos": F.abs(c(position) - c("held")), "gross": c("held") * c("_sr")})
            .withColumn("net", c("gross") - c("dpos") * (2.0 * cost_bps / 1e4)).withColumnRenamed("_sr", "spread_ret"))


def ledger(df: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """One row per signal change (``held`` is the previous bar's signal)."""
    return df.where(c("signal") != c("held")).select(
        *keys, "ts", c("held").alias("from_signal"), c("signal").alias("to_signal"), "turnover")


def dense_book(df: DataFrame) -> DataFrame:
    """Every pair on every bar that any pair has; absent rows are flat with no P&L.

    Each bar carries its own small list of pairs and unfolds the missing ones, so no product of the
    two key sets is formed outside the rows that the dense table has anyway.
    """
    every = df.groupBy("ts").agg(F.collect_set("pair").alias("_have"))
    names = df.select("pair").distinct().agg(F.collect_set("pair").alias("_all"))
    gaps = (every.join(F.broadcast(names)).select("ts", F.explode(F.array_except("_all", "_have")).alias("pair"))
            .withColumns({"signal": F.lit(0.0), "pnl": F.lit(0.0)}))
    return df.select("ts", "pair", "signal", "pnl").unionByName(gaps)


def cap_active(dense: DataFrame, limit: int) -> DataFrame:
    """Keep at most ``limit`` active pairs per bar, in pair order (window over one bar's pairs)."""
    w = Window.partitionBy("ts").orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.sum((c("signal") != 0).cast("int")).over(w) <= limit
    return dense.withColumn("_k", ok).withColumns({
        "signal": F.when(c("_k"), c("signal")).otherwise(0.0), "pnl": F.when(c("_k"), c("pnl")).otherwise(0.0)}).drop("_k")


def portfolio(dense: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return dense.groupBy(*keys, "ts").agg(F.sum("pnl").alias("pnl"), F.count_if(c("signal") != 0).alias("active_pairs"))


def equity_curve(pnl: DataFrame, keys: Sequence[str] = (), value: str = "pnl", width_us: int | None = None) -> DataFrame:
    """Cumulative P&L, running peak and drawdown; sums and peaks cross year chunks through summaries."""
    from ..core.ordered import YEAR_US, chunk_of, running_sum, _scan as chunk_scan
    keys = list(keys)
    width = width_us or YEAR_US
    d = running_sum(pnl, keys, ["ts"], {"equity": value}, width).withColumn("_chunk", chunk_of("ts", width))
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    tops = d.groupBy(*keys, "_chunk").agg(F.max("equity").alias("_t"))
    tops = tops.select(*keys, "_chunk", F.max("_t").over(chunk_scan(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("_t"))
    d = d.withColumn("_p", F.max("equity").over(w)).join(tops, [*keys, "_chunk"], "left")
    d = d.withColumn("peak", F.greatest("_p", F.coalesce(c("_t"), c("_p"))))
    return d.withColumn("drawdown", c("equity") - c("peak")).drop("_chunk", "_p", "_t")


def metrics(dense: DataFrame, trades: DataFrame, cfg: Costs) -> DataFrame:
    """Portfolio metrics on a fixed capital base of pairs x leg notional x 2.

    Metric turnover leaves out an opening trade on the first bar, as the per-bar table does not.
    """
    p = equity_curve(portfolio(dense))
    size = dense.agg(F.countDistinct("pair").alias("n_pairs"))
    base = F.greatest(F.lit(1.0), c("n_pairs") * cfg.leg_notional * 2.0)
    g = p.agg(
        F.sum("pnl").alias("_tot"), F.avg("pnl").alias("_avg"), F.stddev_samp("pnl").alias("_sd"),
        F.min("drawdown").alias("max_drawdown_dollars"),
        F.min(c("drawdown") / F.greatest(c("peak"), F.lit(1.0))).alias("max_drawdown_pct_of_peak"),
        F.count(F.lit(1)).alias("bars"), F.count_if(c("active_pairs") > 0).alias("active_bars"),
        (F.count_if(c("pnl") > 0) / F.greatest(F.lit(1), F.count_if(c("pnl") != 0))).alias("win_rate_bars"))
    w = Window.partitionBy("pair").orderBy("ts")
    turn = (dense.withColumn("_d", F.abs(c("signal") - F.lag("signal").over(w))).agg(
        (F.coalesce(F.sum("_d"), F.lit(0.0)) * cfg.leg_notional * 2.0).alias("turnover_dollars")))
    n = trades.agg(F.count(F.lit(1)).alias("trades"))
    out = g.join(F.broadcast(size)).join(F.broadcast(turn)).join(F.broadcast(n))
    mean, sd = c("_avg") / base, c("_sd") / base
    return out.select(
        c("_tot").alias("total_pnl_dollars"), mean.alias("mean_bar_return"), F.coalesce(sd, F.lit(0.0)).alias("std_bar_return"),
        F.coalesce(F.when(sd > 0, (mean - cfg.rf_annual / cfg.bars_per_year) / sd * F.sqrt(F.lit(cfg.bars_per_year))), F.lit(0.0)).alias("sharpe_annualized"),
        "max_drawdown_dollars", "max_drawdown_pct_of_peak", "bars", "active_bars", "trades", "turnover_dollars", "win_rate_bars")


def round_trips(df: DataFrame, keys: Sequence[str], idx: str = "i", position: str = "position", pnl: str = "net") -> DataFrame:
    """Contiguous non-flat segments: P&L, bars held, still open at the end of the group.

    A segment sums the P&L of its non-flat bars; a direct reversal stays one segment.
    """
    keys = list(keys)
    w = order_window(keys, idx)
    on = c(position) != 0
    d = df.withColumns({"_on": on, "_start": (on & ~F.coalesce(F.lag(position).over(w) != 0, F.lit(False))).cast("int"),
                        "_end": F.lead(idx).over(w).isNull()})
    d = d.withColumn("trip", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    return d.groupBy(*keys, "trip").agg(
        F.min(idx).alias("entry_i"), F.count(F.lit(1)).alias("bars_held"), F.sum(pnl).alias("trip_pnl"),
        F.max("_end").alias("open_at_end"))
