"""Event studies on pair z-scores and selectability tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import BLOCK_ROWS, block_window, core_rows, halo_blocks
from ..core.scan import chunked_scan
from .machines import CooldownMachine

c = F.col


def cooldown(events: DataFrame, keys: Sequence[str], gap: int, idx: str = "i", chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy thinning: an event counts when at least ``gap`` bars passed since the last counted one."""
    return chunked_scan(events, keys, CooldownMachine(gap, idx), idx, chunk_rows).where("_keep").drop("_keep")


def reversion_events(z: DataFrame, keys: Sequence[str], horizon: int, gap: int, threshold: float = 2.0, idx: str = "i") -> DataFrame:
    """|z| above the threshold, thinned, with outcome ``-sign(z)(z_{t+h} - z_t)``; events need a full horizon."""
    keys = list(keys)
    h = halo_blocks(z, idx, fwd=horizon)
    w = block_window(keys, idx)
    d = core_rows(h.withColumns({"_z1": F.lead("z", horizon).over(w), "_more": F.lead(idx, horizon).over(w)}))
    d = d.where((F.abs("z") > threshold) & c("_more").isNotNull())
    d = cooldown(d.select(*keys, idx, "z", "_z1"), keys, gap, idx)
    return d.where("_z1 IS NOT NULL").select(*keys, idx, "z", (-F.signum("z") * (c("_z1") - c("z"))).alias("reversion"))


def crossing_events(rows: DataFrame, keys: Sequence[str], horizons: Sequence[int], gap: int, threshold: float = 2.0, idx: str = "i") -> DataFrame:
    """Up-crossings of |z| with forward spread returns in z units, reversion flags and whether flow confirms.

    Needs ``z, sd, spread, flow``; the z must already be causal.
    """
    keys = list(keys)
    hmax = max(horizons)
    h = halo_blocks(rows, idx, back=1, fwd=hmax)
    w = block_window(keys, idx)
    d = core_rows(h.withColumns({"_pz": F.lag("z").over(w), "_more": F.lead(idx, hmax).over(w),
                                 **{f"_s{k}": F.lead("spread", k).over(w) for k in horizons}, **{f"_z{k}": F.lead("z", k).over(w) for k in horizons}}))
    d = d.where((F.abs("z") > threshold) & (F.abs("_pz") <= threshold) & c("_more").isNotNull())
    sg = F.signum("z")
    d = d.withColumns({"confirm": (F.signum("flow") == sg).cast("int"), "flow_align": c("flow") * sg,
                       **{f"rev_{k}": -sg * (c(f"_s{k}") - c("spread")) / c("sd") for k in horizons},
                       **{f"reverted_{k}": (F.abs(f"_z{k}") < F.abs("z")).cast("int") for k in horizons}})
    keep = ["confirm", "flow_align", *[f"rev_{k}" for k in horizons], *[f"reverted_{k}" for k in horizons]]
    return cooldown(d.select(*keys, idx, "z", *keep), keys, gap, idx)


def conditional_means(ev: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Reversion with confirming and opposing flow, their difference, and the two fading strategies."""
    conf = c("confirm") == 1
    out = None
    for k in horizons:
        r, b = c(f"rev_{k}"), c(f"reverted_{k}").cast("double")
        on, off = F.avg(F.when(conf, r)), F.avg(F.when(~conf, r))
        g = ev.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg(r).alias("rev_all"), on.alias("rev_confirm"), off.alias("rev_oppose"), (off - on).alias("rev_diff"),
            F.avg(b).alias("rate_all"), F.avg(F.when(conf, b)).alias("rate_confirm"), F.avg(F.when(~conf, b)).alias("rate_oppose"),
            (F.avg(r) / F.stddev_samp(r)).alias("sharpe_all"), (off / F.stddev_samp(F.when(~conf, r))).alias("sharpe_filtered")).withColumn("h", F.lit(k))
        out = g if out is None else out.unionByName(g)
    return out


def quintile_spread(df: DataFrame, metric: str, outcome: str, ascending: bool, split: str = "split_id", min_n: int = 10) -> DataFrame:
    """Per split: mean outcome of the best fifth minus the worst fifth by the metric (ties by pair)."""
    d = df.where(c(metric).isNotNull() & c(outcome).isNotNull())
    w = Window.partitionBy(split)
    best, worst = (c(metric).asc(), c(metric).desc()) if ascending else (c(metric).desc(), c(metric).asc())
    d = d.withColumns({"_n": F.count(F.lit(1)).over(w), "_t": F.row_number().over(w.orderBy(best, "pair")), "_b": F.row_number().over(w.orderBy(worst, "pair"))})
    nq = F.greatest(F.lit(1), F.floor(c("_n") / 5))
    top, bot = F.avg(F.when(c("_t") <= nq, c(outcome))), F.avg(F.when(c("_b") <= nq, c(outcome)))
    return d.where(c("_n") >= min_n).groupBy(split).agg(F.max("_n").alias("n"), top.alias("top"), bot.alias("bottom"), (top - bot).alias("spread"))


def causal_z(rows: DataFrame, keys: Sequence[str], window: int, value: str = "spread", idx: str = "i") -> DataFrame:
    """z and its scale from strictly earlier rows."""
    h = halo_blocks(rows, idx, back=window)
    w = block_window(list(keys), idx).rowsBetween(-window, -1)
    full = F.count(value).over(w) >= window
    sd = F.when(full, F.stddev_samp(value).over(w))
    return core_rows(h.withColumns({"sd": sd, "z": F.when(full, (c(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0)))}))
