"""Pair features, targets, samples and walk-forward tags.

All frames run inside blocks of the bar index with a halo, so a pair of any length is spread over
many tasks and every row still sees its whole window.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..core.ordered import YEAR_US, block_window, core_rows, halo_blocks, row_index
from ..core.session import checkpointed
from .inference import exact_medians

c = F.col

FEATURES = ["spread", "spread_z", "spread_diff_1", "spread_diff_4", "spread_diff_24", "spread_vol_24", "spread_vol_z",
            "volume_ratio", "volume_z_a", "volume_z_b", "pair_volume_sum", "pair_volume_gmean", "market_return_24",
            "rolling_corr_24", "realized_vol_a_24", "realized_vol_b_24"]
TARGETS = ["target_change", "target_abs_change", "target_reversion"]


@dataclass(frozen=True)
class FeatureConfig:
    z_window: int = 168
    short_window: int = 24
    corr_window: int = 24
    horizon: int = 24
    min_rows: int = 200
    diffs: tuple[int, int, int] = (1, 4, 24)
    block_rows: int = 8192


def at_least(value: Column, n: Column, k: int) -> Column:
    return F.when(n >= k, value)


def window_corr(a: str, b: str, w) -> Column:
    """Correlation over a frame; null where a side does not vary."""
    ok = c(a).isNotNull() & c(b).isNotNull()
    x, y = F.when(ok, c(a)), F.when(ok, c(b))
    return F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def rolling_z(x: str, w, k: int) -> Column:
    n = F.count(x).over(w)
    sd = F.stddev_samp(x).over(w)
    return at_least((c(x) - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0)), n, k)


def market_return(panel: DataFrame, symbol: str, h: int = 24, idx: str = "i") -> DataFrame:
    """h-bar log return of one symbol by an equi-join on the shifted index."""
    m = panel.where(c("symbol") == symbol).select(idx, c("lp").alias("_now"))
    past = m.select((c(idx) + h).alias(idx), c("_now").alias("_then"))
    return m.join(past, idx, "left").select(idx, (c("_now") - c("_then")).alias("market_return_24"))


def spread_features(spread: DataFrame, cfg: FeatureConfig, min_z: int | None = None) -> DataFrame:
    """z-score, differences, volatilities and targets of a gridded pair spread."""
    k = max(24, cfg.z_window // 4) if min_z is None else min_z
    h = halo_blocks(spread, "i", back=max(cfg.z_window, *cfg.diffs), fwd=cfg.horizon, rows=cfg.block_rows)
    w = block_window(["pair"], "i")
    z, s = w.rowsBetween(-(cfg.z_window - 1), 0), w.rowsBetween(-(cfg.short_window - 1), 0)
    fut = F.lead("spread", cfg.horizon).over(w)
    d1, d2, d3 = cfg.diffs
    h = h.withColumns({
        "spread_z": rolling_z("spread", z, k),
        "spread_diff_1": c("spread") - F.lag("spread", d1).over(w),
        "spread_diff_4": c("spread") - F.lag("spread", d2).over(w),
        "spread_diff_24": c("spread") - F.lag("spread", d3).over(w),
        "spread_vol_24": at_least(F.stddev_samp("spread").over(s), F.count("spread").over(s), 12),
        "spread_vol_z": at_least(F.stddev_samp("spread").over(z), F.count("spread").over(z), k),
        "target_change": fut - c("spread"), "target_abs_change": F.abs(fut) - F.abs("spread"),
        "target_reversion": (F.abs(fut) < F.abs("spread")).cast("int")})
    return core_rows(h)


def pair_features(legs: DataFrame, cfg: FeatureConfig, market: DataFrame | None = None) -> DataFrame:
    """All features and targets of each pair; needs ``spread, la, lb, volume_usdt_a, volume_usdt_b, i``."""
    k = max(24, cfg.z_window // 4)
    span = max(cfg.z_window, cfg.short_window + 1, cfg.corr_window + 1, *cfg.diffs) + 1
    h = halo_blocks(legs, "i", back=span, fwd=cfg.horizon, rows=cfg.block_rows)
    w = block_window(["pair"], "i")
    h = h.withColumns({"ra": c("la") - F.lag("la").over(w), "rb": c("lb") - F.lag("lb").over(w)})
    z, s = w.rowsBetween(-(cfg.z_window - 1), 0), w.rowsBetween(-(cfg.short_window - 1), 0)
    r = w.rowsBetween(-(cfg.corr_window - 1), 0)
    va, vb = c("volume_usdt_a"), c("volume_usdt_b")
    fut = F.lead("spread", cfg.horizon).over(w)
    d1, d2, d3 = cfg.diffs
    h = h.withColumns({
        "spread_z": rolling_z("spread", z, k),
        "spread_diff_1": c("spread") - F.lag("spread", d1).over(w),
        "spread_diff_4": c("spread") - F.lag("spread", d2).over(w),
        "spread_diff_24": c("spread") - F.lag("spread", d3).over(w),
        "spread_vol_24": at_least(F.stddev_samp("spread").over(s), F.count("spread").over(s), 12),
        "spread_vol_z": at_least(F.stddev_samp("spread").over(z), F.count("spread").over(z), k),
        "volume_ratio": va / F.nullif(vb, F.lit(0.0)),
        "volume_z_a": rolling_z("volume_usdt_a", z, 24), "volume_z_b": rolling_z("volume_usdt_b", z, 24),
        "pair_volume_sum": va + vb,
        "pair_volume_gmean": F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))),
        "rolling_corr_24": at_least(window_corr("ra", "rb", r), F.count(c("ra") + c("rb")).over(r), 12),
        "realized_vol_a_24": at_least(F.stddev_samp("ra").over(s), F.count("ra").over(s), 12),
        "realized_vol_b_24": at_least(F.stddev_samp("rb").over(s), F.count("rb").over(s), 12),
        "target_change": fut - c("spread"), "target_abs_change": F.abs(fut) - F.abs("spread"),
        "target_reversion": (F.abs(fut) < F.abs("spread")).cast("int")})
    out = core_rows(h)
    if market is None:
        return out.withColumn("market_return_24", F.lit(0.0))
    return out.join(market, "i", "left")


def finish_features(features: DataFrame, min_rows: int, columns: list[str] | None = None) -> DataFrame:
    """Infinite values become null, incomplete rows go, pairs with too few rows go.  Runs a job: the
    feature rows are written once before they are counted."""
    need = [*(columns or FEATURES), "target_change", "target_reversion"]
    dbl = [f.name for f in features.schema.fields if f.dataType.simpleString() == "double" and f.name in need]
    d = features.withColumns({f: F.when(F.abs(f) != float("inf"), F.nanvl(c(f), F.lit(None).cast("double"))) for f in dbl})
    # the row count per pair and the rows themselves come from one evaluation
    d = checkpointed(d.dropna(subset=need))
    keep = d.groupBy("pair").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= min_rows).select("pair")
    return d.join(keep, "pair", "left_semi")


def override_spread(legs: DataFrame, override: DataFrame) -> DataFrame:
    """Replace the static spread by an external one where it exists (left join on pair and bar)."""
    o = override.select("pair", "i", c("spread").alias("_o"))
    return legs.join(o, ["pair", "i"], "left").withColumn("spread", c("_o")).drop("_o")


def leg_flow_features(pair_bars: DataFrame) -> DataFrame:
    """Institutional / retail signed flow and imbalance per leg, and of the over-extended leg."""
    def imb(side, leg):
        b, s = c(f"{side}_buy_notional_{leg}"), c(f"{side}_sell_notional_{leg}")
        return (b - s) / F.nullif(b + s, F.lit(0.0))

    d = pair_bars.withColumns({
        **{f"inst_signed_{l}": c(f"inst_buy_notional_{l}") - c(f"inst_sell_notional_{l}") for l in "ab"},
        **{f"retail_signed_{l}": c(f"retail_buy_notional_{l}") - c(f"retail_sell_notional_{l}") for l in "ab"},
        **{f"inst_imb_{l}": F.coalesce(imb("inst", l), F.lit(0.0)) for l in "ab"},
        **{f"retail_imb_{l}": F.coalesce(imb("retail", l), F.lit(0.0)) for l in "ab"}})
    over = F.when(c("spread") > 0, c("inst_imb_a")).otherwise(c("inst_imb_b"))
    return d.withColumns({"over_leg_inst_imb": over,
                          "over_leg_retail_imb": F.when(c("spread") > 0, c("retail_imb_a")).otherwise(c("retail_imb_b"))})


@dataclass(frozen=True)
class SampleConfig:
    window: int = 32
    label_cutoff: str | None = None
    label_scale: float = 0.5
    fixed_threshold: float = 0.01
    per_pair_label: bool = True
    block_rows: int = 8192


def class_label(cur: Column, fut: Column, thr: Column) -> Column:
    """0 = reverts, 1 = persists, 2 = diverges by more than the threshold."""
    d = fut - cur
    return F.when(d < -thr, 0).when(d > thr, 2).otherwise(1)


def label_thresholds(features: DataFrame, cfg: SampleConfig) -> DataFrame:
    """Per pair: scale x sample sd of |spread| changes before the cut-off; the first ``window`` rows
    stand in when the cut-off leaves fewer."""
    d = features.withColumn("_chg", F.abs(c("spread") + c("target_change")) - F.abs("spread"))
    before = c("ts") < F.lit(cfg.label_cutoff).cast("timestamp")
    first = c("rn") <= cfg.window
    g = d.groupBy("pair").agg(
        F.count_if(before).alias("_n"), F.stddev_samp(F.when(before, c("_chg"))).alias("_a"),
        F.stddev_samp(F.when(first, c("_chg"))).alias("_b"))
    sd = F.when(c("_n") >= cfg.window, c("_a")).otherwise(c("_b"))
    return g.select("pair", F.coalesce(sd * cfg.label_scale, F.lit(cfg.fixed_threshold)).alias("threshold"))


def samples(features: DataFrame, cfg: SampleConfig, sequences: bool = False) -> DataFrame:
    """One sample per bar with a full trailing window of feature rows: summaries, labels, optional tensor."""
    f = row_index(features, ["pair"], ["ts"], "rn", YEAR_US)
    thr = label_thresholds(f, cfg)
    h = halo_blocks(f, "rn", back=cfg.window, rows=cfg.block_rows)
    o = block_window(["pair"], "rn")
    w, tail = o.rowsBetween(-(cfg.window - 1), 0), o.rowsBetween(-(cfg.window - 2), 0)
    cross = F.signum("spread") * F.signum(F.lag("spread").over(o)) <= 0
    h = h.withColumn("_cross", F.when(cross, c("rn")))
    extra = {"sequence": F.collect_list(F.array(*[c(x).cast("float") for x in FEATURES])).over(w)} if sequences else {}
    h = h.withColumns({
        "latest_spread_z": c("spread_z"), "mean_spread_z": F.avg("spread_z").over(w),
        "min_spread_z": F.min("spread_z").over(w), "max_spread_z": F.max("spread_z").over(w),
        "spread_slope": F.regr_slope("spread", "rn").over(w),
        "latest_volume_ratio": c("volume_ratio"), "mean_volume_ratio": F.avg("volume_ratio").over(w),
        "latest_market_return": c("market_return_24"), "latest_rolling_corr": c("rolling_corr_24"),
        "latest_realized_vol_a": c("realized_vol_a_24"), "latest_realized_vol_b": c("realized_vol_b_24"),
        "time_since_zero_crossing": F.coalesce(c("rn") - F.max("_cross").over(tail) + 1, F.lit(cfg.window)).cast("double"),
        "mean_pair_volume_sum": F.avg("pair_volume_sum").over(w), "latest_pair_volume_gmean": c("pair_volume_gmean"),
        "current_spread": c("spread"), **extra})
    d = core_rows(h).where(c("rn") >= cfg.window)
    threshold = c("threshold") if cfg.per_pair_label else F.lit(cfg.fixed_threshold)
    d = d.join(thr, "pair").withColumns({
        "y_regression": c("target_change"), "y_reversion": c("target_reversion"),
        "y_class": class_label(F.abs("spread"), F.abs(c("spread") + c("target_change")), threshold)})
    d = d.withColumn("sample_key", F.concat_ws("#", "pair", c("rn").cast("string")))
    keep = ["sample_key", "pair", "ts", "i", "rn", "sym_a", "sym_b", "threshold", "y_regression", "y_reversion", "y_class", *TABULAR,
            "current_spread", *extra]
    return d.select(*keep, *[x for x in d.columns if x.startswith("micro_")])


TABULAR = ["latest_spread_z", "mean_spread_z", "min_spread_z", "max_spread_z", "spread_slope", "latest_volume_ratio",
           "mean_volume_ratio", "latest_market_return", "latest_rolling_corr", "latest_realized_vol_a",
           "latest_realized_vol_b", "time_since_zero_crossing", "mean_pair_volume_sum", "latest_pair_volume_gmean"]


def with_split_ids(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse (sample, window) rows to one row per sample with its sorted list of windows."""
    return tagged.groupBy(*keys).agg(F.array_sort(F.collect_list("split_id")).alias("walk_split_ids"))


def chronological_split(samples_: DataFrame, test_days: int) -> DataFrame:
    """Tag rows ``train`` / ``test``: the last ``test_days`` days are the test part."""
    end = samples_.agg(F.max("ts").alias("_end"))
    cut = F.timestamp_micros(F.unix_micros("_end") - F.lit(test_days * 86_400_000_000))
    return (samples_.join(F.broadcast(end)).withColumn("part", F.when(c("ts") >= cut, "test").otherwise("train"))
            .drop("_end"))


def impute_and_scale(train: DataFrame, rows: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Median-impute and standardise with train-only statistics (one aggregate row per key)."""
    keys = list(keys or [])
    med = exact_medians(train, cols, keys).select(*keys, *[F.coalesce(x, F.lit(0.0)).alias(f"_m_{x}") for x in cols])
    on = (lambda d, s: d.join(F.broadcast(s), keys)) if keys else (lambda d, s: d.join(F.broadcast(s)))
    fill = {x: F.coalesce(c(x), c(f"_m_{x}")) for x in cols}
    st = on(train, med).withColumns(fill).groupBy(*keys).agg(
        *[F.avg(x).alias(f"_a_{x}") for x in cols], *[F.stddev_pop(x).alias(f"_s_{x}") for x in cols])
    d = on(on(rows, med).withColumns(fill), st)
    d = d.withColumns({x: (c(x) - c(f"_a_{x}")) / F.coalesce(F.nullif(c(f"_s_{x}"), F.lit(0.0)), F.lit(1.0)) for x in cols})
    return d.drop(*[f"_{p}_{x}" for p in "mas" for x in cols])
