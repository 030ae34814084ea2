"""Calendars, panels and universes: long tables keyed ``(symbol, ts)``, never one column per symbol."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import DAY_US, block_window, core_rows, carry_forward, halo_blocks, int_div


def bar_index(ts: str | Column, step_us: int) -> Column:
    """Number of the bar on an epoch-aligned grid; also the dense row index of a gridded panel."""
    return int_div(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts), step_us)


def index_ts(i: str | Column, step_us: int) -> Column:
    return F.timestamp_micros((F.col(i) if isinstance(i, str) else i) * F.lit(step_us))


def calendar(spans: DataFrame, start: str, end: str, step_us: int, out: str = "ts") -> DataFrame:
    """One row per bar of ``[start, end)`` for every row of ``spans``; start and end must be on the grid."""
    s, e = bar_index(start, step_us), bar_index(end, step_us)
    return (spans.where(F.col(start) < F.col(end))
            .withColumn("i", F.explode(F.sequence(s, e - 1)))
            .withColumn(out, index_ts("i", step_us)))


def symbol_spans(bars: DataFrame, step_us: int, start=None, end=None) -> DataFrame:
    """One row per symbol with the common calendar bounds, taken from the data where not given.

    The window runs over one summary row per symbol.
    """
    s = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    everyone = Window.partitionBy(F.lit(0))
    lo = F.lit(start).cast("timestamp") if start is not None else F.min("first_ts").over(everyone)
    hi = (F.lit(end).cast("timestamp") if end is not None
          else index_ts(bar_index(F.max("last_ts").over(everyone), step_us) + 1, step_us))
    return s.withColumns({"start_ts": index_ts(bar_index(lo, step_us), step_us), "end_ts": hi})


def reindex(bars: DataFrame, step_us: int, start=None, end=None) -> DataFrame:
    """Every symbol on the full calendar; missing bars are null.  Each symbol row unfolds its own
    calendar, so there is no grid-by-symbol product to build."""
    grid = calendar(symbol_spans(bars, step_us, start, end).select("symbol", "start_ts", "end_ts"),
                    "start_ts", "end_ts", step_us).select("symbol", "ts", "i")
    return grid.join(bars, ["symbol", "ts"], "left")


def coverage(grid: DataFrame, value: str = "close") -> DataFrame:
    return grid.groupBy("symbol").agg(
        F.count(value).alias("n_bars"), F.count(F.lit(1)).alias("n_grid"),
        (F.count(value) / F.count(F.lit(1))).alias("coverage"))


def drop_thin(grid: DataFrame, min_coverage: float, value: str = "close") -> DataFrame:
    keep = coverage(grid, value).where(F.col("coverage") >= min_coverage).select("symbol")
    return grid.join(keep, "symbol", "left_semi")


def ffill(grid: DataFrame, cols: Sequence[str], width_us: int) -> DataFrame:
    """Unlimited forward fill per symbol (chunk and carry)."""
    return carry_forward(grid, ["symbol"], ["ts"], cols, width_us)


def ffill_limit(grid: DataFrame, cols: Sequence[str], limit: int, idx: str = "i") -> DataFrame:
    """Forward fill across at most ``limit`` missing bars of a gridded panel."""
    d = halo_blocks(grid, idx, back=limit)
    w = block_window(["symbol"], idx).rowsBetween(-limit, 0)
    return core_rows(d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}))


def complete_case(grid: DataFrame, value: str = "close", min_symbols: int = 2) -> DataFrame:
    """Keep the time stamps at which every symbol has a value."""
    n = Window.partitionBy(F.lit(0))
    seen = grid.groupBy("symbol").agg(F.lit(1).alias("_x")).select(
        "symbol", F.count(F.lit(1)).over(n).alias("_n_all"))
    n_all = seen.agg(F.max("_n_all").alias("_n_all"))
    full = (grid.where(F.col(value).isNotNull()).groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
            .join(F.broadcast(n_all), F.col("_n") == F.col("_n_all")).where(F.col("_n_all") >= min_symbols)
            .select("ts"))
    return grid.join(full, "ts", "left_semi")


def close_panel(bars: DataFrame, step_us: int, start=None, end=None, min_coverage: float = 0.5,
                fill_chunk_us: int = 366 * DAY_US) -> DataFrame:
    """Close and USDT-volume panel: grid, coverage gate, forward fill, complete cases.

    Coverage, the calendar and the first complete bar all follow from one summary row per symbol:
    after an unlimited fill a symbol is present from its first close on, so complete cases start at
    the latest of the first closes.  Columns ``symbol, ts, i, close, lp, volume_usdt``; ``i`` is gap-free.
    """
    inside = bars.where(F.col("close").isNotNull())
    if start is not None:
        inside = inside.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    s = inside.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_bars"))
    w = Window.partitionBy(F.lit(0))
    lo = bar_index(F.lit(start).cast("timestamp") if start is not None else F.min("first_ts").over(w), step_us)
    hi = bar_index(F.lit(end).cast("timestamp"), step_us) if end is not None else bar_index(F.max("last_ts").over(w), step_us) + 1
    s = s.withColumns({"i0": lo, "i1": hi}).where(F.col("n_bars") >= min_coverage * (F.col("i1") - F.col("i0")))
    s = s.withColumns({"full": F.max(bar_index("first_ts", step_us)).over(w), "n_sym": F.count(F.lit(1)).over(w)})
    grid = (s.where("n_sym >= 2").select("symbol", "full", F.explode(F.sequence(F.col("i0"), F.col("i1") - 1)).alias("i"))
            .withColumn("ts", index_ts("i", step_us)))
    g = grid.join(inside.select("symbol", "ts", "close", "volume"), ["symbol", "ts"], "left")
    g = g.withColumn("volume_usdt", F.coalesce(F.col("close") * F.col("volume"), F.lit(0.0))).drop("volume")
    g = ffill(g, ["close"], fill_chunk_us).where(F.col("i") >= F.col("full"))
    return g.select("symbol", "ts", "i", "close", F.log("close").alias("lp"), "volume_usdt")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
            .select(*keys, "_s.*").select(*df.columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_s"))
            .select(*keys, "_s.*").select(*df.columns))


def resample_last(panel: DataFrame, step_us: int) -> DataFrame:
    """Left-closed coarser bars holding the last close, complete cases only."""
    out = panel.groupBy("symbol", index_ts(bar_index("ts", step_us), step_us).alias("ts")).agg(
        F.max_by("close", "ts").alias("close"))
    return complete_case(out)


def universe_at(bars: DataFrame, t0, step_us: int, min_history_days: float = 0.0) -> DataFrame:
    """Symbols listed early enough before ``t0`` and still trading on the bar before it."""
    t0 = F.lit(t0).cast("timestamp")
    i0 = bar_index(t0, step_us)
    first_needed = F.timestamp_micros(i0 * step_us - F.lit(int(min_history_days * DAY_US)))
    return (bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .where((F.col("last_ts") >= index_ts(i0 - 1, step_us)) & (F.col("first_ts") <= first_needed)))


def universe_by_days(feeds: Sequence[DataFrame], t0, min_history_days: int, require_all: bool = True) -> DataFrame:
    """Symbols whose stored days cover ``[t0 - history, t0)`` in all (or any) of the feeds.

    Relational division by counting: distinct needed days present = number of needed days.
    """
    t0 = F.to_date(F.lit(t0).cast("timestamp"))
    need = max(int(min_history_days), 1)
    covered = []
    for f in feeds:
        d = f.select("symbol", F.to_date("ts").alias("day"))
        c = (d.where((F.col("day") >= F.date_sub(t0, need)) & (F.col("day") < t0))
             .groupBy("symbol").agg(F.countDistinct("day").alias("n")).where(F.col("n") == need).select("symbol"))
        covered.append(c)
    out = covered[0]
    for c in covered[1:]:
        out = out.intersect(c) if require_all else out.union(c).distinct()
    return out


def top_by_liquidity(bars: DataFrame, start, end, step_us: int, top_n: int, min_coverage: float = 0.8) -> DataFrame:
    """Top symbols by mean close*volume over ``[start, end)``; thin symbols do not rank."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    expected = bar_index(e, step_us) - bar_index(s, step_us)
    return (bars.where((F.col("ts") >= s) & (F.col("ts") < e)).groupBy("symbol")
            .agg(F.avg(F.col("close") * F.col("volume")).alias("usdt_vol"), F.count(F.lit(1)).alias("n_bars"))
            .where(F.col("n_bars") >= min_coverage * expected)
            .orderBy(F.col("usdt_vol").desc(), "symbol").limit(top_n))


def top_by_daily_notional(trades: DataFrame, start, end, top_n: int) -> DataFrame:
    """Top symbols by mean daily notional from ticks; empty days inside a symbol's span count as zero."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    d = (trades.where((F.col("ts") >= s) & (F.col("ts") < e))
         .groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("notional").alias("n")))
    return (d.groupBy("symbol").agg(
        (F.sum("n") / (F.datediff(F.max("day"), F.min("day")) + 1)).alias("mean_daily_notional"))
        .orderBy(F.col("mean_daily_notional").desc(), "symbol").limit(top_n))


def windows_over(bounds: DataFrame, train_days: int, test_days: int, step_days: int) -> DataFrame:
    """Windows table from a one-row frame with ``lo`` and ``hi`` (floored / ceiled to days)."""
    lo = int_div(F.unix_micros("lo"), DAY_US)
    hi = int_div(F.unix_micros("hi") + F.lit(DAY_US - 1), DAY_US)
    n = int_div(hi - lo - F.lit(train_days + test_days), step_days)
    day = lambda c: F.timestamp_micros(c * F.lit(DAY_US))
    return (bounds.where(hi - lo >= train_days + test_days)
            .select(lo.alias("_lo"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("split_id"))
            .withColumn("_s", F.col("_lo") + F.col("split_id") * step_days)
            .select(F.col("split_id").cast("int").alias("split_id"), day(F.col("_s")).alias("train_start"),
                    day(F.col("_s") + train_days).alias("train_end"),
                    day(F.col("_s") + train_days + test_days).alias("test_end")))


def windows_months(bounds: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Calendar-month windows; the last must end at or before ``hi``."""
    lo = F.to_date("lo")
    k = F.explode(F.sequence(F.lit(0), F.floor(F.months_between(F.to_date("hi"), lo) / step).cast("int")))
    return (bounds.select("hi", lo.alias("_lo"), k.alias("split_id"))
            .select("split_id", "hi", *[F.add_months("_lo", F.col("split_id") * step + m).cast("timestamp").alias(c)
                                        for c, m in (("train_start", 0), ("train_end", train), ("test_end", train + test))])
            .where(F.col("test_end") <= F.col("hi")).drop("hi"))


def assign_windows(rows: DataFrame, windows: DataFrame, train_days: int, test_days: int, step_days: int,
                   ts: str = "ts") -> DataFrame:
    """Tag rows with every window ``[train_start, test_end)`` holding them, by index arithmetic on the
    step: each row names its at most ``(train+test)/step`` candidates, then one equi-join on split id
    checks the bounds."""
    span = train_days + test_days
    first = windows.agg(F.min("train_start").alias("_w0"), F.max("split_id").alias("_w1"))
    d = int_div(F.unix_micros(ts) - F.unix_micros("_w0"), DAY_US)
    hi = F.least(int_div(d, step_days), F.col("_w1").cast("long"))
    lo = F.greatest(int_div(d - span, step_days) + 1, F.lit(0).cast("long"))
    cand = (rows.join(F.broadcast(first))
            .withColumn("split_id", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
            .withColumn("split_id", F.col("split_id").cast("int")).drop("_w0", "_w1"))
    return cand.join(F.broadcast(windows), "split_id")


def point_in_time_top(bars: DataFrame, windows: DataFrame, top_n: int, min_bars: int) -> DataFrame:
    """Per window the top symbols by train dollar volume, gated on coverage.  The windows table is a
    calendar (bounded by its step); bars are aggregated per (window, symbol) before ranking."""
    inside = (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("train_end"))
    g = (bars.join(F.broadcast(windows.select("split_id", "train_start", "train_end")), inside)
         .groupBy("split_id", "symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
                                            F.count("close").alias("n_bars"))
         .where(F.col("n_bars") >= min_bars))
    w = Window.partitionBy("split_id").orderBy(F.col("dollar_volume").desc(), "symbol")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def survivorship_counts(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: symbols trading at the end of training, and how many of them stop before the test ends."""
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    alive = (F.col("first_ts") < F.col("train_end")) & (F.col("last_ts") >= F.col("train_end"))
    return (F.broadcast(windows).join(spans, alive, "left").groupBy("split_id").agg(
        F.count("symbol").alias("available"),
        F.count_if(F.col("last_ts") < F.date_sub("test_end", 1).cast("timestamp")).alias("dropped")))


def window_coverage(bars: DataFrame, windows: DataFrame, step_us: int, min_coverage: float) -> DataFrame:
    """Symbols whose train-window coverage reaches the gate, per window."""
    inside = (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("train_end"))
    need = bar_index("train_end", step_us) - bar_index("train_start", step_us)
    return (bars.join(F.broadcast(windows), inside).groupBy("split_id", "symbol", need.alias("n_grid"))
            .agg(F.count("close").alias("n_bars"))
            .withColumn("coverage", F.col("n_bars") / F.col("n_grid")).where(F.col("coverage") >= min_coverage))


def dollar_volume_capacity(bars: DataFrame, min_days: int = 30, participation: float = 0.01) -> DataFrame:
    """Median daily dollar volume per symbol and the notional one may trade at a participation rate."""
    d = (bars.groupBy("symbol", F.to_date("ts").alias("day"))
         .agg(F.sum(F.col("close") * F.col("volume")).alias("dv")))
    return (d.groupBy("symbol").agg(F.median("dv").alias("median_daily_usd"), F.count(F.lit(1)).alias("n_days"))
            .where(F.col("n_days") >= min_days)
            .withColumn("capacity_usd", F.col("median_daily_usd") * participation))
