"""Order-book operators.  Level-1 measures are plain projections; depth measures fold over level arrays."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import DAY_US, HOUR_US, asof_backward, previous_row

c = F.col


def mid() -> Column:
    return (c("bid_px_1") + c("ask_px_1")) / 2


def microprice(level: int = 1) -> Column:
    bs, as_ = c(f"bid_sz_{level}"), c(f"ask_sz_{level}")
    return (bs * c(f"ask_px_{level}") + as_ * c(f"bid_px_{level}")) / F.nullif(bs + as_, F.lit(0))


def quoted_spread_bps(level: int = 1) -> Column:
    b, a = c(f"bid_px_{level}"), c(f"ask_px_{level}")
    return (a - b) / F.nullif((a + b) / 2, F.lit(0.0)) * 1e4


def relative_spread() -> Column:
    return (c("ask_px_1") - c("bid_px_1")) / F.nullif(mid(), F.lit(0.0))


def _total(side: str, lo: int, hi: int) -> Column:
    return sum((c(f"{side}_sz_{i}") for i in range(lo + 1, hi + 1)), c(f"{side}_sz_{lo}"))


def imbalance(depth: int = 5, start: int = 1) -> Column:
    """(bids - asks) / (bids + asks) over levels ``start..depth``; empty book is null."""
    b, a = _total("bid", start, depth), _total("ask", start, depth)
    return (b - a) / F.nullif(b + a, F.lit(0))


def best(book: DataFrame) -> DataFrame:
    return book.select("symbol", "ts", "seq", "bid_px_1", "bid_sz_1", "ask_px_1", "ask_sz_1")


def valid(book: DataFrame) -> DataFrame:
    return book.where((c("ask_px_1") > c("bid_px_1")) & (c("bid_px_1") > 0))


def levels(side: str, n: int = 10) -> Column:
    """Levels of one side as ``array<struct<px, sz>>``; the stored table stays flat for pushdown."""
    return F.array(*[F.struct(c(f"{side}_px_{i}").cast("double").alias("px"), c(f"{side}_sz_{i}").cast("double").alias("sz"))
                     for i in range(1, n + 1)])


def _fold(arr: Column, fn) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + fn(x))


def depth_fair_value(n: int = 10) -> Column:
    both = F.concat(levels("bid", n), levels("ask", n))
    return _fold(both, lambda x: x.px * x.sz) / F.nullif(_fold(both, lambda x: x.sz), F.lit(0.0))


def fair_value_tilt(n: int = 10) -> Column:
    return (depth_fair_value(n) - mid()) / mid()


def slope(side: str, n: int = 10, eps: float = 1e-12) -> Column:
    """Size within ``n`` levels per size-weighted fractional distance from the mid."""
    arr = levels(side, n)
    size = _fold(arr, lambda x: x.sz)
    dist = _fold(arr, lambda x: x.sz * F.abs(x.px - mid()) / mid()) / (size + eps)
    return size / (dist + eps)


def slope_asymmetry(n: int = 10, eps: float = 1e-12) -> Column:
    b, a = slope("bid", n), slope("ask", n)
    return (b - a) / (b + a + eps)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("ts"))


def flow_events(book: DataFrame, width_us: int = HOUR_US) -> DataFrame:
    """Best-level order-flow event per update and size withdrawn at an unchanged price, within each
    symbol-day.  The previous row crosses chunk borders inside the day through chunk summaries."""
    d = with_day(book).select("symbol", "day", "ts", "seq", *[c(x).cast("double").alias(x) for x in
                                                            ("bid_px_1", "bid_sz_1", "ask_px_1", "ask_sz_1")])
    d = previous_row(d, ["symbol", "day"], ["ts", "seq"],
                     {"pbp": "bid_px_1", "pbs": "bid_sz_1", "pap": "ask_px_1", "pas": "ask_sz_1"}, width_us)
    bp, bs, ap, az = c("bid_px_1"), c("bid_sz_1"), c("ask_px_1"), c("ask_sz_1")
    bid = F.when(bp > c("pbp"), bs).when(bp == c("pbp"), bs - c("pbs")).otherwise(-c("pbs"))
    ask = F.when(ap < c("pap"), -az).when(ap == c("pap"), c("pas") - az).otherwise(c("pas"))
    return d.withColumns({
        "ofi": F.when(c("pbp").isNull(), 0.0).otherwise(bid + ask),
        "bid_dec": F.when(bp == c("pbp"), F.greatest(c("pbs") - bs, F.lit(0.0))).otherwise(0.0),
        "ask_dec": F.when(ap == c("pap"), F.greatest(c("pas") - az, F.lit(0.0))).otherwise(0.0),
    }).drop("pbp", "pbs", "pap", "pas")


def walk(notional: Column, side_levels: Column, leftover: bool) -> Column:
    """Fold a notional over level structs: ``(filled, levels_used, vwap)``.

    ``leftover=True`` fills what the book cannot at the last valid level.
    """
    zero = F.struct(notional.cast("double").alias("rem"), F.lit(0.0).alias("usd"), F.lit(0.0).alias("base"),
                    F.lit(0).alias("used"), F.lit(None).cast("double").alias("last"))

    def step(s, x):
        ok = x.px.isNotNull() & x.sz.isNotNull() & (x.px > 0) & (x.sz > 0) & (s["rem"] > 1e-9)
        take = F.least(s["rem"], x.px * x.sz)
        return F.struct(F.when(ok, s["rem"] - take).otherwise(s["rem"]).alias("rem"),
                        F.when(ok, s["usd"] + take).otherwise(s["usd"]).alias("usd"),
                        F.when(ok, s["base"] + take / x.px).otherwise(s["base"]).alias("base"),
                        (s["used"] + F.when(ok, 1).otherwise(0)).alias("used"),
                        F.when(ok, x.px).otherwise(s["last"]).alias("last"))

    def finish(s):
        extra = F.when(s["rem"] > 1e-9, s["rem"]).otherwise(0.0) if leftover else F.lit(0.0)
        base = s["base"] + F.coalesce(extra / s["last"], F.lit(0.0))
        return F.struct((s["usd"] + extra).alias("filled"), s["used"].alias("levels_used"),
                        ((s["usd"] + extra) / F.nullif(base, F.lit(0.0))).alias("vwap"))

    return F.aggregate(side_levels, zero, step, finish)


def walk_vwap(notional: Column, side: Column, n: int = 10, leftover: bool = True) -> Column:
    """VWAP of a marketable order; null when nothing can be filled."""
    lv = F.when(side == "buy", levels("ask", n)).otherwise(levels("bid", n))
    return walk(notional, lv, leftover)["vwap"]


def slippage_bps(notional: Column, side: Column, n: int = 10) -> Column:
    """Cost against the mid in bps, never below zero."""
    sign = F.when(side == "buy", 1.0).otherwise(-1.0)
    return F.greatest(sign * (walk_vwap(notional, side, n) - mid()) / mid() * 1e4, F.lit(0.0))


def fill_columns(df: DataFrame, notional: Column, side: Column, n: int = 10) -> DataFrame:
    """Partial-fill walk: ``vwap``, ``filled``, ``levels_used``."""
    lv = F.when(side == "buy", levels("ask", n)).otherwise(levels("bid", n))
    return (df.withColumn("_w", walk(notional, lv, False))
            .withColumns({k: c(f"_w.{k}") for k in ("vwap", "filled", "levels_used")}).drop("_w"))


def book_columns(n: int = 10) -> list[str]:
    return [f"{s}_{k}_{i}" for i in range(1, n + 1) for s in ("bid", "ask") for k in ("px", "sz")]


def book_at(rows: DataFrame, book: DataFrame, cols: Sequence[str], row_id: str, width_us: int = DAY_US) -> DataFrame:
    """Latest snapshot at or before each row."""
    return asof_backward(rows, book, ["symbol"], list(cols), "ts", row_id, "seq", width_us)


def update_share(last_mid: DataFrame) -> DataFrame:
    """Per symbol-day share of bars whose mid differs from the previous bar's.  A symbol-day holds at
    most one row per bar of the day."""
    w = Window.partitionBy("symbol", "day").orderBy("i")
    d = last_mid.withColumn("_p", F.lag("mid").over(w)).where("_p IS NOT NULL")
    return d.groupBy("symbol", "day").agg(
        F.avg((c("mid") != c("_p")).cast("double")).alias("update_share"), F.count(F.lit(1)).alias("n"))
