"""Time-bucket aggregation.  Bars are right-closed and right-labelled unless a name says otherwise."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.ordered import (DAY_US, HOUR_US, MINUTE_US, block_window, carry_forward, core_rows, halo_blocks,
                            int_div, previous_row)
from . import book as K
from .panel import bar_index, index_ts
from .tape import signed_trades

c = F.col


def right_edge(ts: str | Column, step_us: int) -> Column:
    """End of the ``(t - step, t]`` bar holding a time stamp; an exact edge stays in the earlier bar."""
    u = F.unix_micros(c(ts) if isinstance(ts, str) else ts)
    return F.timestamp_micros(int_div(u + (step_us - 1), step_us) * step_us)


def left_edge(ts: str | Column, step_us: int) -> Column:
    return index_ts(bar_index(ts, step_us), step_us)


def sum_if(value: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def trade_bars(trades: DataFrame, step_us: int) -> DataFrame:
    """Count, base/quote volume, buy/sell split, signed volume, VWAP of non-empty bars."""
    a, buy, sell = c("amount"), c("side") == "buy", c("side") == "sell"
    return (trades.groupBy("symbol", right_edge("ts", step_us).alias("ts")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(a).cast("double").alias("volume_base"),
        F.sum("notional").alias("volume_quote"), sum_if(a, buy).cast("double").alias("buy_volume_base"),
        sum_if(a, sell).cast("double").alias("sell_volume_base"))
        .withColumn("signed_volume_base", c("buy_volume_base") - c("sell_volume_base"))
        .withColumn("vwap", c("volume_quote") / F.nullif(c("volume_base"), F.lit(0.0))))


def book_bars(book: DataFrame, step_us: int, depth: int = 5) -> DataFrame:
    """Last microprice, mid, spread and imbalance of each bar: one aggregate, no sort."""
    state = F.struct(K.microprice().alias("microprice"), K.mid().alias("midprice"),
                     K.quoted_spread_bps().alias("quoted_spread_bps"), K.imbalance(depth).alias(f"obi_{depth}"))
    return (book.groupBy("symbol", right_edge("ts", step_us).alias("ts"))
            .agg(F.max_by(state, F.struct("ts", "seq")).alias("_s")).select("symbol", "ts", "_s.*"))


FLOW = ["trade_count", "trade_notional", "buy_notional", "sell_notional", "signed_notional",
        "signed_notional_retail", "signed_notional_mid", "signed_notional_large", "signed_notional_institutional",
        "inst_buy_notional", "inst_sell_notional", "retail_buy_notional", "retail_sell_notional"]


def flow_bars(signed: DataFrame, step_us: int) -> DataFrame:
    """All flow sums of signed trades in one conditional aggregate."""
    n, s, b = c("notional"), c("trade_sign"), c("bucket")
    return signed.groupBy("symbol", right_edge("ts", step_us).alias("ts")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(n).alias("trade_notional"),
        sum_if(n, s > 0).alias("buy_notional"), sum_if(n, s < 0).alias("sell_notional"),
        F.sum("signed_notional").alias("signed_notional"),
        *[sum_if(c("signed_notional"), b == k).alias(f"signed_notional_{k}") for k in ("retail", "mid", "large", "institutional")],
        sum_if(n, (b == "institutional") & (s > 0)).alias("inst_buy_notional"),
        sum_if(n, (b == "institutional") & (s < 0)).alias("inst_sell_notional"),
        sum_if(n, (b == "retail") & (s > 0)).alias("retail_buy_notional"),
        sum_if(n, (b == "retail") & (s < 0)).alias("retail_sell_notional"))


def bars(book: DataFrame, trades: DataFrame | None, step_us: int, depth: int = 5, width_us: int = DAY_US) -> DataFrame:
    """Book bars joined full-outer with flow bars; book state carries forward, flow is zero when absent."""
    b = book_bars(book, step_us, depth)
    state = ["microprice", "midprice", "quoted_spread_bps", f"obi_{depth}"]
    if trades is None:
        return b.withColumns({f: F.lit(0.0) for f in FLOW}).where("microprice IS NOT NULL")
    f = flow_bars(signed_trades(trades, book, width_us), step_us)
    d = b.join(f, ["symbol", "ts"], "full_outer")
    d = carry_forward(d, ["symbol"], ["ts"], state, width_us)
    return (d.withColumns({x: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in FLOW})
            .where("microprice IS NOT NULL"))


def pair_bars(all_bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both legs' bars on the shared bar times, suffixed ``_a`` / ``_b``."""
    return pair_legs(all_bars, pairs.select("pair", "sym_a", "sym_b"), "ts")


SALTS = 16


def fan_out(rows: DataFrame, pairs: DataFrame, leg: str, at: str) -> DataFrame:
    """A leg's rows once for each pair it belongs to.  A busy symbol is dealt over ``SALTS`` join keys by time."""
    salt = F.pmod(F.xxhash64(at), F.lit(SALTS)).cast("int")
    p = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumnRenamed("symbol", f"sym_{leg}").withColumn("_salt", salt).join(p, [f"sym_{leg}", "_salt"]).drop("_salt")


def pair_legs(rows: DataFrame, pairs: DataFrame, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """Both legs' rows of every pair where they share ``at`` (and ``keys``); other columns get ``_a`` / ``_b``."""
    cols = [x for x in rows.columns if x not in ("symbol", at, *keys)]
    leg = lambda x: rows.select("symbol", at, *keys, *[c(v).alias(f"{v}_{x}") for v in cols])
    b = fan_out(leg("b"), pairs.select("pair", "sym_b"), "b", at).drop("sym_b")
    return fan_out(leg("a"), pairs, "a", at).join(b, ["pair", *keys, at])


def dense_mid(book: DataFrame, step_us: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Last mid of each left-closed bucket on a full grid per symbol-day, carried inside the day.

    The grid of a symbol-day is unfolded from that day's own row (``sequence`` + ``explode``)."""
    cols = {"mid": K.mid(), **(extra or {})}
    last = (book.groupBy("symbol", F.to_date("ts").alias("day"), bar_index("ts", step_us).alias("i"))
            .agg(F.max_by(F.struct(*[e.alias(k) for k, e in cols.items()]), F.struct("ts", "seq")).alias("_s"))
            .select("symbol", "day", "i", "_s.*"))
    return fill_days(last, step_us, list(cols))


def day_grid(days: DataFrame, step_us: int) -> DataFrame:
    n = DAY_US // step_us
    first = F.datediff(c("day"), F.lit("1970-01-01").cast("date")).cast("long") * n
    return days.withColumn("i", F.explode(F.sequence(first, first + (n - 1))))


def fill_days(last: DataFrame, step_us: int, cols: Sequence[str]) -> DataFrame:
    grid = day_grid(last.select("symbol", "day").distinct(), step_us)
    d = grid.join(last, ["symbol", "day", "i"], "left").withColumn("ts", index_ts("i", step_us))
    # a day's grid is bounded by its length, so one window per symbol-day
    return carry_forward(d, ["symbol", "day"], ["ts"], list(cols), HOUR_US)


def hourly_mid_flow(book: DataFrame, trades: DataFrame) -> DataFrame:
    """Left-closed hours: last mid, signed flow, volume and count."""
    h = left_edge("ts", HOUR_US).alias("ts")
    m = book.groupBy("symbol", h).agg(F.max_by(K.mid(), F.struct("ts", "seq")).alias("mid"))
    sign = F.when(c("side") == "buy", 1).when(c("side") == "sell", -1).otherwise(0)
    f = trades.groupBy("symbol", h).agg(F.sum(sign * c("amount")).alias("signed_volume"),
                                        F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
    return m.join(f, ["symbol", "ts"])


def class_flow_bars(book: DataFrame, trades: DataFrame, step_us: int) -> DataFrame:
    """Signed USD by size class, end mid, bar return and next-bar return inside the day."""
    from .tape import aggressor_sign, size_class3
    s = aggressor_sign() * c("notional")
    f = (trades.withColumns({"_s": s, "_k": size_class3()})
         .groupBy("symbol", F.to_date("ts").alias("day"), bar_index("ts", step_us).alias("i")).agg(
             F.sum("_s").alias("flow_total"), F.sum("notional").alias("volume"),
             *[sum_if(c("_s"), c("_k") == k).alias(f"flow_{k}") for k in ("retail", "mid", "institutional")]))
    m = dense_mid(book, step_us).where("mid IS NOT NULL").select("symbol", "day", "i", "mid")
    d = m.join(f, ["symbol", "day", "i"], "left").na.fill(0.0)
    d = halo_blocks(d, "i", back=1, fwd=1, rows=max(2, DAY_US // step_us))
    w = block_window(["symbol", "day"], "i")
    r = F.log("mid")
    d = core_rows(d.withColumns({"ret": r - F.lag(r).over(w), "ret_next": F.lead(r).over(w) - r}))
    share = {f"share_{k}": c(f"flow_{k}") / F.nullif(c("volume"), F.lit(0.0)) for k in ("retail", "mid", "institutional")}
    return d.withColumns(share).withColumn("ts", index_ts("i", step_us))


def realised_measures(book: DataFrame, trades: DataFrame) -> DataFrame:
    """Hourly realised variance (1 and 5 minutes), bipower variation, jumps, spread and imbalance
    statistics, absolute flow and toxicity."""
    d = dense_mid(book, MINUTE_US, {"spr": K.relative_spread(),
                                    "imb": (c("bid_sz_1") - c("ask_sz_1")) / (c("bid_sz_1") + c("ask_sz_1") + 1e-12)})
    h = halo_blocks(d, "i", back=7, rows=1440)
    w = block_window(["symbol", "day"], "i")
    lm = F.log("mid")
    h = h.withColumns({"r1": lm - F.lag(lm).over(w), "r5": F.when(c("i") % 5 == 4, lm - F.lag(lm, 5).over(w)),
                       "chg": (F.abs(c("mid") - F.lag("mid").over(w)) > 0).cast("double")})
    h = core_rows(h.withColumn("bp", F.abs("r1") * F.abs(F.lag("r1").over(w))))
    g = h.groupBy("symbol", int_div(c("i"), 60).alias("hour")).agg(
        F.coalesce(F.sum(c("r1") * c("r1")), F.lit(0.0)).alias("rv1_var"),
        F.coalesce(F.sum(c("r5") * c("r5")), F.lit(0.0)).alias("rv5_var"),
        (F.coalesce(F.sum("bp"), F.lit(0.0)) * F.pi() / 2).alias("bpv"),
        F.coalesce(F.sum("chg"), F.lit(0.0)).alias("qupd"),
        F.avg("spr").alias("spr_m"), F.stddev_samp("spr").alias("spr_s"),
        F.avg("imb").alias("imb_m"), F.stddev_samp("imb").alias("imb_s"))
    buy, sell = sum_if(c("amount"), c("side") == "buy"), sum_if(c("amount"), c("side") == "sell")
    f = trades.groupBy("symbol", bar_index("ts", HOUR_US).alias("hour")).agg(
        F.count(F.lit(1)).alias("tcnt"), F.sum("amount").alias("tvol"), buy.alias("_b"), sell.alias("_s"))
    return (g.join(f, ["symbol", "hour"], "left").na.fill(0, ["tcnt", "tvol", "_b", "_s"])
            .withColumns({"jump": F.greatest(c("rv1_var") - c("bpv"), F.lit(0.0)), "rv": F.sqrt("rv1_var"),
                          "absflow": F.abs(c("_b") - c("_s")),
                          "toxicity": F.abs(c("_b") - c("_s")) / F.nullif(c("_b") + c("_s"), F.lit(0)),
                          "ts": index_ts("hour", HOUR_US)}).drop("_b", "_s"))


def hourly_price_features(book: DataFrame, trades: DataFrame) -> DataFrame:
    """Per hour number: log return, realised vol from minute closes, normalised flow, count, mean spread."""
    hour, minute = bar_index("ts", HOUR_US), bar_index("ts", MINUTE_US)
    t = trades.where(c("side") != "")
    m = t.groupBy("symbol", hour.alias("hour"), minute.alias("minute")).agg(
        F.min_by("price", F.struct("ts", "trade_id")).alias("p0"), F.max_by("price", F.struct("ts", "trade_id")).alias("p1"),
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"),
        F.sum(F.when(c("side") == "buy", c("amount")).otherwise(-c("amount"))).alias("s"))
    # at most 60 minute rows per symbol-hour
    from pyspark.sql import Window
    r = F.log("p1") - F.lag(F.log("p1")).over(Window.partitionBy("symbol", "hour").orderBy("minute"))
    g = m.withColumn("r", r).groupBy("symbol", "hour").agg(
        F.sqrt(F.sum(c("r") * c("r"))).alias("rv"),
        (F.log(F.max_by("p1", "minute")) - F.log(F.min_by("p0", "minute"))).alias("ret"),
        F.sum("n").alias("trade_count"), (F.sum("s") / F.sum("v")).alias("ofi_norm"))
    s = book.groupBy("symbol", hour.alias("hour")).agg(F.avg(K.relative_spread()).alias("rel_spread"))
    return g.join(s, ["symbol", "hour"], "left")


def hourly_spread_targets(spread: DataFrame, min_obs: int = 60) -> DataFrame:
    """Per pair-hour: std of one-bar spread changes (bps), absolute and signed move."""
    h = halo_blocks(spread, "i", back=1, rows=86_400)
    d = core_rows(h.withColumn("_d", c("spread") - F.lag("spread").over(block_window(["pair"], "i"))))
    return (d.groupBy("pair", left_edge("ts", HOUR_US).alias("hour_ts")).agg(
        (F.stddev_samp("_d") * 1e4).alias("spread_vol_bps"),
        ((F.max_by("spread", "i") - F.min_by("spread", "i")) * 1e4).alias("move_bps"), F.count("_d").alias("n"))
        .where(c("n") >= min_obs).withColumn("abs_move_bps", F.abs("move_bps")))


def period_pnl(pnl: DataFrame, unit: str, keys: Sequence[str] = (), value: str = "pnl") -> DataFrame:
    """P&L per day/week/month without the empty periods."""
    return (pnl.groupBy(*keys, F.date_trunc(unit, "ts").alias("period")).agg(F.sum(value).alias("pnl"))
            .where(c("pnl") != 0))
