"""Execution-cost study as tables: parent orders, immediate cost, passive outcome, policies."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..core.ordered import DAY_US, SECOND_US, int_div
from ..core.session import checkpointed
from . import book as K
from .inference import exact_quantiles, hash_unit, safe_corr

c = F.col


def parent_orders(book: DataFrame, cadence_us: int, notionals: Sequence[float], seed: int, warmup_us: int = 60 * SECOND_US,
                  tail_us: int = 70 * SECOND_US) -> DataFrame:
    """A fixed-cadence grid per symbol-day between its first and last snapshot; the side of each order by a digest of symbol, time and seed."""
    d = book.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        (F.unix_micros(F.min("ts")) + warmup_us).alias("_a"), (F.unix_micros(F.max("ts")) - tail_us).alias("_b")).where(c("_b") >= c("_a"))
    d = d.withColumn("t0", F.explode(F.sequence("_a", "_b", F.lit(cadence_us)))).drop("_a", "_b")
    digit = F.substring(F.md5(F.concat_ws("|", c("symbol"), c("t0").cast("string"), F.lit(str(seed)))), 1, 1)
    d = d.withColumns({"side": F.when(digit < "8", "buy").otherwise("sell"), "ts": F.timestamp_micros("t0")})
    return (d.withColumn("notional", F.explode(F.array(*[F.lit(float(x)) for x in notionals])))
            .withColumn("order_id", F.xxhash64("symbol", "t0", "notional")))


def immediate_cost(orders: DataFrame, book: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """Arrival mid, spread, posted price, queue ahead and the cost of crossing now (bps)."""
    d = K.book_at(orders, book, K.book_columns(), "order_id", width_us).where(
        c("bid_px_1").isNotNull() & (c("ask_px_1") > c("bid_px_1")))
    sgn = F.when(c("side") == "buy", 1.0).otherwise(-1.0)
    m0 = K.mid()
    return d.withColumns({"m0": m0, "spread_bps": K.quoted_spread_bps(), "sgn": sgn,
                          "cost_agg": sgn * (K.walk_vwap(c("notional"), c("side")) - m0) / m0 * 1e4,
                          "post_px": F.when(c("side") == "buy", c("bid_px_1")).otherwise(c("ask_px_1")),
                          "queue": F.when(c("side") == "buy", c("bid_sz_1")).otherwise(c("ask_sz_1")).cast("double")}
                         ).drop(*K.book_columns())


def passive_outcome(orders: DataFrame, trades: DataFrame, book: DataFrame, horizon_us: int, queue_share: float = 1.0,
                    width_us: int = DAY_US) -> DataFrame:
    """Post at the best price and wait: filled at the first trade that brings opposite-aggressor volume
    at or through the price to queue + size, else cross at ``t0 + H``.

    Orders meet the tape on (symbol, time bucket of length H): an order touches exactly two buckets,
    so the candidate set is bounded by the tape itself, and rows outside ``(t0, t0+H]`` are dropped in the
    join condition.  A later as-of join prices the unfilled ones.
    """
    o = orders.withColumn("_b0", int_div(c("t0"), horizon_us))
    o2 = o.withColumn("_b", F.explode(F.array(c("_b0"), c("_b0") + 1)))
    t = trades.where(c("side") != "").select(
        c("symbol").alias("_s"), int_div(F.unix_micros("ts"), horizon_us).alias("_tb"), F.unix_micros("ts").alias("_tu"),
        c("side").alias("_ts"), c("price").alias("_tp"), c("amount").cast("double").alias("_ta"), "trade_id")
    cond = ((c("symbol") == c("_s")) & (c("_b") == c("_tb")) & (c("_tu") > c("t0")) & (c("_tu") <= c("t0") + horizon_us)
            & (((c("side") == "buy") & (c("_ts") == "sell") & (c("_tp") <= c("post_px")))
               | ((c("side") == "sell") & (c("_ts") == "buy") & (c("_tp") >= c("post_px")))))
    hits = o2.join(t, cond).select("order_id", "_tu", "trade_id", "_ta", (c("queue") * queue_share + c("notional") / c("m0")).alias("_need"))
    w = Window.partitionBy("order_id").orderBy("_tu", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    fills = (hits.withColumn("_cum", F.sum("_ta").over(w)).where(c("_cum") >= c("_need"))
             .groupBy("order_id").agg(F.min("_tu").alias("fill_us")))
    fills = checkpointed(fills)   # one row per filled order, read by both branches below
    d = o.join(fills, "order_id", "left").drop("_b0")
    late = d.where("fill_us IS NULL").withColumn("ts", F.timestamp_micros(c("t0") + horizon_us))
    late = K.book_at(late.select("symbol", "ts", "order_id", "side", "notional"), book, K.book_columns(), "order_id", width_us)
    late = late.select("order_id", K.walk_vwap(c("notional"), c("side")).alias("_late"))
    d = d.join(late, "order_id", "left")
    px = F.when(c("fill_us").isNotNull(), c("post_px")).otherwise(c("_late"))
    return d.withColumns({"filled": c("fill_us").isNotNull(), "fill_dt": (c("fill_us") - c("t0")) / SECOND_US,
                          "cost_passive": c("sgn") * (px - c("m0")) / c("m0") * 1e4}).drop("_late", "fill_us")


def window_signals(orders: DataFrame, events: DataFrame, window_us: int) -> DataFrame:
    """Book flow and cancel imbalance over the trailing window at order time (zero where nothing happened).

    ``events`` are flow events; as for passive outcomes an order meets two time buckets only.
    """
    o = orders.select("order_id", "symbol", "t0", F.explode(F.array(int_div(c("t0"), window_us), int_div(c("t0"), window_us) - 1)).alias("_b")).distinct()
    e = events.select(c("symbol").alias("_s"), F.unix_micros("ts").alias("_u"), int_div(F.unix_micros("ts"), window_us).alias("_eb"), "ofi", "bid_dec", "ask_dec")
    cond = (c("symbol") == c("_s")) & (c("_b") == c("_eb")) & (c("_u") > c("t0") - window_us) & (c("_u") <= c("t0"))
    g = o.join(e, cond).groupBy("order_id").agg(F.sum("ofi").alias("book_ofi"), F.sum("bid_dec").alias("_bd"), F.sum("ask_dec").alias("_ad"))
    g = g.select("order_id", "book_ofi", F.coalesce((c("_ad") - c("_bd")) / F.nullif(c("_ad") + c("_bd"), F.lit(0.0)), F.lit(0.0)).alias("cancel_imb"))
    return orders.join(g, "order_id", "left").na.fill(0.0, ["book_ofi", "cancel_imb"])


def policies(d: DataFrame) -> DataFrame:
    """Signal-timed posting, its flip, the best and the worst choice in hindsight."""
    ok = F.when(c("side") == "buy", (c("book_ofi") >= 0) & (c("cancel_imb") >= 0)).otherwise((c("book_ofi") <= 0) & (c("cancel_imb") <= 0))
    d = d.withColumn("posted", ok)
    p, a = c("cost_passive"), c("cost_agg")
    return d.withColumns({"cost_timed": F.when(ok, p).otherwise(a), "cost_flip": F.when(ok, a).otherwise(p),
                          "cost_oracle": F.least(p, a), "cost_anti": F.greatest(p, a)})


def cost_table(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median and tail costs, fill and post rates over the rollup of ``keys``; quantiles are exact and no group is one task."""
    label = lambda k: F.coalesce(c(k).cast("string"), F.lit("ALL"))
    levels = [F.struct(*[(label(k) if i < n else F.lit("ALL")).alias(k) for i, k in enumerate(keys)]) for n in range(len(keys) + 1)]
    each = d.select("cost_passive", F.explode(F.array(*levels)).alias("_level")).select("cost_passive", "_level.*")
    tails = exact_quantiles(each, "cost_passive", (0.5, 0.9, 0.95), keys, ("p50", "p90", "p95"))
    g = d.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in ("cost_agg", "cost_passive", "cost_timed", "cost_flip", "cost_oracle", "cost_anti")],
        (F.avg(c("filled").cast("double")) * 100).alias("fill_pct"), (F.avg(c("posted").cast("double")) * 100).alias("post_pct"))
    return g.withColumns({k: label(k) for k in keys}).join(tails, list(keys), "left")


def signal_correlations(d: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    diff = c("cost_passive") - c("cost_agg")
    s = c("sgn")
    fill = c("filled").cast("double")
    return d.groupBy(*keys).agg(
        safe_corr(c("book_ofi") * s, diff).alias("ofi_vs_cost"), safe_corr(c("cancel_imb") * s, diff).alias("cancel_vs_cost"),
        safe_corr("spread_bps", diff).alias("spread_vs_cost"), safe_corr(F.abs("book_ofi"), diff).alias("abs_ofi_vs_cost"),
        safe_corr(c("book_ofi") * s, fill).alias("ofi_vs_fill"), F.count(F.lit(1)).alias("n"))


def random_policy(d: DataFrame, reps: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Same-rate random posting: each replicate posts an order when its hash falls below the post rate."""
    rate = d.groupBy(*keys).agg(F.avg(c("posted").cast("double")).alias("_p"))
    e = d.join(rate, list(keys)) if keys else d.join(F.broadcast(rate))
    e = e.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    e = e.withColumn("_c", F.when(hash_unit("symbol", "t0", c("notional").cast("bigint"), "rep", F.lit(seed)) < c("_p"), c("cost_passive")).otherwise(c("cost_agg")))
    r = e.groupBy(*keys, "rep").agg(F.avg("_c").alias("m"))
    return r.groupBy(*keys).agg(F.avg("m").alias("placebo_mean"), F.stddev_pop("m").alias("placebo_sd"))
