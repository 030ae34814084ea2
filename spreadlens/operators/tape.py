"""Trade-tape operators: signs, size classes, marketable orders, sweeps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import DAY_US, chunk_ends, chunked, running_sum, with_ends

c = F.col

# fixed values: upper bounds (exclusive) of the size classes, in quote currency
SIZE_BOUNDS = (("retail", 1_000.0), ("mid", 10_000.0), ("large", 100_000.0))
TOP_CLASS = "institutional"


def aggressor_sign(side: str = "side") -> Column:
    return F.when(c(side) == "buy", 1).when(c(side) == "sell", -1).otherwise(0)


def size_bucket(notional: str = "notional") -> Column:
    out = F
    for name, top in SIZE_BOUNDS:
        out = out.when(c(notional) < top, name)
    return out.otherwise(TOP_CLASS)


def size_class3(notional: str = "notional") -> Column:
    return F.when(c(notional) < 1_000.0, "retail").when(c(notional) >= 10_000.0, "institutional").otherwise("mid")


def _signs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width_us: int) -> DataFrame:
    """``_tick`` (sign of the last price change, 0 before the first) and ``_mid`` (the last one) of rows with ``price``
    on trades and ``_r`` (a struct with the mid) on quotes, in one pass; keeps ``_chunk`` and the rows' partitioning.

    Inside a chunk only the first trade's change depends on earlier chunks: until a later change, all its prices are the
    first one.  So a chunk's last row, with its running values, is all that the next chunks need."""
    keys, order = list(keys), list(order)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    change = lambda now, then: F.nullif(F.signum(now - then).cast("int"), F.lit(0))
    d = chunked(rows, keys, width_us)
    d = d.withColumn("_t", change(c("price"), F.last("price", ignorenulls=True).over(before)))
    d = d.withColumns({"_t": F.last("_t", ignorenulls=True).over(here), "_f": F.first("price", ignorenulls=True).over(here),
                       "_l": F.last("price", ignorenulls=True).over(here), "_q": F.last("_r", ignorenulls=True).over(here)})
    scan = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    e = chunk_ends(d, keys, order).withColumn("_pp", F.last("_e._l", ignorenulls=True).over(scan))
    e = e.withColumn("_own", F.coalesce("_e._t", change(c("_e._f"), c("_pp"))))
    e = e.select(*keys, "_chunk", "_pp", F.last("_own", ignorenulls=True).over(scan).alias("_pt"), F.last("_e._q", ignorenulls=True).over(scan).alias("_pq"))
    d = with_ends(d, e, keys)
    tick = F.coalesce("_t", change(c("_f"), c("_pp")), "_pt", F.lit(0))
    return d.withColumns({"_tick": tick, "_mid": F.coalesce("_q", "_pq")["mid"]}).drop("_t", "_f", "_l", "_q", "_pp", "_pt", "_pq", "_r")


_QUOTE = "struct<mid:double>"


def tick_rule(trades: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "trade_id"),
              width_us: int = DAY_US, out: str = "tick_sign") -> DataFrame:
    """Sign of the last price change, carried over ties; 0 before the first change."""
    d = _signs(trades.withColumn("_r", F.lit(None).cast(_QUOTE)), keys, order, width_us)
    return d.drop("_mid", "_chunk").withColumnRenamed("_tick", out)


def quote_rule(trades: DataFrame, book: DataFrame, width_us: int = DAY_US, out: str = "quote_sign") -> DataFrame:
    """Price against the prevailing mid; at the mid or without a book the tick rule decides.  Quotes of the same time come first."""
    mid = ((c("bid_px_1") + c("ask_px_1")) / 2).cast("double").alias("mid")
    b = book.select("symbol", "ts", F.lit(0).alias("_kind"), c("seq").cast("long").alias("_ord"), F.struct(mid).alias("_r"))
    t = trades.withColumns({"_kind": F.lit(1), "_ord": c("trade_id").cast("long"), "_r": F.lit(None).cast(_QUOTE)})
    d = _signs(t.unionByName(b, allowMissingColumns=True), ["symbol"], ["ts", "_kind", "_ord"], width_us).where("_kind = 1")
    s = F.when(c("price") > c("_mid"), 1).when(c("price") < c("_mid"), -1).otherwise(c("_tick"))
    return d.withColumn(out, s.cast("int")).select(*trades.columns, out)


def signed_trades(trades: DataFrame, book: DataFrame | None = None, width_us: int = DAY_US) -> DataFrame:
    """Exchange side first, then quote rule (with a book) or tick rule; plus signed notional and class."""
    d = (quote_rule(trades, book, width_us, "_fallback") if book is not None
         else tick_rule(trades, width_us=width_us, out="_fallback"))
    sign = F.when(aggressor_sign() != 0, aggressor_sign()).otherwise(c("_fallback")).cast("int")
    return d.withColumn("trade_sign", sign).drop("_fallback").withColumns({
        "signed_notional": c("trade_sign") * c("notional"), "bucket": size_bucket()})


def marketable_orders(trades: DataFrame) -> DataFrame:
    """Fills of one ``(symbol, ts, side)`` are one order."""
    return trades.where(c("side") != "").groupBy("symbol", "ts", "side").agg(
        F.sum("notional").alias("notional"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_fills"),
        F.max_by("price", "trade_id").alias("last_price"), F.min("trade_id").alias("order_id"))


def sweeps(trades: DataFrame, max_gap_ms: int = 50, width_us: int = DAY_US) -> DataFrame:
    """Runs of same-sign trades with small gaps that touched at least two prices.

    Runs are numbered inside chunks first; a chunk's first run may be the last one of the chunk before it."""
    keys, order = ["symbol"], ["ts", "trade_id"]
    own = trades.select(*keys, *order, "price", "side", "notional", F.lit(None).cast(_QUOTE).alias("_r"))
    d = _signs(own, keys, order, width_us).drop("_mid")
    d = d.withColumn("sign", F.when(aggressor_sign() != 0, aggressor_sign()).otherwise(c("_tick")).cast("int"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    gap_ms = lambda now, then: F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1000)
    goes_on = lambda sign, ts, old_sign, old_ts: F.coalesce((sign == old_sign) & (gap_ms(ts, old_ts) <= max_gap_ms), F.lit(False))
    d = d.withColumn("_new", (~goes_on(c("sign"), c("ts"), F.lag("sign").over(w), F.lag("ts").over(w))).cast("long"))
    d = d.withColumns({"_run": F.sum("_new").over(here), "_fs": F.first("sign").over(here), "_ft": F.first("ts").over(here)})
    line = Window.partitionBy(*keys).orderBy("_chunk")
    e = chunk_ends(d, keys, order).withColumn("_p", F.lag("_e").over(line))
    e = e.withColumn("_on", goes_on(c("_e._fs"), c("_e._ft"), c("_p.sign"), c("_p.ts")).cast("long"))
    since = F.sum(c("_e._run") - c("_on")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    d = with_ends(d, e.select(*keys, "_chunk", (F.coalesce(since, F.lit(0)) - c("_on")).alias("_base")), keys)
    return (d.withColumn("run", c("_base") + c("_run")).groupBy("symbol", "run").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.first("sign").alias("side"),
        F.sum("notional").alias("notional"), F.count(F.lit(1)).alias("n_trades"),
        F.countDistinct("price").alias("levels_walked_est"))
        .where("n_trades >= 2 AND levels_walked_est >= 2").drop("run"))


def size_distribution(trades: DataFrame, thresholds: Sequence[float] = (1e3, 1e4, 1e5)) -> DataFrame:
    """Quantiles of trade notional and the share of volume above thresholds, per symbol."""
    from .inference import exact_quantiles
    q = exact_quantiles(trades, "notional", (0.5, 0.9, 0.99, 0.999), ["symbol"], ("p50", "p90", "p99", "p999"))
    s = trades.groupBy("symbol").agg(*[
        (F.sum(F.when(c("notional") >= x, c("notional")).otherwise(0.0)) / F.sum("notional")).alias(f"share_ge_{int(x)}")
        for x in thresholds])
    return q.join(s, "symbol")


def class_shares(trades: DataFrame) -> DataFrame:
    """Count and volume shares of the three size classes per symbol (window over 3 rows per symbol)."""
    w = Window.partitionBy("symbol")
    g = trades.groupBy("symbol", size_class3().alias("size_class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("notional").alias("usd"))
    return g.select("symbol", "size_class", "n", (c("n") / F.sum("n").over(w)).alias("count_share"),
                    (c("usd") / F.sum("usd").over(w)).alias("volume_share"))


def vpin_tape(trades: DataFrame, bucket_notional: float, window: int = 50, width_us: int = DAY_US) -> DataFrame:
    """Toxicity over equal-notional buckets of the tape: |buys - sells| / size, trailing mean.

    Bucket of a trade = floor(running notional / size), the running sum crossing chunks through
    summaries; the trailing mean runs over one row per bucket in index blocks.  Running notionals are
    decimals of six places: a sum of doubles depends on the chunks, and a trade that ends exactly on
    a border would fall on either side of it.
    """
    from pyspark.sql import Window
    d = trades.withColumn("_abs", F.abs("signed_notional").cast("decimal(20,6)"))
    d = running_sum(d, ["symbol"], ["ts", "trade_id"], {"_cum": "_abs"}, width_us)
    g = (d.withColumn("bucket_no", F.floor(c("_cum").cast("double") / bucket_notional))
         .groupBy("symbol", "bucket_no").agg(
             F.sum(F.greatest("signed_notional", F.lit(0.0))).alias("_b"),
             F.sum(F.greatest(-c("signed_notional"), F.lit(0.0))).alias("_s"), F.max("ts").alias("end_ts"))
         .withColumn("imbalance", F.abs(c("_b") - c("_s")) / bucket_notional))
    # empty buckets are possible when one trade jumps several, so number the buckets that exist
    from ..core.ordered import block_window, core_rows, halo_blocks, row_index
    g = row_index(g, ["symbol"], ["end_ts", "bucket_no"], "k", 30 * DAY_US, ts="end_ts")
    h = halo_blocks(g, "k", back=window)
    w = block_window(["symbol"], "k").rowsBetween(-(window - 1), 0)
    return core_rows(h.withColumn("vpin", F.avg("imbalance").over(w))).select(
        "symbol", "bucket_no", "end_ts", "imbalance", "vpin")
