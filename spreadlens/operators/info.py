"""Order-flow information: hourly imbalance, toxicity, impact, cancellations, hidden liquidity, lead-lag."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import (BLOCK_ROWS, DAY_US, HOUR_US, SECOND_US, block_window, carry_forward, core_rows, halo_blocks, int_div,
                            previous_row, running_sum)
from . import book as K
from .bars import fill_days, left_edge, right_edge, sum_if
from .inference import exact_quantiles, safe_corr
from .panel import bar_index, index_ts

c = F.col


def hourly_flow(bars: DataFrame) -> DataFrame:
    """Right-closed hours of trade bars: OFI = signed / base volume, quote volume, intensity."""
    return bars.groupBy("symbol", right_edge("ts", HOUR_US).alias("ts")).agg(
        F.sum("volume_quote").alias("volume_quote"), F.sum("trade_count").alias("trade_intensity"),
        F.sum("signed_volume_base").alias("signed_volume"), F.sum("volume_base").alias("total_volume_base")
    ).withColumn("order_flow_imbalance", c("signed_volume") / F.nullif(c("total_volume_base"), F.lit(0.0)))


def vpin_hour(bars: DataFrame, buckets: int = 50) -> DataFrame:
    """Toxicity per hour from equal-volume buckets of its bars; an hour holds a bounded number of bars."""
    d = bars.withColumn("hour_ts", right_edge("ts", HOUR_US))
    k = ["symbol", "hour_ts"]
    w = Window.partitionBy(*k)
    v = c("buy_volume_base") + c("sell_volume_base")
    d = d.withColumns({"_v": v, "_cum": F.sum(v).over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)),
                       "_tot": F.sum(v).over(w)}).where(c("_tot") > 0)
    d = d.withColumn("_b", F.least(F.floor(c("_cum") * buckets / c("_tot")), F.lit(buckets - 1)))
    g = d.groupBy(*k, "_b").agg(F.sum(F.abs(c("buy_volume_base") - c("sell_volume_base"))).alias("_i"), F.sum("_v").alias("_v"))
    return g.where(c("_v") > 0).groupBy("symbol", c("hour_ts").alias("ts")).agg(F.avg(c("_i") / c("_v")).alias("vpin"))


def vpin_day(bars: DataFrame, buckets: int = 50, window: int = 5) -> DataFrame:
    """Volume-clock toxicity per day (rolling mean over buckets), averaged by the hour of bucket close."""
    d = bars.withColumn("day", F.to_date("ts"))
    tot = d.groupBy("symbol", "day").agg(F.sum("volume_base").alias("_tot")).where(c("_tot") > 0)
    d = running_sum(d, ["symbol", "day"], ["ts"], {"_cum": "volume_base"}, HOUR_US).join(tot, ["symbol", "day"])
    d = d.withColumn("_b", F.least(F.floor(c("_cum") * buckets / c("_tot")), F.lit(buckets - 1)))
    g = d.groupBy("symbol", "day", "_b").agg(F.sum("buy_volume_base").alias("b"), F.sum("sell_volume_base").alias("s"),
                                             F.sum("volume_base").alias("v"), F.max("ts").alias("close_ts")).where(c("v") > 0)
    w = Window.partitionBy("symbol", "day").orderBy("_b")     # at most `buckets` rows
    f = w.rowsBetween(-(window - 1), 0)
    n_all = F.count(F.lit(1)).over(Window.partitionBy("symbol", "day"))
    g = g.withColumn("tox", F.abs(c("b") - c("s")) / c("v")).withColumns({
        "vpin": F.when(F.count("tox").over(f) >= window, F.avg("tox").over(f)), "_n": n_all})
    return (g.where((c("_n") >= window + 1) & c("vpin").isNotNull())
            .groupBy("symbol", left_edge("close_ts", HOUR_US).alias("hour_ts")).agg(F.avg("vpin").alias("vpin")))


def mid_flow_rows(book: DataFrame, bars: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """Book and flow rows on their union of time stamps: mid carried forward, flow zero when absent.
    The hour key is floor + 1 h (left-closed), unlike the right-closed bars."""
    b = book.groupBy("symbol", "ts").agg(F.max_by(K.mid(), c("seq")).alias("mid"))
    f = bars.select("symbol", "ts", c("signed_volume_base").alias("sv"))
    d = carry_forward(b.join(f, ["symbol", "ts"], "full_outer"), ["symbol"], ["ts"], ["mid"], width_us)
    return (d.where("mid IS NOT NULL").withColumn("sv", F.coalesce("sv", F.lit(0.0)))
            .withColumn("hour_ts", F.timestamp_micros((bar_index("ts", HOUR_US) + 1) * HOUR_US)))


def kyle_lambda(rows: DataFrame, min_obs: int = 10) -> DataFrame:
    """Slope of the mid return on signed volume inside each hour (bounded rows per symbol-hour)."""
    w = Window.partitionBy("symbol", "hour_ts").orderBy("ts")
    d = rows.withColumn("_p", F.lag("mid").over(w)).withColumn("_r", (c("mid") - c("_p")) / c("_p"))
    g = d.where("_r IS NOT NULL").groupBy("symbol", c("hour_ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_r", "sv").alias("kyle_lambda"), F.var_pop("sv").alias("_v"))
    return g.where((c("n") >= min_obs) & (c("_v") > 0)).select("symbol", "ts", "n", "kyle_lambda")


def hourly_information(book: DataFrame, bars: DataFrame, min_obs: int = 10, width_us: int = DAY_US) -> DataFrame:
    """Symbol-hour table of all information features."""
    spread = book.groupBy("symbol", right_edge("ts", HOUR_US).alias("ts")).agg(F.avg(K.quoted_spread_bps()).alias("quoted_spread_bps"))
    return (hourly_flow(bars).join(vpin_hour(bars), ["symbol", "ts"], "left")
            .join(kyle_lambda(mid_flow_rows(book, bars, width_us), min_obs).drop("n"), ["symbol", "ts"], "left")
            .join(spread, ["symbol", "ts"], "left"))


INFO = ["order_flow_imbalance", "vpin", "kyle_lambda", "quoted_spread_bps", "trade_intensity"]


def enrich_pairs(features: DataFrame, info: DataFrame, cols: Sequence[str] = INFO) -> DataFrame:
    """Add ``micro_<col>_a/_b`` by left joins; uncovered rows stay null."""
    out = features
    for leg in "ab":
        out = out.join(info.select(c("symbol").alias(f"sym_{leg}"), "ts", *[c(x).alias(f"micro_{x}_{leg}") for x in cols]),
                       [f"sym_{leg}", "ts"], "left")
    return out


def cross_leg_signals(info: DataFrame, pairs: DataFrame) -> DataFrame:
    from .bars import pair_bars
    d = pair_bars(info, pairs)
    return d.withColumns({"ofi_divergence": c("order_flow_imbalance_a") - c("order_flow_imbalance_b"),
                          "vpin_max": F.greatest("vpin_a", "vpin_b"),
                          "volume_quote_ratio": c("volume_quote_a") / F.nullif(c("volume_quote_b"), F.lit(0.0))})


# ---- cancellations -------------------------------------------------------------------------------------

def cancel_buckets(book: DataFrame, trades: DataFrame, step_us: int = SECOND_US) -> DataFrame:
    """Per bucket: book and trade flow, size withdrawn at an unchanged best price, and the part of it no
    opposite trade explains.  Only buckets with activity are stored; the dense grid is never built."""
    b = K.flow_events(K.valid(book)).groupBy("symbol", "day", bar_index("ts", step_us).alias("i")).agg(
        F.sum("ofi").alias("book_ofi"), F.sum("bid_dec").alias("bid_dec"), F.sum("ask_dec").alias("ask_dec"))
    a = c("amount")
    t = trades.groupBy("symbol", F.to_date("ts").alias("day"), bar_index("ts", step_us).alias("i")).agg(
        sum_if(a, c("side") == "buy").alias("buy"), sum_if(a, c("side") == "sell").alias("sell"))
    d = b.join(t, ["symbol", "day", "i"], "full_outer").na.fill(0)
    d = d.withColumns({"trade_ofi": c("buy") - c("sell"),
                       "bid_cancel": F.greatest(c("bid_dec") - c("sell"), F.lit(0.0)),
                       "ask_cancel": F.greatest(c("ask_dec") - c("buy"), F.lit(0.0))})
    return d.withColumn("cancel_imb", c("bid_cancel") - c("ask_cancel"))


def cancel_share(buckets: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Cancelled over all withdrawn size: pooled buckets, and with day totals as the unit."""
    day = buckets.groupBy(*{*keys, "symbol", "day"}).agg(*[F.sum(x).alias(x) for x in ("bid_dec", "ask_dec", "buy", "sell", "bid_cancel", "ask_cancel")])
    dec = c("bid_dec") + c("ask_dec")
    net = F.greatest(c("bid_dec") - c("sell"), F.lit(0.0)) + F.greatest(c("ask_dec") - c("buy"), F.lit(0.0))
    return day.groupBy(*keys).agg(
        (F.sum(c("bid_cancel") + c("ask_cancel")) / F.nullif(F.sum(dec), F.lit(0.0))).alias("cancel_share"),
        (F.sum(net) / F.nullif(F.sum(dec), F.lit(0.0))).alias("cancel_share_day"))


def dense_flow(book: DataFrame, trades: DataFrame, step_us: int, trail: int, horizons: Sequence[int] = (1,)) -> DataFrame:
    """Dense grid per symbol-day with mid, flow, trailing sums and forward returns (all inside the day)."""
    from .bars import dense_mid
    m = dense_mid(book, step_us).select("symbol", "day", "i", F.log("mid").alias("lm"))
    d = m.join(cancel_buckets(book, trades, step_us), ["symbol", "day", "i"], "left")
    cols = ["book_ofi", "trade_ofi", "cancel_imb"]
    d = d.na.fill(0.0, [*cols, "bid_dec", "ask_dec", "bid_cancel", "ask_cancel", "buy", "sell"])
    # blocks of whole days: the day is the frame's hard border, and its grid has a fixed length
    w = Window.partitionBy("symbol", "day").orderBy("i")
    f = w.rowsBetween(-(trail - 1), 0)
    return d.withColumns({**{f"{x}_tr": F.sum(x).over(f) for x in cols}, "ret": c("lm") - F.lag("lm").over(w),
                          **{f"fwd{h}": F.lead("lm", h).over(w) - c("lm") for h in horizons}})


# ---- hidden liquidity -------------------------------------------------------------------------------------

def episodes(book: DataFrame, trades: DataFrame, tol: float = 1e-9, width_us: int = HOUR_US) -> DataFrame:
    """Runs of constant best price per side and symbol-day, with the aggressor volume executed at that
    price and the largest displayed size; only traded runs.

    Book rows and trades form one stream ordered by time with the book first on ties.  A run starts
    where the best price moves; the run number is a running count carried over hour chunks, so no
    symbol-day is held by one task.
    """
    d = K.with_day(book)
    legs = None
    for side in ("ask", "bid"):
        s = d.select("symbol", "day", "ts", F.lit(side).alias("side"), F.lit(0).alias("kind"), c("seq").cast("long").alias("ord"),
                     c(f"{side}_px_1").cast("double").alias("px"), c(f"{side}_sz_1").cast("double").alias("sz"))
        legs = s if legs is None else legs.unionByName(s)
    key, order = ["symbol", "day", "side"], ["ts", "kind", "ord"]
    legs = previous_row(legs, key, order, {"_pp": "px"}, width_us)
    moved = c("_pp").isNull() | (F.abs(c("px") - c("_pp")) > tol * c("_pp"))
    legs = legs.withColumn("new", moved.cast("long")).drop("_pp")
    t = K.with_day(trades).select(
        "symbol", "day", "ts", F.when(c("side") == "buy", "ask").otherwise("bid").alias("side"), F.lit(1).alias("kind"),
        c("trade_id").cast("long").alias("ord"), c("price").cast("double").alias("tpx"), c("amount").cast("double").alias("amt"),
        F.lit(0).cast("long").alias("new"))
    u = legs.unionByName(t, allowMissingColumns=True)
    u = running_sum(u, key, order, {"run": "new"}, width_us)
    u = carry_forward(u, key, order, ["px"], width_us)
    hit = (c("kind") == 1) & (F.abs(c("tpx") - c("px")) <= tol * c("px"))
    own = F.when(hit | (c("kind") == 0), c("ts"))
    g = u.where(c("run") > 0).groupBy(*key, "run").agg(
        F.min(F.when(c("kind") == 0, c("px"))).alias("price"), F.max("sz").alias("max_disp"),
        F.sum(F.when(hit, c("amt")).otherwise(0.0)).alias("exec_vol"),
        F.min(F.when(c("kind") == 0, c("ts"))).alias("start_ts"), F.max(F.when(hit, c("ts"))).alias("last_trade_ts"))
    # a run ends when the next one starts; the last run of a day ends at its last trade
    w = Window.partitionBy(*key).orderBy("run")
    g = g.withColumn("end_ts", F.coalesce(F.lead("start_ts").over(w), c("last_trade_ts")))
    return (g.where(c("exec_vol") > 0).withColumn("hidden", F.greatest(c("exec_vol") - c("max_disp"), F.lit(0.0)))
            .drop("last_trade_ts", "run"))


def hidden_summary(ep: DataFrame) -> DataFrame:
    return ep.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("traded_episodes"), F.count_if(c("hidden") > 0).alias("iceberg_episodes"),
        F.sum("exec_vol").alias("exec_vol"), F.sum("hidden").alias("hidden_vol"),
        (F.sum("hidden") / F.nullif(F.sum("exec_vol"), F.lit(0.0))).alias("hidden_frac"),
        (F.sum(c("hidden") * c("price")) / F.nullif(F.sum(c("exec_vol") * c("price")), F.lit(0.0))).alias("hidden_frac_notional")
    ).withColumn("iceberg_rate", c("iceberg_episodes") / c("traded_episodes"))


def hidden_hourly(ep: DataFrame, prices: DataFrame) -> DataFrame:
    """Hourly hidden shares joined with price features, next-hour targets and a contiguity flag."""
    g = ep.groupBy("symbol", bar_index("start_ts", HOUR_US).alias("hour")).agg(
        F.sum("exec_vol").alias("exec_vol"), F.sum("hidden").alias("hidden"), F.count(F.lit(1)).alias("n_ep"),
        F.count_if(c("hidden") > 0).alias("n_iceberg"), sum_if(c("hidden"), c("side") == "ask").alias("hidden_ask"),
        sum_if(c("hidden"), c("side") == "bid").alias("hidden_bid"))
    g = g.withColumns({"hidden_fraction": c("hidden") / c("exec_vol"), "iceberg_rate": c("n_iceberg") / c("n_ep"),
                       "signed_hidden": (c("hidden_ask") - c("hidden_bid")) / c("exec_vol")})
    d = g.join(prices, ["symbol", "hour"])
    nxt = d.select("symbol", (c("hour") - 1).alias("hour"), c("rv").alias("rv_next"), c("ret").alias("ret_next"), F.lit(True).alias("contig"))
    return d.join(nxt, ["symbol", "hour"], "left").withColumn("contig", F.coalesce("contig", F.lit(False)))


# ---- impact and lead-lag -------------------------------------------------------------------------------------

def impact_response(orders: DataFrame, grid: DataFrame, horizons: Sequence[int], step_us: int) -> DataFrame:
    """Signed mid response after each order: equi-joins of order bucket and bucket + h with the dense grid."""
    from .tape import size_class3
    o = orders.withColumns({"i": bar_index("ts", step_us), "day": F.to_date("ts"), "size_class": size_class3(),
                            "sign": F.when(c("side") == "buy", 1.0).otherwise(-1.0)})
    g = grid.where("mid IS NOT NULL").select("symbol", "day", "i", "mid")
    n = DAY_US // step_us
    o = o.where(F.pmod(c("i"), F.lit(n)) + max(horizons) < n)
    d = o.join(g.withColumnRenamed("mid", "mid0"), ["symbol", "day", "i"])
    d = d.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("i", c("i") + c("h"))
    d = d.join(g.withColumnRenamed("mid", "mid1"), ["symbol", "day", "i"])
    return d.withColumn("r", c("sign") * (c("mid1") - c("mid0")) / c("mid0"))


def impact_summary(resp: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return resp.groupBy(*keys, "size_class", "h").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("r") * 1e4).alias("bps"), (F.avg(c("r") / c("notional")) * 1e10).alias("bps_per_million"))


def impact_decomposition(summary: DataFrame, last_h: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Peak, permanent (last horizon) and transient parts; the earliest horizon wins a tied peak."""
    return summary.groupBy(*keys, "size_class").agg(
        F.max("bps").alias("peak"), F.max_by("h", F.struct("bps", (-c("h")).alias("nh"))).alias("peak_h"),
        F.max(F.when(c("h") == last_h, c("bps"))).alias("permanent")).withColumns({
            "transient": c("peak") - c("permanent"), "permanent_pct": 100 * c("permanent") / F.nullif(c("peak"), F.lit(0.0))})


def two_leg_flow(dense: DataFrame, pairs: DataFrame, trail: int, rows: int = 86_400) -> DataFrame:
    """Dense two-leg flow of every pair in ``pairs`` (pair, sym_a, sym_b, beta): per-bar normalised flow
    ``fa - beta fb`` and its trailing sum."""
    from .bars import pair_legs
    d = pair_legs(dense.select("symbol", "day", "i", "lm", c("trade_ofi").alias("sv"), (c("buy") + c("sell")).alias("v")), pairs, "i", ["day"])
    beta = c("beta")
    norm = lambda x: F.when(c(f"v_{x}") > 0, c(f"sv_{x}") / c(f"v_{x}")).otherwise(0.0)
    d = d.withColumns({"spread": c("lm_a") - beta * c("lm_b"), "flow": norm("a") - beta * norm("b"),
                       "flow_raw": c("sv_a") - beta * c("sv_b")})
    h = halo_blocks(d, "i", back=trail, rows=rows)
    w = block_window(["pair"], "i").rowsBetween(-(trail - 1), 0)
    return core_rows(h.withColumns({"ofi": F.sum("flow").over(w), "ofi_raw": F.sum("flow_raw").over(w)}))


def spread_return_on_flow(flow: DataFrame, horizons: Sequence[int], now_lag: int = 5, rows: int = 86_400) -> DataFrame:
    """Spread returns in bps on trailing two-leg flow, per pair: the last bar's (``now``) and each horizon's, with
    Newey-West t values whose lag is the horizon.  Returns pair, h, slope_bps, t, r2, n."""
    from .inference import ols_hac
    h = halo_blocks(flow.select("pair", "i", "spread", "ofi"), "i", back=1, fwd=max(horizons), rows=rows)
    w = block_window(["pair"], "i")
    d = core_rows(h.withColumns({"_now": (c("spread") - F.lag("spread").over(w)) * 1e4, **{f"_h{k}": (F.lead("spread", k).over(w) - c("spread")) * 1e4 for k in horizons}}))
    out = None
    for name, y, lag in [("now", "_now", now_lag), *[(f"h{k}", f"_h{k}", max(1, k)) for k in horizons]]:
        r = ols_hac(d, ["pair"], y, ["ofi"], lag, standardise=False).select("pair", F.lit(name).alias("h"), c("b")[1].alias("slope_bps"), c("t")[1].alias("t"), "r2", "n")
        out = r if out is None else out.unionByName(r)
    return out


def lead_lag(returns: DataFrame, leader: str, max_lag: int, rows: int = BLOCK_ROWS, symbols: int = 128) -> DataFrame:
    """Correlation of the leader's return with each follower's return ``lag`` bars later, over the bars that both have.

    A task holds about ``symbols`` followers over ``rows`` bars and the leader over these bars and ``max_lag`` to either
    side; sums of all lags are matrix products with the leader's moving window."""
    follow = returns.where(c("symbol") != leader).select("symbol", "i", c("ret").cast("double").alias("y"))
    tiles = follow.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("symbol") / symbols)).cast("int").alias("_tiles"))
    rows = max(rows, max_lag)
    follow = follow.join(F.broadcast(tiles)).select("symbol", c("i").cast("long").alias("at"), "y", int_div(c("i").cast("long"), rows).alias("_blk"), F.pmod(F.xxhash64("symbol"), c("_tiles")).cast("int").alias("_tile"))
    lead = halo_blocks(returns.where(c("symbol") == leader).select("i", c("ret").cast("double").alias("x")), "i", back=max_lag, fwd=max_lag, rows=rows)
    lead = lead.join(F.broadcast(tiles)).select(c("i").cast("long").alias("when"), "x", "_blk", F.explode(F.sequence(F.lit(0), c("_tiles") - 1)).alias("_tile"))

    def run(f: pa.Table, l: pa.Table) -> pa.Table:
        if not (f.num_rows and l.num_rows):
            return LAG_SUMS.empty_table()
        code = pc.dictionary_encode(f.column("symbol").combine_chunks())
        at = f.column("at").to_numpy()
        lo = int(at.min())
        y = np.full((len(code.dictionary), int(at.max()) - lo + 1), np.nan)
        y[code.indices.to_numpy(), at - lo] = f.column("y").to_numpy()
        x = np.full(y.shape[1] + 2 * max_lag, np.nan)
        when = l.column("when").to_numpy() - lo + max_lag
        near = (when >= 0) & (when < len(x))
        x[when[near]] = l.column("x").to_numpy()[near]
        # column k of the window holds the leader max_lag - k bars before the follower's bar
        sums = lag_products(x, y)
        names = np.array(code.dictionary.to_pylist(), dtype=object)
        out = {"symbol": pa.array(np.repeat(names, 2 * max_lag + 1)), "lag": pa.array(np.tile(np.arange(max_lag, -max_lag - 1, -1), len(names)).astype(np.int32))}
        return pa.table({**out, **{k: pa.array(v.ravel()) for k, v in sums.items()}}).cast(LAG_SUMS)

    d = follow.groupBy("_blk", "_tile").cogroup(lead.groupBy("_blk", "_tile")).applyInArrow(run, "symbol string, lag int, n double, x double, y double, xx double, yy double, xy double")
    s = d.groupBy("symbol", "lag").agg(*[F.sum(k).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")]).where("n > 0")
    # a side that doesn't vary leaves rounding errors alone
    spread = lambda q, v: F.when(c(q) - c(v) * c(v) / c("n") > 1e-12 * c(q), c(q) - c(v) * c(v) / c("n"))
    corr = (c("xy") - c("x") * c("y") / c("n")) / F.sqrt(spread("xx", "x") * spread("yy", "y"))
    return s.select("symbol", "lag", corr.alias("corr"), c("n").cast("long").alias("n"))


LAG_SUMS = pa.schema([("symbol", pa.string()), ("lag", pa.int32()), *((k, pa.float64()) for k in ("n", "x", "y", "xx", "yy", "xy"))])


def lag_products(x: np.ndarray, y: np.ndarray, width: int = 256) -> dict[str, np.ndarray]:
    """For every row of y (n long) and every shift k of x (n + lags - 1 long): sums over the t where y[t] and x[t + k] exist."""
    ok = np.isfinite(y)
    y0, here = np.where(ok, y, 0.0), ok.astype(float)
    x0, there = np.where(np.isfinite(x), x, 0.0), np.isfinite(x).astype(float)
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("n", "x", "y", "xx", "yy", "xy")}
    shifts, n = len(x) - y.shape[1] + 1, y.shape[1]
    for k in range(0, shifts, width):
        to = min(k + width, shifts)
        view = lambda v: np.lib.stride_tricks.sliding_window_view(v[k:to + n - 1], to - k)
        vx, vm = view(x0), view(there)
        for name, part in (("n", here @ vm), ("x", here @ vx), ("y", y0 @ vm), ("xx", here @ view(x0 * x0)), ("yy", (y0 * y0) @ vm), ("xy", y0 @ vx)):
            found[name].append(part)
    return {k: np.concatenate(v, axis=1) for k, v in found.items()}


def peak_lag(xc: DataFrame) -> DataFrame:
    return xc.groupBy("symbol").agg(F.max_by("lag", "corr").alias("peak_lag"), F.max("corr").alias("peak_corr"),
                                    F.max(F.when(c("lag") == 0, c("corr"))).alias("corr_0"),
                                    F.max(F.when(c("lag") > 0, c("corr"))).alias("best_lead"),
                                    F.max(F.when(c("lag") < 0, c("corr"))).alias("best_follow"))


def grid_returns(grid: DataFrame, every: int = 1) -> DataFrame:
    """Log returns of a dense grid sampled every ``every`` bars; returns across a day border are left out."""
    d = grid.where((F.pmod(c("i"), F.lit(every)) == 0) & c("mid").isNotNull()).select("symbol", "day", (c("i") / every).cast("long").alias("i"), F.log("mid").alias("lm"))
    w = Window.partitionBy("symbol", "day").orderBy("i")
    return d.withColumn("ret", c("lm") - F.lag("lm").over(w)).where("ret IS NOT NULL").select("symbol", "i", "ret")


def har_features(hourly: DataFrame, micro: Sequence[str] = ("qupd", "spr_m", "spr_s", "imb_m", "imb_s", "tcnt", "tvol", "absflow", "toxicity", "bpv", "jump"),
                 logs: Sequence[str] = ("tcnt", "tvol", "absflow", "qupd", "bpv", "jump"), day: int = 24, week: int = 168) -> DataFrame:
    """Lagged hour, day and week volatility plus lagged micro features; all strictly before the target hour."""
    h = halo_blocks(hourly, "hour", back=week + 1)
    w = block_window(["symbol"], "hour")
    mean = lambda n: F.when(F.count("rv").over(w.rowsBetween(-n, -1)) >= n, F.avg("rv").over(w.rowsBetween(-n, -1)))
    lagged = {}
    for x in micro:
        v = F.lag(x).over(w).cast("double")
        lagged[f"m_{x}"] = F.log1p(F.greatest(v, F.lit(0.0))) if x in logs else v
    return core_rows(h.withColumns({"har_h": F.lag("rv").over(w), "har_d": mean(day), "har_w": mean(week), **lagged}))


def vol_target_cv(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation of realised risk under volatility targeting; forecasts floored at their 1 %
    quantile."""
    q = exact_quantiles(df, pred, [0.01], keys, ["_q"])
    d = (df.join(q, list(keys), "left") if keys else df.join(F.broadcast(q))).withColumn("_p", F.greatest(c(pred), c("_q")))
    m = exact_quantiles(d, "_p", [0.5], keys, ["_m"])
    d = (d.join(m, list(keys), "left") if keys else d.join(F.broadcast(m))).withColumn("_r", c("_m") / c("_p") * c(actual))
    return d.groupBy(*keys).agg((F.stddev_pop("_r") / F.avg("_r")).alias("cv"), (F.stddev_pop(actual) / F.avg(actual)).alias("cv_flat"))
