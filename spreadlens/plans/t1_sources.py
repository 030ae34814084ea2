"""Sources, calendars, panels and universes (SRC, PAN)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..core.ordered import DAY_US, HOUR_US, YEAR_US
from ..operators import bars as B, book as K, panel as N
from ..sources import day_files as D, lake as L
from .registry import query, rnd, rnd_sql as R, rounded


@query("src1_load_symbol", "SELECT ts, close FROM v_bars_1h WHERE symbol = 'S3'")
def _(t):
    return L.load_symbol(t.bars_1h, "S3", ["ts", "close"])


@query("src2_list_symbols", "SELECT DISTINCT symbol FROM v_trades")
def _(t):
    return L.list_symbols(t.trades)


@query("src3_save_symbol", "SELECT symbol, count(*) AS n, round(sum(close), 4) + 0e0 AS s FROM v_bars_1h GROUP BY symbol")
def _(t):
    path = L.scratch_folder(t.spark)
    L.write_store(t.bars_1h, path)
    return t.spark.read.parquet(path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("close"), 4).alias("s"))


_KLINES = """
SELECT symbol, ts, open, high, low, CASE WHEN epoch_us(ts) // 3600000000 % 2 = 0 THEN close + 1e0 ELSE close END AS close, volume
FROM v_bars_1h"""


@query("src4_parse_klines", _KLINES)
def _(t):
    b = t.bars_1h
    again = b.where((F.unix_micros("ts") / HOUR_US).cast("long") % 2 == 0).withColumn("close", F.col("close") + 1.0)

    def landed(d, load):
        ms = F.unix_millis("ts").cast("string")
        return d.select("symbol", F.to_json(F.array(ms, *[F.col(c).cast("string") for c in
                                                          ("open", "high", "low", "close", "volume")])).alias("kline"),
                        F.lit(load).alias("load_id"))

    return L.parse_klines(landed(b, 1).unionByName(landed(again, 2)))


@query("src5_upsert", """
SELECT symbol, ts, open, high, low, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN close + 1e0 ELSE close END AS close, volume
FROM v_bars_1h""")
def _(t):
    b = t.bars_1h
    old = b.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    new = b.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).withColumn("close", F.col("close") + 1.0)
    return L.upsert(old, new)


@query("src6_high_watermark", """
WITH h AS (SELECT symbol, max(ts) AS hwm FROM v_bars_1h WHERE ts < TIMESTAMP '2024-01-15' AND symbol <> 'S7' GROUP BY symbol)
SELECT b.symbol, count(*) AS n_new, min(b.ts) AS first_new FROM v_bars_1h b LEFT JOIN h ON h.symbol = b.symbol
WHERE h.hwm IS NULL OR b.ts > h.hwm GROUP BY b.symbol""")
def _(t):
    store = t.bars_1h.where((F.col("ts") < F.lit("2024-01-15").cast("timestamp")) & (F.col("symbol") != "S7"))
    return L.newer_than_watermark(t.bars_1h, store).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_new"), F.min("ts").alias("first_new"))


@query("src7_run_receipt", "SELECT count(*) AS rows_written FROM v_trades")
def _(t):
    path = L.scratch_folder(t.spark)
    counts = L.ingest_days(t.trades.select("symbol", "ts", "price", "amount"), path + "/ticks")
    L.write_receipt(t.spark, path + "/receipt", counts)
    r = t.spark.read.text(path + "/receipt")
    return r.select(F.get_json_object("value", "$.rows_written").cast("long").alias("rows_written"))


@query("src8_raw_book_csv", f"""
SELECT symbol, count(*) AS n, {R('sum(bid_px_1)', 4)} AS s1, CAST(sum(ask_sz_3) AS DOUBLE) AS s2, count(CASE WHEN false THEN 1 END) AS n4
FROM v_book GROUP BY symbol""")
def _(t):
    path = L.scratch_folder(t.spark)
    b = t.book
    cols = [F.lit("x").alias("exchange"), "symbol", F.unix_micros("ts").alias("timestamp"),
            F.unix_micros("ts").alias("local_timestamp")]
    for i in range(3):
        for side in ("ask", "bid"):
            cols += [F.col(f"{side}_px_{i + 1}").alias(f"{side}s[{i}].price"),
                     F.col(f"{side}_sz_{i + 1}").alias(f"{side}s[{i}].amount")]
    b.select(*cols).write.option("header", True).option("compression", "gzip").csv(path)
    d = L.read_raw_book(t.spark, path, levels=4)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("bid_px_1"), 4).alias("s1"),
                                   F.sum("ask_sz_3").alias("s2"), F.count("bid_px_4").alias("n4"))


def _vendor_trades(t):
    """Trades as a vendor's file has them."""
    return t.trades.select(F.lit("x").alias("exchange"), "symbol", F.unix_micros("ts").alias("timestamp"),
                           F.unix_micros("ts").alias("local_timestamp"), F.col("trade_id").alias("id"),
                           F.when(F.col("side") == "", "unknown").otherwise(F.upper("side")).alias("side"), "price", "amount", F.to_date("ts").alias("day"))


def _ingest(t, raw, lake, days=None):
    """Ingest the calendar of all trades, or the part of it that ``days`` keeps."""
    first, last = t.trades.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    jobs = D.job_grid(t.trades, str(first), str(last))
    return D.ingest_day_files(t.spark, raw, lake, jobs if days is None else jobs.where(days), D.TRADE_FILE, lambda d: L.canonical_trades(d, "day"))


def _day_files(t):
    path = L.scratch_folder(t.spark)
    _vendor_trades(t).write.partitionBy("symbol", "day").option("header", True).option("compression", "gzip").csv(path)
    return path


def _trade_lake(t):
    """The lake of all trades, from day files; built at first use."""
    if "trade_lake" not in t.stored:
        t.stored["trade_lake"] = L.scratch_folder(t.spark)
        _ingest(t, _day_files(t), t.stored["trade_lake"])
    return t.stored["trade_lake"]


@query("src9_raw_trades_csv", f"""
SELECT symbol, side, count(*) AS n, {R('sum(notional)', 2)} AS notional FROM v_trades GROUP BY symbol, side""")
def _(t):
    path = L.scratch_folder(t.spark)
    _vendor_trades(t).drop("day").write.option("header", True).csv(path)
    return L.read_raw_trades(t.spark, path).groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("notional"), 2).alias("notional"))


@query("src10_ingest_days", """
SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n FROM v_trades GROUP BY ALL""")
def _(t):
    path = L.scratch_folder(t.spark)
    ticks = t.trades.select("symbol", "ts", "price", "amount")
    L.ingest_days(ticks.where(F.col("ts") < F.lit("2024-01-12").cast("timestamp")), path)
    L.ingest_days(ticks, path, t.spark.read.parquet(path))
    return t.spark.read.parquet(path).groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"))


_DAY_JOBS = """
j AS (SELECT s.symbol, CAST(d.day AS DATE) AS day FROM (SELECT DISTINCT symbol FROM v_trades) s,
  (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS day FROM v_trades) d),
n AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS rows FROM v_trades GROUP BY ALL),
st AS (SELECT j.symbol, j.day, CASE WHEN n.rows IS NULL THEN 'missing' WHEN j.day < DATE '2024-01-12' THEN 'skipped' ELSE 'written' END AS status, n.rows
  FROM j LEFT JOIN n ON n.symbol = j.symbol AND n.day = j.day)"""


def _second_run(t):
    """Status of the whole calendar when the days before the 12th are stored already."""
    raw, lake = _day_files(t), L.scratch_folder(t.spark)
    _ingest(t, raw, lake, F.col("day") < F.lit("2024-01-12").cast("date"))
    return _ingest(t, raw, lake)


@query("src10_day_status", f"WITH {_DAY_JOBS} SELECT symbol, day, status, CASE WHEN status = 'written' THEN rows END AS rows FROM st")
def _(t):
    return _second_run(t).drop("message")


@query("src10_ingest_receipt", f"""WITH {_DAY_JOBS} SELECT count(*) AS requested, count(*) FILTER (status = 'skipped') AS skipped_existing,
  count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'missing') AS missing, CAST(0 AS BIGINT) AS errors,
  CAST(coalesce(sum(rows) FILTER (status = 'written'), 0) AS BIGINT) AS rows_written FROM st""")
def _(t):
    return D.receipt(_second_run(t))


@query("src11_csv_to_lake", "SELECT symbol, year(ts) AS year, count(*) AS n FROM v_trades GROUP BY ALL")
def _(t):
    return t.spark.read.parquet(_trade_lake(t)).groupBy("symbol", "year").agg(F.count(F.lit(1)).alias("n"))


@query("src12_load_day", "SELECT ts, price, amount FROM v_trades WHERE symbol = 'S1' AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10'")
def _(t):
    return D.lake_day(t.spark, _trade_lake(t), "S1", "2024-01-09").select("ts", "price", F.col("amount").cast("bigint").alias("amount"))


@query("src13_daily_spread_vwap", f"""
WITH s AS (SELECT CAST(ts AS DATE) AS day, avg((ask_px_1 - bid_px_1) / ((ask_px_1 + bid_px_1) / 2e0) * 1e4) AS spread
           FROM v_book WHERE symbol = 'S2' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND ask_px_1 > bid_px_1 GROUP BY 1),
     v AS (SELECT CAST(ts AS DATE) AS day, sum(notional) / sum(amount) AS vwap, count(*) AS n
           FROM v_trades WHERE symbol = 'S2' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1)
SELECT s.day, {R('s.spread')} AS avg_spread_bps, {R('v.vwap')} AS vwap, v.n AS n_trades FROM s JOIN v ON s.day = v.day""")
def _(t):
    day = F.to_date("ts").alias("day")
    s = (K.valid(L.load_range(t.book, "2024-01-05", "2024-01-25", ["S2"])).groupBy(day)
         .agg(rnd(F.avg(K.quoted_spread_bps())).alias("avg_spread_bps")))
    v = (D.lake_range(t.spark, _trade_lake(t), "2024-01-05", "2024-01-25", ["S2"]).groupBy(day)
         .agg(rnd(F.sum("notional") / F.sum("amount")).alias("vwap"), F.count(F.lit(1)).alias("n_trades")))
    return s.join(v, "day")


@query("src14_lake_sql", f"""
SELECT symbol, CAST(ts AS DATE) AS day, {R('avg((ask_px_1 - bid_px_1) / ((ask_px_1 + bid_px_1) / 2e0)) * 1e4')} AS spread_bps
FROM v_book GROUP BY ALL""")
def _(t):
    t.book.createOrReplaceTempView("lake_book")
    return rounded(t.spark.sql("""
        SELECT symbol, to_date(ts) AS day, avg((ask_px_1 - bid_px_1) / ((ask_px_1 + bid_px_1) / 2)) * 1e4 AS spread_bps
        FROM lake_book GROUP BY symbol, to_date(ts)"""), "spread_bps")


@query("src15_load_range", "SELECT symbol, ts, seq, bid_px_1, ask_px_1 FROM v_book WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08'")
def _(t):
    return L.load_range(t.book, "2024-01-03", "2024-01-08").select("symbol", "ts", "seq", "bid_px_1", "ask_px_1")


@query("src16_day_coverage", """
SELECT t.symbol, min(t.day) AS first_day, max(t.day) AS last_day, count(*) AS n_days
FROM (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM v_trades) t
SEMI JOIN (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM v_book) b ON b.symbol = t.symbol AND b.day = t.day GROUP BY t.symbol""")
def _(t):
    d = t.trades.withColumn("day", F.to_date("ts"))
    have = t.book.select("symbol", F.to_date("ts").alias("day")).distinct()
    return L.day_coverage(d.join(have, ["symbol", "day"], "left_semi")).drop("days")


@query("src17_quality_checks", """
SELECT 'book' AS feed, count(*) AS n_rows, count(*) FILTER (bid_px_1 > ask_px_1) AS crossed_or_side, count(*) FILTER (bid_px_1 <= 0 OR ask_px_1 <= 0) AS bad_price FROM v_book
UNION ALL SELECT 'trades', count(*), count(*) FILTER (side NOT IN ('buy', 'sell', '')), count(*) FILTER (price <= 0) FROM v_trades""")
def _(t):
    b = L.book_violations(t.book).select(F.lit("book").alias("feed"), "n_rows", F.col("crossed").alias("crossed_or_side"), "bad_price")
    v = L.trade_violations(t.trades).select(F.lit("trades").alias("feed"), "n_rows", F.col("bad_side").alias("crossed_or_side"), "bad_price")
    return b.unionByName(v)


@query("src17_order_check", """
SELECT symbol, count(*) FILTER (ts < p) AS backwards FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM v_book) GROUP BY symbol""")
def _(t):
    return L.order_violations(t.book, ["symbol"], "seq", DAY_US)


@query("src18_empty_frame", "SELECT symbol, count(*) AS n FROM v_trades GROUP BY symbol")
def _(t):
    ticks = t.trades.select("symbol", "ts", F.col("ts").alias("local_ts"), F.col("trade_id").cast("string").alias("trade_id"),
                            "side", "price", F.col("amount").cast("double").alias("amount"), "notional")
    return L.empty(t.spark, L.TICKS).unionByName(ticks).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("src19_write_bar_days", """
SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v FROM v_bars_1h GROUP BY ALL""")
def _(t):
    path = L.scratch_folder(t.spark)
    b = t.bars_1h.withColumn("day", F.to_date("ts"))
    L.require_clean(b, b.agg(F.count_if(F.col("close") <= 0).alias("bad_close")))
    L.write_store(b, path, by=("symbol", "day"))
    return t.spark.read.parquet(path).groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").cast("long").alias("v"))


@query("src24_two_stores", """
SELECT venue, symbol, count(*) AS n FROM (SELECT 'spot' AS venue, symbol FROM v_bars_1h UNION ALL
 SELECT 'delisted', symbol FROM v_bars_1h WHERE ts < TIMESTAMP '2024-01-15' AND symbol IN ('S0', 'S5')) GROUP BY ALL""")
def _(t):
    gone = t.bars_1h.where((F.col("ts") < F.lit("2024-01-15").cast("timestamp")) & F.col("symbol").isin("S0", "S5"))
    return L.with_venue({"spot": t.bars_1h, "delisted": gone}).groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("n"))


_GRID = """
WITH grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts),
g AS (SELECT s.symbol, grid.ts, b.close, b.volume FROM (SELECT DISTINCT symbol FROM v_bars_1h) s CROSS JOIN grid
      LEFT JOIN v_bars_1h b ON b.symbol = s.symbol AND b.ts = grid.ts)"""


def _grid(t):
    return N.reindex(t.bars_1h, HOUR_US, "2024-01-02", "2024-01-28")


@query("pan1_calendar", _GRID + " SELECT symbol, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM g GROUP BY symbol")
def _(t):
    s = N.symbol_spans(t.bars_1h, HOUR_US, "2024-01-02", "2024-01-28")
    return N.calendar(s, "start_ts", "end_ts", HOUR_US).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("pan2_reindex", _GRID + " SELECT symbol, ts, close FROM g")
def _(t):
    return _grid(t).select("symbol", "ts", "close")


@query("pan3_coverage", _GRID + f" SELECT symbol, {R('count(close) * 1e0 / count(*)')} AS coverage FROM g GROUP BY symbol HAVING count(close) * 1e0 / count(*) >= 5e-1")
def _(t):
    return rounded(N.coverage(N.drop_thin(_grid(t), 0.5)).select("symbol", "coverage"), "coverage")


@query("pan4_ffill", _GRID + " SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close FROM g")
def _(t):
    return N.ffill(_grid(t).select("symbol", "ts", "close"), ["close"], DAY_US)


@query("pan5_ffill_limit", _GRID + " SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close FROM g")
def _(t):
    return N.ffill_limit(_grid(t).select("symbol", "ts", "i", "close"), ["close"], 3).drop("i")


@query("pan6_complete_case", _GRID + " SELECT symbol, ts, close FROM g WHERE ts IN (SELECT ts FROM g GROUP BY ts HAVING count(close) = 8)")
def _(t):
    return N.complete_case(_grid(t).select("symbol", "ts", "close"))


_PANEL_H = _GRID + """, f AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close,
 coalesce(close * volume, 0e0) AS volume_usdt FROM g WHERE symbol IN (SELECT symbol FROM g GROUP BY symbol HAVING count(close) * 1e0 / count(*) >= 5e-1)),
c AS (SELECT *, count(close) OVER (PARTITION BY ts) AS k FROM f)"""


@query("pan7_close_panel", _PANEL_H + " SELECT symbol, ts, close FROM c WHERE k = (SELECT count(DISTINCT symbol) FROM f)")
def _(t):
    return N.close_panel(t.bars_1h, HOUR_US, "2024-01-02", "2024-01-28", 0.5, DAY_US).select("symbol", "ts", "close")


@query("pan8_ohlcv_panel", _PANEL_H + f" SELECT symbol, ts, close, {R('volume_usdt', 2)} AS volume_usdt FROM c WHERE k = (SELECT count(DISTINCT symbol) FROM f)")
def _(t):
    p = N.close_panel(t.bars_1h, HOUR_US, "2024-01-02", "2024-01-28", 0.5, DAY_US)
    return p.select("symbol", "ts", "close", rnd("volume_usdt", 2).alias("volume_usdt"))


@query("pan9_wide_and_long", """
PIVOT (SELECT symbol, ts, close FROM v_bars_1h) ON symbol IN ('S0', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7') USING max(close) GROUP BY ts""")
def _(t):
    wide = t.bars_1h.groupBy("ts").pivot("symbol").agg(F.max("close"))
    symbols = wide.columns[1:]
    back = wide.unpivot("ts", symbols, "symbol", "close")
    return back.groupBy("ts").pivot("symbol", symbols).agg(F.max("close"))


@query("pan10_dedupe", """
SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, trade_id) AS last_price, arg_min(price, trade_id) AS first_price FROM v_trades GROUP BY ALL""")
def _(t):
    d = t.trades.select("symbol", F.date_trunc("hour", "ts").alias("ts"), "trade_id", "price")
    last = N.keep_last(d, ["symbol", "ts"], ["trade_id"]).select("symbol", "ts", F.col("price").alias("last_price"))
    first = N.keep_first(d, ["symbol", "ts"], ["trade_id"]).select("symbol", "ts", F.col("price").alias("first_price"))
    return last.join(first, ["symbol", "ts"])


@query("pan11_resample_panel", """
WITH r AS (SELECT symbol, to_timestamp(epoch_us(ts) // 14400000000 * 14400)::TIMESTAMP AS ts, arg_max(close, ts) AS close FROM v_bars_1h GROUP BY ALL)
SELECT * FROM r WHERE ts IN (SELECT ts FROM r GROUP BY ts HAVING count(*) = 8)""")
def _(t):
    return N.resample_last(t.bars_1h, 4 * HOUR_US)


@query("pan12_universe_at", """
SELECT symbol FROM v_bars_1h GROUP BY symbol HAVING max(ts) >= TIMESTAMP '2024-01-20 04:00:00' AND min(ts) <= TIMESTAMP '2024-01-05 05:00:00'""")
def _(t):
    return N.universe_at(t.bars_1h, "2024-01-20 05:30:00", HOUR_US, 15).select("symbol")


@query("pan13_universe_by_days", """
SELECT symbol FROM (SELECT symbol FROM v_trades WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY symbol HAVING count(DISTINCT CAST(ts AS DATE)) = 10
INTERSECT SELECT symbol FROM v_book WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY symbol HAVING count(DISTINCT CAST(ts AS DATE)) = 10)""")
def _(t):
    return N.universe_by_days([t.trades, t.book], "2024-01-20", 10)


@query("pan14_top_by_liquidity", f"""
SELECT symbol, {R('avg(close * volume)', 2)} AS usdt_vol, count(*) AS n_bars FROM v_bars_1h
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28' GROUP BY symbol HAVING count(*) >= 624 * 5e-1 ORDER BY avg(close * volume) DESC, symbol LIMIT 5""")
def _(t):
    return rounded(N.top_by_liquidity(t.bars_1h, "2024-01-02", "2024-01-28", HOUR_US, 5, 0.5), "usdt_vol", digits=2)


@query("pan15_top_by_daily_notional", f"""
SELECT symbol, {R("sum(notional) / (date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1)", 6)} AS mean_daily_notional
FROM v_trades WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-23' GROUP BY symbol
ORDER BY mean_daily_notional DESC, symbol LIMIT 4""")
def _(t):
    return rounded(N.top_by_daily_notional(t.trades, "2024-01-03", "2024-01-23", 4), "mean_daily_notional", digits=6)


_WIN = """
WITH b0 AS (SELECT epoch_us(min(ts)) // 86400000000 AS lo, (epoch_us(max(ts)) + 86399999999) // 86400000000 AS hi FROM {src}),
win AS (SELECT CAST(k AS INTEGER) AS split_id, make_timestamp((lo + k * {step}) * 86400000000) AS train_start,
  make_timestamp((lo + k * {step} + {train}) * 86400000000) AS train_end,
  make_timestamp((lo + k * {step} + {train} + {test}) * 86400000000) AS test_end
  FROM b0, range(10000) r(k) WHERE lo + k * {step} + {train} + {test} <= hi)"""


def win_sql(src: str, train: int, test: int, step: int) -> str:
    return _WIN.format(src=src, train=train, test=test, step=step)


def windows(bars, train: int, test: int, step: int):
    return N.windows_over(bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), train, test, step)


@query("pan16_point_in_time_top", win_sql("v_daily", 365, 90, 90) + f""", g AS (
 SELECT split_id, symbol, sum(close * volume) AS dv, count(close) AS n_bars FROM v_daily JOIN win ON ts >= train_start AND ts < train_end GROUP BY ALL),
 r AS (SELECT split_id, symbol, {R('dv', 2)} AS dollar_volume, n_bars, CAST(row_number() OVER (PARTITION BY split_id ORDER BY dv DESC, symbol) AS INTEGER) AS rank FROM g WHERE n_bars >= 200)
 SELECT * FROM r WHERE rank <= 5""")
def _(t):
    return rounded(N.point_in_time_top(t.daily, windows(t.daily, 365, 90, 90), 5, 200), "dollar_volume", digits=2)


@query("pan17_venue_overlap", """
SELECT DISTINCT symbol FROM v_bars_1h WHERE close > 100 INTERSECT SELECT DISTINCT symbol FROM v_book WHERE ts < TIMESTAMP '2024-01-04'""")
def _(t):
    return (t.bars_1h.where("close > 100").select("symbol").distinct()
            .intersect(t.book.where(F.col("ts") < F.lit("2024-01-04").cast("timestamp")).select("symbol").distinct()))


@query("pan18_exclusions", """
SELECT symbol FROM (SELECT DISTINCT symbol || CASE WHEN symbol IN ('S1', 'S2') THEN 'UP' WHEN symbol = 'S3' THEN 'BEAR' ELSE 'USDT' END AS symbol FROM v_trades)
WHERE NOT regexp_matches(symbol, '(UP|DOWN|BULL|BEAR)$') AND symbol NOT IN ('S5USDT')""")
def _(t):
    suffix = F.when(F.col("symbol").isin("S1", "S2"), "UP").when(F.col("symbol") == "S3", "BEAR").otherwise("USDT")
    named = t.trades.select(F.concat("symbol", suffix).alias("symbol")).distinct()
    stable = named.where(F.col("symbol") == "S5USDT")
    return named.where(~F.col("symbol").rlike("(UP|DOWN|BULL|BEAR)$")).join(stable, "symbol", "left_anti")


@query("pan19_capacity", f"""
SELECT symbol, {R('median(dv)', 4)} AS median_daily_usd, count(*) AS n_days, {R('median(dv) * 1e-2', 6)} AS capacity_usd
FROM (SELECT symbol, CAST(ts AS DATE) AS day, sum(close * volume) AS dv FROM v_bars_1h GROUP BY ALL) GROUP BY symbol HAVING count(*) >= 30""")
def _(t):
    return rounded(rounded(N.dollar_volume_capacity(t.bars_1h), "median_daily_usd", digits=4), "capacity_usd", digits=6)


@query("pan20_survivorship_counts", win_sql("v_daily", 365, 90, 90) + """, s AS (
 SELECT symbol, min(ts) AS lo, CASE WHEN symbol IN ('P3', 'P7') THEN least(max(ts), TIMESTAMP '1999-06-30') ELSE max(ts) END AS hi FROM v_daily GROUP BY symbol)
 SELECT split_id, count(symbol) AS available, count(*) FILTER (hi < test_end - INTERVAL 1 DAY) AS dropped
 FROM win LEFT JOIN s ON lo < train_end AND hi >= train_end GROUP BY split_id""")
def _(t):
    cut = F.col("symbol").isin("P3", "P7") & (F.col("ts") > F.lit("1999-06-30").cast("timestamp"))
    kept = t.daily.where(~cut)
    last = kept.where(F.col("symbol").isin("P3", "P7")).groupBy("symbol").agg(F.max("ts").alias("_m"))
    # a delisted symbol keeps its final print on the cut-off day
    tail = last.select("symbol", F.lit("1999-06-30").cast("timestamp").alias("ts"),
                       F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume"))
    return N.survivorship_counts(kept.unionByName(tail), windows(t.daily, 365, 90, 90))


@query("pan21_window_coverage", win_sql("v_daily", 365, 90, 90) + f"""
SELECT split_id, symbol, 365::BIGINT AS n_grid, count(close) AS n_bars, {R('count(close) / 365e0')} AS coverage
FROM v_daily JOIN win ON ts >= train_start AND ts < train_end GROUP BY split_id, symbol HAVING count(close) / 365e0 >= 8e-1""")
def _(t):
    return rounded(N.window_coverage(t.daily, windows(t.daily, 365, 90, 90), DAY_US, 0.8), "coverage")
