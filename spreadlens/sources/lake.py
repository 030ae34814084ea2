"""Reading and writing market data as partitioned parquet, and the row-level upsert rules."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..core.session import scratch_folder  # noqa: F401
from ..operators.panel import keep_last

OHLCV = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
                      *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
TICKS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
                      T.StructField("local_ts", T.TimestampType()), T.StructField("trade_id", T.StringType()),
                      T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType()),
                      T.StructField("amount", T.DoubleType()), T.StructField("notional", T.DoubleType())])
TRADE_BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("trade_count", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in
                             ("volume_base", "volume_quote", "buy_volume_base", "sell_volume_base",
                              "signed_volume_base", "vwap")]])


def book_schema(levels: int = 10) -> T.StructType:
    return T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
                         T.StructField("local_ts", T.TimestampType()), T.StructField("seq", T.LongType()),
                         *[T.StructField(f"{s}_{k}_{i}", T.DoubleType()) for i in range(1, levels + 1)
                           for s in ("bid", "ask") for k in ("px", "sz")],
                         T.StructField("is_snapshot", T.BooleanType()), T.StructField("is_delta", T.BooleanType())])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_symbol(store: DataFrame, symbol: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One symbol's rows with a column projection; on a partitioned store only its folder is read."""
    d = store.where(F.col("symbol") == symbol)
    return d.select(*columns) if columns else d


def list_symbols(store: DataFrame) -> DataFrame:
    return store.select("symbol").distinct()


def load_range(store: DataFrame, start, end, symbols: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``[start, end)``; the predicate also prunes ``year``/``day`` partitions where present."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    d = store.where((F.col("ts") >= s) & (F.col("ts") < e))
    if "year" in store.columns:
        d = d.where(F.col("year").between(F.year(s), F.year(e)))
    if "day" in store.columns:
        d = d.where(F.col("day").between(F.to_date(s), F.to_date(e)))
    return d.where(F.col("symbol").isin(*symbols)) if symbols else d


def write_store(df: DataFrame, path: str, by: Sequence[str] = ("symbol",), mode: str = "overwrite") -> None:
    """Partitioned zstd parquet; only touched partitions are replaced.

    The rebalance hint lets AQE split the busiest symbol's rows over several tasks and join tiny ones.
    """
    (df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path))


def parse_klines(raw: DataFrame) -> DataFrame:
    """Landed arrays ``[open_ms, o, h, l, c, v, ...]`` per row -> typed bars, last load wins."""
    a = F.from_json("kline", "array<string>")
    d = raw.withColumn("_a", a).select(
        "symbol", F.timestamp_millis(F.col("_a")[0].cast("long")).alias("ts"),
        *[F.col("_a")[k + 1].cast("double").alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"))],
        "load_id")
    return keep_last(d, ["symbol", "ts"], ["load_id"]).drop("load_id")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Old plus new rows; the new one wins on equal keys."""
    need = {"open", "high", "low", "close", "volume"}
    missing = need - set(incoming.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    both = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return keep_last(both, list(keys), ["_src"]).drop("_src")


def high_watermark(store: DataFrame) -> DataFrame:
    return store.groupBy("symbol").agg(F.max("ts").alias("hwm"))


def newer_than_watermark(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Rows past the per-symbol watermark; symbols never loaded pass whole."""
    return (incoming.join(high_watermark(store), "symbol", "left")
            .where(F.col("hwm").isNull() | (F.col("ts") > F.col("hwm"))).drop("hwm"))


def day_coverage(store: DataFrame) -> DataFrame:
    """First, last and number of stored days per symbol, plus the days themselves."""
    d = store.select("symbol", F.to_date("ts").alias("day")).distinct()
    return d.groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                   F.count("day").alias("n_days"), F.array_sort(F.collect_list("day")).alias("days"))


def missing_days(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of symbol-days not stored yet; the key list is distinct days, not rows."""
    have = store.select("symbol", F.to_date("ts").alias("day")).distinct()
    return incoming.withColumn("day", F.to_date("ts")).join(have, ["symbol", "day"], "left_anti")


def ingest_days(raw: DataFrame, path: str, existing: DataFrame | None = None) -> dict[str, int]:
    """Write unseen symbol-days in one job and return the counts."""
    d = missing_days(raw, existing) if existing is not None else raw.withColumn("day", F.to_date("ts"))
    seen = Observation("ingest")
    d = d.observe(seen, F.count(F.lit(1)).alias("rows_written"))
    write_store(d, path, by=("symbol", "day"))
    return {"rows_written": int(seen.get["rows_written"])}


def write_receipt(spark: SparkSession, path: str, counts: dict[str, int]) -> None:
    """Run receipt: one JSON row."""
    (spark.createDataFrame([(json.dumps(counts),)], "receipt string").coalesce(1)
     .write.mode("overwrite").text(path))


def read_raw_book(spark: SparkSession, path: str, levels: int = 10) -> DataFrame:
    """``book_snapshot`` CSV (0-based ``asks[i].price`` columns, µs epochs) -> canonical book."""
    raw = spark.read.option("header", True).csv(path)
    cols = [F.col("symbol"), F.timestamp_micros(F.col("timestamp").cast("long")).alias("ts"),
            F.timestamp_micros(F.col("local_timestamp").cast("long")).alias("local_ts")]
    for i in range(levels):
        for side in ("bid", "ask"):
            for field, short in (("price", "px"), ("amount", "sz")):
                name = f"{side}s[{i}].{field}"
                value = F.col(f"`{name}`").cast("double") if name in raw.columns else F.lit(None).cast("double")
                cols.append(value.alias(f"{side}_{short}_{i + 1}"))
    return raw.select(*cols)


def read_raw_trades(spark: SparkSession, path: str) -> DataFrame:
    """trades CSV -> canonical ticks."""
    return canonical_trades(spark.read.option("header", True).csv(path))


def canonical_trades(raw: DataFrame, *more: str) -> DataFrame:
    """Raw trades -> canonical ticks; unknown sides become blank, notional = price * amount."""
    side = F.lower("side")
    return raw.select(
        *more,
        "symbol", F.timestamp_micros(F.col("timestamp").cast("long")).alias("ts"),
        F.timestamp_micros(F.col("local_timestamp").cast("long")).alias("local_ts"),
        F.col("id").alias("trade_id"), F.when(side.isin("buy", "sell"), side).otherwise("").alias("side"),
        F.col("price").cast("double").alias("price"), F.col("amount").cast("double").alias("amount"),
        (F.col("price").cast("double") * F.col("amount").cast("double")).alias("notional"))


def book_violations(book: DataFrame) -> DataFrame:
    """Counts of rows breaking a rule; a clean book gives zeros."""
    return book.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("bid_px_1") > F.col("ask_px_1")).alias("crossed"),
        F.count_if((F.col("bid_px_1") <= 0) | (F.col("ask_px_1") <= 0)).alias("bad_price"),
        F.count_if((F.col("bid_sz_1") < 0) | (F.col("ask_sz_1") < 0)).alias("bad_size"),
        F.count_if(F.col("ts").isNull()).alias("no_ts"))


def trade_violations(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("price") <= 0).alias("bad_price"),
        F.count_if(F.col("amount") < 0).alias("bad_amount"),
        F.count_if(~F.col("side").isin("buy", "sell", "")).alias("bad_side"),
        F.count_if(F.col("ts").isNull()).alias("no_ts"))


def order_violations(df: DataFrame, keys: Sequence[str], seq: str, width_us: int) -> DataFrame:
    """Rows whose time runs backwards against the sequence number, per key."""
    from ..core.ordered import previous_row
    d = previous_row(df.select(*keys, "ts", seq), keys, [seq], {"_prev": "ts"}, width_us)
    return d.groupBy(*keys).agg(F.count_if(F.col("ts") < F.col("_prev")).alias("backwards"))


def require_clean(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Fail when a violation count is above zero (one tiny row is read)."""
    row = violations.first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise ValueError(f"quality checks failed: {bad}")
    return df


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def with_venue(frames: dict[str, DataFrame]) -> DataFrame:
    """Stores of several venues as one table with a ``venue`` column."""
    out = None
    for name, f in frames.items():
        d = f.withColumn("venue", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out
