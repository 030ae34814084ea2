"""Compressed CSV day files of a vendor into a lake whose scans prune.

Raw files lie below ``symbol=.../day=.../*.csv.gz``, the lake is parquet by ``symbol``, ``year`` and ``day``. A run takes a table
of jobs (symbol, day), leaves out days that the lake has, checks every file of the others from its first byte to its last
(checksum, columns, values) and writes the days whose files are all sound. A job's status is ``skipped``, ``missing`` (no
file), ``error`` (with a message; nothing of the day is written) or ``written`` (with its rows; a day of headers alone has
none and is looked at again by the next run). Files are read by path listing and by task, never through the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.session import checkpointed
from .lake import load_range, write_store

_KEYS = ["symbol", "day"]
_FILES = "path string, modificationTime timestamp, length bigint, content binary, symbol string, day date"
_KINDS = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
#: Job tables of up to so many rows (about 40 MB) are broadcast, so that no file content is shuffled; larger ones are joined by key.
BROADCAST_JOBS = 1_000_000
TRADE_FILE = {"exchange": "string", "timestamp": "bigint", "local_timestamp": "bigint", "id": "string", "side": "string",
              "price": "double", "amount": "double"}


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").schema(_FILES).option("pathGlobFilter", names).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stored_days(spark: SparkSession, lake: str) -> DataFrame:
    """(symbol, day) of the lake, from names of files alone."""
    if not _exists(spark, lake):
        return spark.createDataFrame([], "symbol string, day date")
    return _files(spark, lake, "*.parquet").select(*_KEYS).distinct()


def job_grid(symbols: DataFrame, first: str, last: str) -> DataFrame:
    """Every symbol on every day from ``first`` to ``last``."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return symbols.select("symbol").distinct().select("symbol", F.explode(days).alias("day"))


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_JOBS + 1).count() <= BROADCAST_JOBS else keys


def _checker(columns: Mapping[str, str], required: str):
    def rows_of(content: pa.Buffer) -> int:
        options = pacsv.ConvertOptions(column_types={c: _KINDS[k] for c, k in columns.items()}, strings_can_be_null=True)
        with pacsv.open_csv(pa.CompressedInputStream(pa.BufferReader(content), "gzip"), convert_options=options) as reader:
            if reader.schema.names != list(columns):
                raise ValueError(f"columns are {', '.join(reader.schema.names)}")
            n = 0
            for batch in reader:
                n += batch.num_rows
                if batch.column(required).null_count:
                    raise ValueError(f"{required} is missing in a row")
            return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for content in b.column("content"):
                try:
                    n, error = rows_of(content.as_buffer()), None
                except (ValueError, OSError) as e:  # what a broken archive or a value of another kind raises
                    n, error = 0, str(e).split("\n")[0]
                rows.append(n)
                errors.append(error)
            yield pa.RecordBatch.from_pydict({"symbol": b.column("symbol"), "day": b.column("day"), "rows": pa.array(rows, pa.int64()),
                                              "error": pa.array(errors, pa.string())})

    return run


def ingest_day_files(spark: SparkSession, raw: str, lake: str, jobs: DataFrame, columns: Mapping[str, str],
                     canonical: Callable[[DataFrame], DataFrame], required: str = "timestamp") -> DataFrame:
    """Run the jobs; (symbol, day, status, rows, message) of each.

    ``columns``: names and kinds in the files' order. ``canonical`` turns raw rows into those of the lake, one for one, and
    keeps ``symbol`` and ``day``."""
    jobs = jobs.select(*_KEYS).distinct()
    have = stored_days(spark, lake)
    todo = checkpointed(jobs.join(have, _KEYS, "left_anti"))
    found = _files(spark, raw, "*.csv.gz").join(_bounded(todo), _KEYS, "left_semi").select(*_KEYS, "content")
    checked = found.mapInArrow(_checker(columns, required), "symbol string, day date, rows bigint, error string")
    days = checkpointed(checked.groupBy(*_KEYS).agg(F.sum("rows").alias("rows"), F.min("error").alias("message")))
    good = days.where("message IS NULL").select(*_KEYS, "rows")

    fields = ", ".join(f"`{c}` {k}" for c, k in columns.items())
    # a broken file must not end the scan: its day is not among the good ones, and the count below tells of any other
    lines = (spark.read.schema(f"{fields}, symbol string, day date").option("header", True).option("ignoreCorruptFiles", True)
             .option("pathGlobFilter", "*.csv.gz").csv(raw))
    rows = canonical(lines.join(_bounded(good), _KEYS, "left_semi"))
    status = checkpointed(jobs.join(todo.withColumn("_todo", F.lit(True)), _KEYS, "left").join(days, _KEYS, "left").select(
        *_KEYS, F.when(F.col("_todo").isNull(), "skipped").when(F.col("rows").isNull(), "missing")
        .when(F.col("message").isNotNull(), "error").otherwise("written").alias("status"),
        F.when(F.col("message").isNull(), F.col("rows")).alias("rows"), "message"))
    write_store(rows.withColumn("year", F.year("day")), lake, by=("symbol", "year", "day"))
    _require_written(spark, lake, good)
    return status


def _require_written(spark: SparkSession, lake: str, good: DataFrame) -> None:
    """Fail unless the lake has as many rows of each day as its checked files."""
    expected = good.where("rows > 0")
    if expected.isEmpty():
        return
    there = spark.read.parquet(lake).join(_bounded(expected.select(*_KEYS)), _KEYS, "left_semi").groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    short = expected.join(there, _KEYS, "left").where("n IS NULL OR n <> rows")
    if not short.isEmpty():
        raise RuntimeError(f"days not stored whole: {short.limit(5).collect()}")


def receipt(status: DataFrame) -> DataFrame:
    """One row: jobs asked for, skipped, written, missing and in error, and rows written."""
    of = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count(F.lit(1)).alias("requested"), of("skipped").alias("skipped_existing"), of("written").alias("written"),
                      of("missing").alias("missing"), of("error").alias("errors"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_written"))


def lake_range(spark: SparkSession, lake: str, start: str, end: str, symbols: list[str] | None = None) -> DataFrame:
    """Rows of ``[start, end)``; only folders of these symbols, years and days are read."""
    return load_range(spark.read.parquet(lake), start, end, symbols)


def lake_day(spark: SparkSession, lake: str, symbol: str, day: str) -> DataFrame:
    """One symbol-day: one folder."""
    d = spark.read.parquet(lake)
    date = F.lit(day).cast("date")
    return d.where((F.col("symbol") == symbol) & (F.col("year") == F.year(date)) & (F.col("day") == date))
