"""Ordered computations that never put one key's whole history into one task.

A plain ``Window.partitionBy("symbol")`` sends every row of a symbol to one task, and the busiest
symbol may own a third of the tape.  Two patterns avoid that:

* **chunk and carry** (tape-like data, rows at any time): a symbol's time line is cut into chunks
  of fixed width.  The window runs inside ``(keys, chunk)``; each chunk is also reduced to one
  summary row, the summaries are scanned per key, and what must cross a chunk border is joined
  back.  ``carry_forward``, ``previous_row`` and ``running_sum`` are built this way; operators that need several of
  them in a row make one pass of their own from ``chunked`` and ``chunk_ends``.
* **blocks with a halo** (bars on a grid, one row per index): rows are cut into blocks of equal
  size and the few rows a frame needs from the neighbour are repeated.  See ``halo_blocks``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US
YEAR_US = 366 * DAY_US

BLOCK_ROWS = 8192


def int_div(c: Column, n: int | Column) -> Column:
    """Whole-number division that floors for negatives as well."""
    n = F.lit(n) if isinstance(n, int) else n
    return ((c - F.pmod(c, n)) / n).cast("long")


def chunk_of(ts: str | Column, width_us: int) -> Column:
    return int_div(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts), width_us)


def _order(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in cols]


def _struct(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _scan(keys: Sequence[str]):
    part = [F.col(k) for k in keys] or [F.lit(0)]
    return Window.partitionBy(*part).orderBy("_chunk")


def _attach(df: DataFrame, prefix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join chunk-level values back.  One row per chunk, so a plain equi-join; AQE picks broadcast
    only when the measured size allows it."""
    return df.join(prefix, [*keys, "_chunk"], "left")


def chunked(df: DataFrame, keys: Sequence[str], width_us: int = DAY_US, ts: str = "ts") -> DataFrame:
    """Rows dealt by ``(keys, _chunk)`` once, for windows and summaries that share this exchange."""
    d = df.withColumn("_chunk", chunk_of(ts, width_us))
    return d.repartition(*keys, "_chunk")


def chunk_ends(local: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, _chunk, _e): the last row of every chunk.

    The row is kept whole, so that this branch reads the same columns as the rows do and both read one exchange; rows
    that a window has sorted are not sorted again."""
    return local.groupBy(*keys, "_chunk").agg(F.max_by(_struct(local.columns), _struct(order)).alias("_e"))


def with_ends(local: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``local`` with the columns that ``ends`` has for its chunk; a missing key finds none.

    The ends' keys are made non-null, or the optimizer would filter nulls below their exchange, which then is not the rows' one."""
    keys = list(keys)
    kinds = dict(ends.dtypes)
    right = ends.select(*[(F.coalesce(F.col(k), F.lit("")) if kinds[k] == "string" else F.col(k)).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"),
                        *[x for x in ends.columns if x not in (*keys, "_chunk")])
    on = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return local.join(right, on, "left").drop("_k_chunk", *[f"_k_{k}" for k in keys])


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                  width_us: int = DAY_US, ts: str = "ts") -> DataFrame:
    """Replace each of ``cols`` by its last non-null value at or before the row."""
    d = df.withColumn("_chunk", chunk_of(ts, width_us))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(*keys, "_chunk").agg(*[
        F.expr(f"max_by(`{c}`, struct({', '.join(order)})) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_c_{c}")
        for c in cols])
    before = _scan(keys).rowsBetween(Window.unboundedPreceding, -1)
    prefix = ends.select(*keys, "_chunk", *[
        F.last(f"_c_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in cols])
    local = d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    out = _attach(local, prefix, keys)
    return (out.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in cols})
            .drop("_chunk", *[f"_c_{c}" for c in cols]))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str],
                 width_us: int = DAY_US, ts: str = "ts") -> DataFrame:
    """Add ``out`` = value of ``col`` on the preceding row of the key, for ``{out: col}``."""
    d = df.withColumn("_chunk", chunk_of(ts, width_us))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_order(order))
    src = sorted(set(cols.values()))
    ends = d.groupBy(*keys, "_chunk").agg(F.max_by(_struct(src), _struct(order)).alias("_last"))
    prefix = ends.select(*keys, "_chunk", F.lag("_last").over(_scan(keys)).alias("_last"))
    local = d.withColumns({"_first": F.row_number().over(w) == 1,
                           **{o: F.lag(c).over(w) for o, c in cols.items()}})
    out = _attach(local, prefix, keys)
    return (out.withColumns({o: F.when(F.col("_first"), F.col(f"_last.{c}")).otherwise(F.col(o))
                             for o, c in cols.items()})
            .drop("_chunk", "_first", "_last"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str],
                width_us: int = DAY_US, ts: str = "ts") -> DataFrame:
    """Add ``out`` = running sum of ``col`` up to and including the row, for ``{out: col}``."""
    d = df.withColumn("_chunk", chunk_of(ts, width_us))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in cols.items()])
    before = _scan(keys).rowsBetween(Window.unboundedPreceding, -1)
    prefix = ends.select(*keys, "_chunk", *[F.sum(f"_s_{o}").over(before).alias(f"_s_{o}") for o in cols])
    local = d.withColumns({o: F.sum(c).over(w) for o, c in cols.items()})
    out = _attach(local, prefix, keys)
    return (out.withColumns({o: F.col(o) + F.coalesce(F.col(f"_s_{o}"), F.lit(0)) for o in cols})
            .drop("_chunk", *[f"_s_{o}" for o in cols]))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
              width_us: int = DAY_US, ts: str = "ts") -> DataFrame:
    """1-based row number per key through chunk counts."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {out: "_one"},
                       width_us, ts).drop("_one")


def halo_blocks(df: DataFrame, idx: str, back: int = 0, fwd: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut a gap-free integer index into blocks and repeat border rows into the neighbours.

    Adds ``_blk`` and ``_core``.  A frame reaching at most ``back`` rows before and ``fwd`` rows
    after the current one is exact on rows with ``_core``; drop the others afterwards.
    """
    rows = max(rows, back, fwd, 1)
    i = F.col(idx).cast("long")
    b, r = int_div(i, rows), F.pmod(i, F.lit(rows))
    targets = [b]
    if back:
        targets.append(F.when(r >= rows - back, b + 1))
    if fwd:
        targets.append(F.when(r < fwd, b - 1))
    return (df.withColumns({"_home": b, "_blk": F.explode(F.array_compact(F.array(*targets)))})
            .withColumn("_core", F.col("_blk") == F.col("_home")).drop("_home"))


def block_window(keys: Sequence[str], idx: str):
    return Window.partitionBy(*keys, "_blk").orderBy(idx)


def core_rows(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_blk", "_core")


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
                  ts: str = "ts", left_id: str = "_lid", right_seq: str = "seq",
                  width_us: int = DAY_US) -> DataFrame:
    """Left as-of join: each left row gets ``values`` of the latest right row with ``ts`` <= its own.

    Both sides become one stream ordered by ``(ts, kind, id)``; right rows sort first on ties, and
    the carry crosses chunk borders through summaries, so no key is held by one task.  The right
    row travels as one struct so that its values stay together even when some are null.
    """
    l = left.withColumns({"_kind": F.lit(1), "_ord": F.col(left_id).cast("long"),
                          "_r": F.lit(None).cast(right.select(_struct(values).alias("s")).schema["s"].dataType)})
    keep = left.columns
    r = right.select(*keys, ts, F.lit(0).alias("_kind"), F.col(right_seq).cast("long").alias("_ord"),
                     _struct(values).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    filled = carry_forward(both, keys, [ts, "_kind", "_ord"], ["_r"], width_us, ts)
    return filled.where("_kind = 1").select(*keep, *[F.col(f"_r.{v}").alias(v) for v in values])
