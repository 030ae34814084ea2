"""State machines and recursions over long series, in chunks: no task holds a whole key.

A machine turns a chunk of rows into a summary, a function from the state before the chunk to the state after it.
Summaries are small, so a key's summaries are folded in order by one task, which gives every chunk the state it begins
with; then each chunk makes its own rows. Chunks are ranges of the index, the last one of a key needs no summary, and the
input is stored once and read twice.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import BLOCK_ROWS, int_div
from .session import checkpointed

Arrays = dict[str, np.ndarray]


class Machine:
    """``columns`` are read of each row; ``makes`` are the columns that a chunk's rows get."""

    columns: Sequence[str] = ()
    makes: dict[str, str] = {}

    def first(self, a: Arrays) -> Any:
        """The state before a key's first row, which ``a`` begins with."""
        raise NotImplementedError

    def summary(self, a: Arrays) -> Any:
        raise NotImplementedError

    def advance(self, state: Any, summary: Any) -> Any:
        """The state after a chunk; a ``state`` of None is the one before the key's first row."""
        raise NotImplementedError

    def after(self, a: Arrays, state: Any) -> Any:
        """The state after the rows ``a``, which follow ``state``."""
        return self.advance(state, self.summary(a))

    def rows(self, a: Arrays, state: Any) -> dict[str, Any]:
        """The made columns, one value a row, or whole result columns if the scan doesn't keep the rows."""
        raise NotImplementedError


def _arrays(table: pa.Table, names: Iterable[str], idx: str) -> tuple[pa.Table, Arrays]:
    """The rows in order, and the columns as numpy arrays; nulls of numbers are NaN."""
    table = table.take(pa.array(np.argsort(table.column(idx).to_numpy(), kind="stable")))
    return table, {n: table.column(n).to_numpy(zero_copy_only=False) for n in names}


def _ddl(df: DataFrame, names: Iterable[str]) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{n}` {kinds[n]}" for n in names]


def chunked_scan(df: DataFrame, keys: Sequence[str], machine: Machine, idx: str = "i", chunk_rows: int = BLOCK_ROWS, keep_rows: bool = True) -> DataFrame:
    """The rows of ``df`` with the columns that ``machine`` makes; without ``keep_rows`` keys and made columns alone.

    ``idx`` orders a key's rows and need not be free of gaps."""
    keys, read = list(keys), [idx, *machine.columns]
    kept = df.columns if keep_rows else [*keys, *dict.fromkeys(read)]
    d = checkpointed(df.select(*kept).withColumn("_chunk", int_div(F.col(idx).cast("long"), chunk_rows)))
    made = [f"`{n}` {k}" for n, k in machine.makes.items()]
    result = ", ".join([*_ddl(df, df.columns if keep_rows else keys), *made])

    def run(rows: pa.Table, entries: pa.Table | None = None) -> pa.Table:
        if rows.num_rows == 0:
            return pa.table({})
        rows, a = _arrays(rows, read, idx)
        state = pickle.loads(entries.column("_state")[0].as_py()) if entries is not None and entries.num_rows else machine.first(a)
        out = machine.rows(a, state)
        own = {n: rows.column(n) for n in kept} if keep_rows else {k: pa.repeat(rows.column(k)[0], len(next(iter(out.values())))) for k in keys}
        return pa.table({**own, **{n: pa.array(v) if not isinstance(v, pa.Array) else v for n, v in out.items()}})

    ends = d.agg(F.min("_chunk"), F.max("_chunk")).first()
    if ends[0] == ends[1]:  # no key has a second chunk
        return d.groupBy(*keys, "_chunk").applyInArrow(lambda t: run(t), result)

    last = d.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.max("_chunk").alias("_last"))
    same = F.lit(True)
    for k in keys:  # a null key is a key
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    early = d.select(*dict.fromkeys([*keys, *read, "_chunk"])).join(last, same).where("_chunk < _last").drop(*[f"_of_{k}" for k in keys])

    def summarise(t: pa.Table) -> pa.Table:
        t, a = _arrays(t, read, idx)
        head = t.slice(0, 1).select([*keys, "_chunk", "_last"])
        return head.append_column("_summary", pa.array([pickle.dumps((machine.first(a), machine.summary(a)))], pa.binary()))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("_chunk")
        chunks, state, out = t.column("_chunk").to_pylist(), None, []
        for k, code in enumerate(t.column("_summary").to_pylist()):
            first, summary = pickle.loads(code)
            state = machine.advance(first if k == 0 else state, summary)
            out.append(pickle.dumps(state))
        following = [*chunks[1:], t.column("_last")[0].as_py()]
        own = t.select(keys)
        return own.append_column("_chunk", pa.array(following, pa.int64())).append_column("_state", pa.array(out, pa.binary()))

    head = ", ".join(_ddl(df, keys))
    summaries = early.groupBy(*keys, "_chunk").applyInArrow(summarise, f"{head}, _chunk bigint, _last bigint, _summary binary")
    entries = summaries.groupBy(*keys).applyInArrow(fold, f"{head}, _chunk bigint, _state binary")
    return d.groupBy(*keys, "_chunk").cogroup(entries.groupBy(*keys, "_chunk")).applyInArrow(lambda l, r: run(l, r), result)


def compose_prefix(maps: np.ndarray) -> np.ndarray:
    """maps[t, s] is the state after row t from state s before it; the result is the state after row t from s before row 0."""
    out, reach = maps, 1
    while reach < len(out):
        more = out.copy()
        more[reach:] = np.take_along_axis(out[reach:], out[:-reach], axis=1)
        out, reach = more, 2 * reach
    return out


class FiniteMachine(Machine):
    """A machine of few states: every row is a map of states, a chunk the composition of its rows."""

    def maps(self, a: Arrays) -> np.ndarray:
        raise NotImplementedError

    def values(self, states: np.ndarray) -> dict[str, Any]:
        raise NotImplementedError

    def first(self, a: Arrays) -> int:
        return 0

    def summary(self, a: Arrays) -> np.ndarray:
        return compose_prefix(self.maps(a))[-1]

    def advance(self, state: int, summary: np.ndarray) -> int:
        return int(summary[state])

    def rows(self, a: Arrays, state: int) -> dict[str, Any]:
        return self.values(compose_prefix(self.maps(a))[:, state])


def next_true(flags: np.ndarray) -> np.ndarray:
    """For every position p from 0 to n: the first t >= p with a true flag, n if there is none."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1] if n else at, n)
