"""State machines and sweeps over a stream: the batch's machines, whose chunks are what each watermark completes.

Rows wait in a key's state until the watermark has passed them, so rows that come out of order are put right; then the
machine makes their columns from the state that it left and a timer waits for the next rows. A key's state is the
machine's state and the rows of the watermark's delay, whatever the length of the stream. Queries need the state store
with column families (``spark.sql.streaming.stateStore.providerClass``, RocksDB). Names of columns begin with a letter,
and none is ``event_us``.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..core.scan import Machine

AT = "event_us"
Fed = tuple[pd.DataFrame | None, Any, int | None]


class _Ordered(StatefulProcessor):
    """Feeds the rows of a key in order, each once the watermark has passed it."""

    order: Sequence[str] = ()

    def feed(self, key: tuple, ready: pd.DataFrame, state: Any, until: int) -> Fed:
        """(rows to put out, state, when something is due without further rows); all rows before ``until`` have come."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.left = handle.getValueState("left", "state BINARY, done BIGINT")

    def _wait(self, rows: pd.DataFrame) -> None:
        self.waiting.appendValue((pickle.dumps(rows),))
        self.handle.registerTimer(int(rows[AT].min()) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done = self.left.get()[1] if self.left.exists() else None
        for batch in rows:
            batch = batch if done is None else batch[batch[AT] >= done]  # what lies before has been decided
            if len(batch):
                self._wait(batch)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready = pd.DataFrame()
        if self.waiting.exists():
            rows = pd.concat([pickle.loads(code) for code, in self.waiting.get()], ignore_index=True)
            self.waiting.clear()
            if len(later := rows[rows[AT] >= until]):
                self._wait(later)
            ready = rows[rows[AT] < until].sort_values([AT, *self.order], kind="stable", ignore_index=True)
        state = pickle.loads(self.left.get()[0]) if self.left.exists() else None
        out, state, due = self.feed(key, ready, state, until)
        self.left.update((pickle.dumps(state), until))
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class _Scan(_Ordered):
    def __init__(self, machine: Machine, order: Sequence[str], columns: Sequence[str]):
        self.machine, self.order, self.columns = machine, list(order), list(columns)

    def feed(self, key: tuple, ready: pd.DataFrame, state: Any, until: int) -> Fed:
        if ready.empty:  # an earlier timer of this batch has taken them
            return None, state, None
        a = {n: ready[n].to_numpy() for n in self.machine.columns}
        state = self.machine.first(a) if state is None else state
        return ready[self.columns].assign(**self.machine.rows(a, state)), self.machine.after(a, state), None


def stream_scan(df: DataFrame, keys: Sequence[str], machine: Machine, ts: str = "ts", order: Sequence[str] = (), late: str = "10 seconds") -> DataFrame:
    """The stream's rows with the columns that ``machine`` makes, as ``chunked_scan`` gives them for a table.

    ``ts`` and then ``order`` order a key's rows. A row comes out when the watermark, ``late`` behind the newest row,
    has passed it; one that comes later than that is dropped."""
    d = df.withColumn(AT, F.unix_micros(ts)).withWatermark(ts, late)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {k}" for n, k in machine.makes.items()]
    return d.groupBy(*keys).transformWithStateInPandas(_Scan(machine, order, df.columns), ", ".join(kinds), "Append", "EventTime")


class _Sweeps(_Ordered):
    """Runs of same-sign trades with small gaps. The state is (last price, tick sign, open run)."""

    order = ("trade_id",)

    def __init__(self, max_gap_ms: int):
        self.max_gap_ms = max_gap_ms

    def _signs(self, ready: pd.DataFrame, price: float, tick: int) -> tuple[np.ndarray, np.ndarray]:
        """(sign of the last price change, sign of the trade)."""
        p, side = ready["price"].to_numpy(dtype=float), ready["side"].to_numpy()
        moved = np.sign(np.nan_to_num(np.diff(p, prepend=price))).astype(int)
        at = np.maximum.accumulate(np.where(moved != 0, np.arange(len(p)), -1))
        ticks = np.where(at >= 0, moved[at], tick)
        return ticks, np.where(side == "buy", 1, np.where(side == "sell", -1, ticks))

    def feed(self, key: tuple, ready: pd.DataFrame, state: Any, until: int) -> Fed:
        price, tick, last = state or (np.nan, 0, None)
        runs = [] if last is None else [last]
        if len(ready):
            ticks, signs = self._signs(ready, price, tick)
            us = ready[AT].to_numpy(dtype=np.int64)
            before = [last["side"], last["end_us"]] if last else [0, us[0]]
            same = signs == np.concatenate([[before[0]], signs[:-1]])
            on = same & (np.diff(us, prepend=before[1]) // 1000 <= self.max_gap_ms)
            on[0] &= last is not None
            for _, g in ready.assign(sign=signs).groupby(np.cumsum(~on)):
                run = {"side": int(g["sign"].iloc[0]), "start_us": int(g[AT].iloc[0]), "end_us": int(g[AT].iloc[-1]),
                       "notional": float(g["notional"].sum()), "n_trades": len(g), "prices": set(g["price"])}
                if on[g.index[0]]:  # the open run goes on
                    run.update(start_us=last["start_us"], notional=last["notional"] + run["notional"],
                               n_trades=last["n_trades"] + run["n_trades"], prices=last["prices"] | run["prices"])
                    runs.pop()
                runs.append(run)
            price, tick = float(ready["price"].iloc[-1]), int(ticks[-1])
        due = runs[-1]["end_us"] + (self.max_gap_ms + 1) * 1000 if runs else until
        last = runs.pop() if runs and due > until else None  # trades to come may join it
        out = [{"symbol": key[0], **r, "levels_walked_est": len(r["prices"])} for r in runs if r["n_trades"] >= 2 and len(r["prices"]) >= 2]
        out = pd.DataFrame(out).drop(columns="prices") if out else None
        return out, (price, tick, last), due if last else None


def stream_sweeps(trades: DataFrame, max_gap_ms: int = 50, late: str = "10 seconds") -> DataFrame:
    """Sweeps of a stream of trades (symbol, ts, trade_id, price, side, notional), each when no trade can join it any more.

    A session window cannot do this: a trade of the other sign ends a run at once, and rows that the watermark has put in
    order are too late for a second operator with event time. So the run's end is a timer."""
    d = trades.select("symbol", "ts", "trade_id", "price", "side", F.col("notional").cast("double").alias("notional"))
    d = d.withColumn(AT, F.unix_micros("ts")).withWatermark("ts", late)
    kinds = "side int, start_us bigint, end_us bigint, notional double, n_trades bigint, levels_walked_est bigint"
    s = d.groupBy("symbol").transformWithStateInPandas(_Sweeps(max_gap_ms), f"symbol string, {kinds}", "Append", "EventTime")
    return s.select("symbol", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "side",
                    "notional", "n_trades", "levels_walked_est")
