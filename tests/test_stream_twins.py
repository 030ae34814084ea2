"""Machines and sweeps over a stream equal the batch, through late rows, many batches and a restart."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from spreadlens.operators import backtest as T, tape as Q
from spreadlens.operators.machines import BreakMachine, ClassMachine
from spreadlens.streaming.machines import stream_scan, stream_sweeps

START = dt.datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def _feed(rows, at, schema, spark, folder, parts, seed):
    """Files that follow each other, whose rows come up to 20 seconds out of order."""
    rng = np.random.default_rng(seed)
    come = sorted(rows, key=lambda r: r[at] + dt.timedelta(seconds=float(rng.random() * 20)))
    step = -(-len(come) // parts)
    for k in range(parts):
        spark.createDataFrame(come[k * step:(k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        yield k


def _run(spark, make, schema, folder):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = (make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
         .outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(150)
    assert q.exception() is None


def _streamed(spark, rows, at, schema, make, folder, end):
    """The query is started anew for every other file; ``end`` is a late row of another key that lets all others out."""
    schema = spark.createDataFrame([], schema).schema
    for k in _feed(rows, at, schema, spark, folder, 4, 3):
        if k % 2:
            _run(spark, make, schema, folder)
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _run(spark, make, schema, folder)
    return spark.read.parquet(f"{folder}/out")


def _walk(n, seed):
    rng, rows = np.random.default_rng(seed), []
    for pair in ("a", "b", "c"):
        z = np.cumsum(rng.normal(0, 0.7, n)) * 0.8
        z = z - np.convolve(z, np.ones(25) / 25, "same")
        la, lb = np.cumsum(rng.normal(0, 0.01, n)), np.cumsum(rng.normal(0, 0.01, n))
        rows += [(pair, i, START + dt.timedelta(seconds=5 * i), float(z[i] * 2), float(z[i]), int(rng.integers(0, 3)), float(la[i]), float(lb[i])) for i in range(n)]
    return rows


WALK = "pair string, i bigint, ts timestamp, z double, current_spread double, pred_class int, la double, lb double"


@pytest.mark.parametrize("name", ["class", "break"])
def test_machines_over_a_stream_equal_the_batch(spark, tmp_path, name):
    rows = _walk(260, 4)
    batch = spark.createDataFrame(rows, WALK).withColumnRenamed("z", "latest_spread_z") if name == "class" else spark.createDataFrame(rows, WALK)
    schema = WALK.replace("z double", "latest_spread_z double", 1) if name == "class" else WALK
    machine = ClassMachine(1.0, 0.3, "out") if name == "class" else BreakMachine(1.2, 0.3, 0.05, 0.06, 0.08, True, "out")
    if name == "class":
        want = T.class_machine(batch, ["pair"], 1.0, 0.3, out="out")
    else:
        from spreadlens.core.scan import chunked_scan
        want = chunked_scan(batch, ["pair"], machine, "i")
    want = {(r.pair, r.i): r.out for r in want.collect()}
    end = ("~", 0, START + dt.timedelta(days=2), 0.0, 0.0, 0, 0.0, 0.0)
    got = _streamed(spark, rows, 2, schema, lambda s: stream_scan(s, ["pair"], machine, late="25 seconds"), str(tmp_path), end).collect()
    assert len(got) == len(want) and {(r.pair, r.i): r.out for r in got} == want
    assert len(set(want.values())) == 3


def test_sweeps_over_a_stream_equal_the_batch(spark, tmp_path):
    rng, rows = np.random.default_rng(6), []
    for s in ("X", "Y"):
        t, price = 0.0, 100.0
        for k in range(400):
            t += float(rng.choice([0.0, 0.4, 2.0, 30.0], p=[0.1, 0.5, 0.3, 0.1]))
            price += float(rng.choice([-0.5, 0.0, 0.5]))
            rows.append((s, START + dt.timedelta(seconds=t), k, price, str(rng.choice(["buy", "buy", "buy", "sell", "?"])), float(rng.integers(1, 50))))
    schema = "symbol string, ts timestamp, trade_id bigint, price double, side string, notional double"
    names = ["symbol", "start_ts", "end_ts", "side", "notional", "n_trades", "levels_walked_est"]
    want = sorted(tuple(r) for r in Q.sweeps(spark.createDataFrame(rows, schema), 1000).select(*names).collect())
    end = ("~", START + dt.timedelta(days=2), 0, 1.0, "buy", 1.0)
    got = sorted(tuple(r) for r in _streamed(spark, rows, 1, schema, lambda s: stream_sweeps(s, 1000, "25 seconds"), str(tmp_path), end).select(*names).collect())
    assert len(want) > 40 and got == want
