"""Machines over chunks of seven rows against loops over whole series."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.core.scan import compose_prefix, next_true
from spreadlens.operators import backtest as T, events as V

N = 160


def series(seed):
    r = np.random.default_rng(seed)
    z = np.clip(np.cumsum(r.normal(0, 0.9, N)) * 0.5 + r.normal(0, 0.8, N), -7, 7)
    z[r.random(N) < 0.03] = np.nan
    la, lb = np.cumsum(r.normal(0, 0.05, N)), np.cumsum(r.normal(0, 0.05, N))
    la[r.random(N) < 0.02] = np.nan
    return z, la, lb, r


def value(v):
    return None if not np.isfinite(v) else float(v)


def loop_classes(z, spread, call, entry=1.5, exit_=0.5):
    held, opened, out = 0.0, 0.0, []
    for v, s, k in zip(np.nan_to_num(z), np.sign(np.nan_to_num(spread)), call):
        if held:
            if abs(v) <= exit_ or k == 2 or (s != 0 and s != opened):
                held = 0.0
        elif k == 0 and abs(v) >= entry and s != 0:
            held, opened = -s, s
        out.append(held)
    return out


def loop_exits(z, mode, stop, cap, enter=2.0, exit_=0.5):
    held, age, side, out = 0.0, 0, 0.0, []
    for v in z:
        if not np.isfinite(v):
            held = 0.0
        elif held:
            age += 1
            if (abs(v) >= stop or (mode == "z" and abs(v) <= exit_) or (mode == "time" and age >= cap) or (mode == "conv" and (np.sign(v) != side or age >= cap))):
                held = 0.0
        elif enter <= abs(v) < stop:
            side = np.sign(v)
            held, age = -side, 1
        out.append(held)
    return out


def loop_breaks(z, la, lb, crash, adverse, loss, halt, enter=2.0, exit_=0.5):
    fall = -np.log1p(-crash) if crash else np.inf
    rise, most = -np.log1p(-adverse) if adverse else np.inf, loss or np.inf
    ra, rb = (np.nan_to_num(np.diff(x, prepend=x[:1])) for x in (la, lb))
    held, a0, b0, gain, stopped, out = 0.0, 0.0, 0.0, 0.0, False, []
    for n, v in enumerate(z):
        gain += held * (ra[n] - rb[n])
        if not np.isfinite(v):
            held, gain = 0.0, 0.0
        elif held:
            up, down = (la[n] - a0, lb[n] - b0) if held > 0 else (lb[n] - b0, la[n] - a0)
            broke = abs(v) > exit_ and (up < -fall or up < -rise or down > rise or gain < -most)
            if abs(v) <= exit_ or broke:
                held, gain, stopped = 0.0, 0.0, stopped or (broke and halt)
        elif not stopped and abs(v) >= enter:
            held, a0, b0, gain = -np.sign(v), la[n], lb[n], 0.0
        out.append(held)
    return out


def rows_of(df, name, keys=("pair",)):
    out = {}
    for r in df.orderBy(*keys, "i").collect():
        out.setdefault(tuple(r[k] for k in keys), []).append(r[name])
    return out


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_classes(spark, chunk):
    rows, want = [], {}
    for p in range(12):
        z, spread, _, r = series(p)
        call = r.integers(0, 3, N) * (r.random(N) < 0.3)
        spread = z + r.normal(0, 0.5, N)
        rows += [(f"p{p}", i + 5, value(z[i]), value(spread[i]), int(call[i]), "2000-01-01") for i in range(N)]
        want[(f"p{p}",)] = loop_classes(z, spread, call)
    d = spark.createDataFrame(rows, "pair string, i int, latest_spread_z double, current_spread double, pred_class int, day string").withColumn("ts", F.to_timestamp("day"))
    got = T.class_machine(d.repartition(3), ["pair"], chunk_rows=chunk)
    assert got.columns == [*d.columns, "signal"] and rows_of(got, "signal") == want
    assert any(v for x in want.values() for v in x)


@pytest.mark.parametrize("mode, stop, cap", [("z", 4.0, 1e9), ("z", math.inf, 1e9), ("time", math.inf, 5.0), ("time", 4.0, 18.0), ("conv", 4.0, 1000.0), ("conv", math.inf, 9.0), ("time", 6.0, 0.0)])
def test_exits(spark, mode, stop, cap):
    rows, want = [], {}
    for p in range(8):
        z, *_ = series(p)
        rows += [("a" if p % 2 else None, f"p{p}", i, value(z[i]), mode, stop, cap) for i in range(N)]
        want[("a" if p % 2 else None, f"p{p}")] = loop_exits(z, mode, stop, cap)
    d = spark.createDataFrame(rows, "split string, pair string, i long, z double, exit_mode string, stop double, max_hold double").repartition(3)
    assert rows_of(T.exit_variants(d, ["split", "pair"], chunk_rows=7), "position", ("split", "pair")) == want
    assert any(v for x in want.values() for v in x)


@pytest.mark.parametrize("crash, adverse, loss, halt", [(0.1, 0.2, 0.15, False), (0.1, None, None, True), (None, 0.12, None, False), (None, None, 0.1, True), (None, None, None, False)])
def test_breaks(spark, crash, adverse, loss, halt):
    rows, want = [], {}
    for p in range(12):
        z, la, lb, _ = series(p)
        rows += [(f"p{p}", i, value(z[i]), value(la[i]), value(lb[i])) for i in range(N)]
        want[(f"p{p}",)] = loop_breaks(z, la, lb, crash, adverse, loss, halt)
    d = spark.createDataFrame(rows, "pair string, i long, z double, la double, lb double").repartition(3)
    assert rows_of(T.break_stops(d, ["pair"], crash=crash, adverse=adverse, loss=loss, halt=halt, chunk_rows=7), "position") == want
    assert any(v for x in want.values() for v in x)


def test_cooldown(spark):
    r = np.random.default_rng(1)
    rows, want = [], set()
    for p in range(6):
        last = -math.inf
        for i in np.flatnonzero(r.random(600) < (0.02, 0.1, 0.6, 0.9, 0.3, 0.05)[p]):
            rows.append((f"p{p}", int(i), float(i)))
            if i - last >= 10:
                want.add((f"p{p}", int(i)))
                last = i
    d = spark.createDataFrame(rows, "pair string, i long, z double").repartition(3)
    got = V.cooldown(d, ["pair"], 10, chunk_rows=7)
    assert got.columns == d.columns and {(r["pair"], r["i"]) for r in got.collect()} == want
    assert V.cooldown(d.limit(0), ["pair"], 10, chunk_rows=7).count() == 0


def test_prefixes():
    r = np.random.default_rng(0)
    maps = r.integers(0, 4, (57, 4))
    for s in range(4):
        now, want = s, []
        for m in maps:
            now = m[now]
            want.append(now)
        assert compose_prefix(maps)[:, s].tolist() == want
    assert next_true(np.array([False, True, False])).tolist() == [1, 1, 3, 3] and next_true(np.zeros(0, bool)).tolist() == [0]
