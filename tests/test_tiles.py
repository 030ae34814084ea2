"""Pair moments in tiles and lag products in blocks, against plain loops."""
from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest

from spreadlens.operators import info as N, pairs as P, screens as S


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(9):
        x = np.cumsum(rng.normal(0, 0.02, 1400)) + k
        for i in np.flatnonzero(rng.random(1400) > 0.1):
            rows.append((f"S{k}", int(i) + 100, float(x[i]) if rng.random() > 0.02 else None))
    return rows, spark.createDataFrame(rows, "symbol string, i bigint, lp double").cache()


def _brute(rows):
    wide = pd.DataFrame(rows, columns=["symbol", "i", "x"]).pivot(index="i", columns="symbol", values="x")
    wide = wide.reindex(range(wide.index.min(), wide.index.max() + 1))
    first = {s: g.sort_values("i")["x"].dropna().iloc[0] for s, g in pd.DataFrame(rows, columns=["symbol", "i", "x"]).groupby("symbol")}
    out = {}
    for a, b in itertools.combinations(sorted(wide.columns), 2):
        x, y = wide[a].to_numpy() - first[a], wide[b].to_numpy() - first[b]
        ok = np.isfinite(x) & np.isfinite(y)
        both = ok[1:] & ok[:-1]
        la, pa, lb, pb = x[1:][both], x[:-1][both], y[1:][both], y[:-1][both]
        out[a, b] = {"n": ok.sum(), "sa": x[ok].sum(), "sbb": (y[ok] ** 2).sum(), "sab": (x[ok] * y[ok]).sum(), "m": both.sum(),
                     "lapb": (la * pb).sum(), "lbpa": (lb * pa).sum(), "lapa": (la * pa).sum(), "lbpb": (lb * pb).sum(),
                     "raa": ((la - pa) ** 2).sum(), "rab": ((la - pa) * (lb - pb)).sum(), "rb": (lb - pb).sum(), "laa": (la * la).sum()}
    return out


@pytest.mark.parametrize("rows, symbols", [(4096, 128), (512, 4), (300, 1)])
def test_moments_in_tiles_equal_plain_sums(panel, rows, symbols):
    data, df = panel
    want = _brute([r for r in data])
    got = {(r.sym_a, r.sym_b): r for r in P.pair_moments(df, rows=rows, symbols=symbols).collect()}
    assert set(got) == set(want) and len(got) == 36
    for pair, sums in want.items():
        for name, v in sums.items():
            assert got[pair][name] == pytest.approx(v, rel=1e-9, abs=1e-9), (pair, name)


def test_tiles_keep_keys_apart_and_bear_few_symbols(spark, panel):
    _, df = panel
    two = df.selectExpr("0 AS part", "*").unionByName(df.where("symbol < 'S3'").selectExpr("1 AS part", "*"))
    got = P.pair_moments(two, keys=["part"], rows=512, symbols=2).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {0: 36, 1: 3}
    assert P.pair_moments(df.where("symbol = 'S1'")).count() == 0
    assert P.pair_moments(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows, symbols", [(8192, 128), (50, 2), (7, 1)])
def test_lead_lag_equals_plain_correlations(spark, rows, symbols):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 400)
    data = [("L", int(i), float(x[i])) for i in range(400) if i % 37]
    for k in range(5):
        y = np.roll(x, k) + rng.normal(0, 0.5, 400)
        data += [(f"F{k}", int(i), float(y[i])) for i in range(400) if rng.random() > 0.2]
    data += [("flat", i, 0.25) for i in range(400)]
    got = {(r.symbol, r.lag): r for r in N.lead_lag(spark.createDataFrame(data, "symbol string, i bigint, ret double"), "L", 9, rows, symbols).collect()}
    series = {s: {i: v for q, i, v in data if q == s} for s in {q for q, _, _ in data}}
    for s in series.keys() - {"L"}:
        for lag in range(-9, 10):
            both = [(v, series[s][i + lag]) for i, v in series["L"].items() if i + lag in series[s]]
            assert got[s, lag].n == len(both)
            if s == "flat":
                assert got[s, lag]["corr"] is None
            else:
                assert got[s, lag]["corr"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-10)
    assert len(got) == 6 * 19


@pytest.mark.parametrize("rows", [8192, 64, 5])
def test_whiteness_equals_plain_sums(spark, rows):
    rng, data, want = np.random.default_rng(2), [], {}
    for k, n in (("a", 300), ("b", 211)):
        x = np.convolve(rng.normal(0, 1, n + 3), [1, 0.5, 0.2, 0.1], "valid")
        data += [(k, i + 40, float(v)) for i, v in enumerate(x)]
        d = x - x.mean()
        want[k] = n * (n + 2) * sum(((d[j:] * d[:-j]).sum() / (d * d).sum()) ** 2 / (n - j) for j in range(1, 13))
    got = S.ljung_box(spark.createDataFrame(data, "pair string, i bigint, v double"), ["pair"], "v", 12, rows=rows).collect()
    assert {r.pair: r.lb_stat for r in got} == pytest.approx(want, rel=1e-9)
