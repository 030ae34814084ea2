"""Regimes in chunks of eleven rows against forward-backward and best paths over whole series."""
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.operators import ml, regimes as R

N = 260


def series(seed):
    r = np.random.default_rng(seed)
    state = [0]
    for _ in range(N - 1):
        state.append(state[-1] if r.random() < 0.93 else 1 - state[-1])
    state = np.array(state)
    size = np.where(state == 0, 0.4, 1.6)
    x = np.column_stack([r.normal(0, 1, N) + state, r.normal(0, 1, N) * size, np.abs(size + r.normal(0, 0.3, N))])
    return x, state


def densities(m, x):
    out = np.empty((len(x), len(m.start)))
    for k in range(len(m.start)):
        d, v = x - m.means[k], m.covs[k]
        out[:, k] = -0.5 * (np.einsum("td,de,te->t", d, np.linalg.inv(v), d) + np.log(np.linalg.det(2 * np.pi * v)))
    return out


def plain_step(m, x, floor):
    """One iteration of expectation-maximisation in logarithms, row by row."""
    b, n, k = densities(m, x), len(x), len(m.start)
    la, ls = np.log(m.moves), np.log(m.start)
    f, g = np.empty((n, k)), np.zeros((n, k))
    f[0] = ls + b[0]
    for t in range(1, n):
        f[t] = b[t] + np.logaddexp.reduce(f[t - 1][:, None] + la, axis=0)
    for t in range(n - 2, -1, -1):
        g[t] = np.logaddexp.reduce(la + b[t + 1] + g[t + 1], axis=1)
    ll = np.logaddexp.reduce(f[-1])
    share = np.exp(f + g - ll)
    moves = sum(np.exp(f[t - 1][:, None] + la + b[t] + g[t] - ll) for t in range(1, n))
    w = share.sum(axis=0)
    means = share.T @ x / w[:, None]
    covs = np.array([((share[:, j, None] * (x - means[j])).T @ (x - means[j])) / w[j] for j in range(k)]) + floor * np.eye(x.shape[1])
    return R.Model(share[0], moves / moves.sum(axis=1, keepdims=True), means, covs), ll


def plain_first(x, floor):
    calm = x[:, 2] <= x[:, 2].mean()
    parts = [x[calm], x[~calm]]
    return R.Model(np.full(2, 0.5), np.full((2, 2), 0.5), np.array([p.mean(axis=0) for p in parts]), np.array([np.cov(p.T, ddof=0) + floor * np.eye(3) for p in parts]))


def plain_path(m, x):
    b, la = densities(m, x), np.log(m.moves)
    score, back = np.log(m.start) + b[0], []
    for t in range(1, len(x)):
        step = score[:, None] + la
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + b[t]
    path = [int(score.argmax())]
    for row in reversed(back):
        path.append(int(row[path[-1]]))
    return path[::-1]


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for p in range(4):
        x, _ = series(p)
        rows += [(f"p{p}", i + 4, *map(float, x[i]), i < 200) for i in range(N if p < 3 else 40)]
    d = spark.createDataFrame(rows, "pair string, i int, spread_z double, spread_diff_1 double, spread_vol_24 double, early boolean").repartition(3)
    return d.withColumn("spread_z", F.when((F.col("pair") == "p1") & (F.col("i") == 9), float("inf")).otherwise(F.col("spread_z")))


def features(p):
    x = series(p)[0]
    if p == 1:
        x[5, 0] = 0.0
    return x


@pytest.mark.parametrize("chunk, iterations", [(11, 6), (1 << 20, 50)])
def test_models_and_states(spark, table, chunk, iterations):
    cfg = R.RegimeConfig(iterations=iterations, tolerance=1e-3 if iterations > 6 else 0.0)
    states, models = R.regimes(table, "early", cfg=cfg, chunk_rows=chunk)
    got = {r["pair"]: r for r in models.collect()}
    assert set(got) == {"p0", "p1", "p2"}  # 40 train rows are too few
    paths = {p: [r for r in states.where(F.col("pair") == p).orderBy("i").collect()] for p in got}
    for p in range(3):
        x, row = features(p), got[f"p{p}"]
        m, before = plain_first(x[:200], cfg.floor), None
        for n in range(1, iterations + 1):
            m, ll = plain_step(m, x[:200], cfg.floor)
            if before is not None and ll - before < cfg.tolerance:
                break
            before = ll
        own = pickle.loads(row["model"])
        assert row["iteration"] == n and abs(row["log_likelihood"] - ll) < 1e-6
        assert all(np.allclose(a, b, atol=1e-7) for a, b in zip((own.start, own.moves, own.means, own.covs), (m.start, m.moves, m.means, m.covs)))
        path = plain_path(m, x)
        assert [r["state"] for r in paths[f"p{p}"]] == path and [r["i"] for r in paths[f"p{p}"]] == list(range(4, N + 4))
        train = np.array(plain_path(m, x[:200]))
        calm = int(np.argmin([x[:200][train == s, 1].std() if (train == s).any() else np.inf for s in (0, 1)]))
        assert row["calm"] == calm and [r["mean_reverting_state"] for r in paths[f"p{p}"]] == [s == calm for s in path]
        if iterations > 6:
            assert np.mean(np.array(path) == series(p)[1]) > 0.8 or np.mean(np.array(path) != series(p)[1]) > 0.8
    out = R.model_table(models, ["pair"]).collect()
    assert len(out) == 6 and all(abs(sum(r["moves"]) - 1) < 1e-9 for r in out)


def test_no_rows(table):
    states, models = R.regimes(table.limit(0), "early", cfg=R.RegimeConfig(iterations=2))
    assert states.count() == 0 and models.count() == 0


def test_products_of_any_length():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17):
        t = r.random((n, 2, 2)) + 0.01
        out, logs = R.prefix_products(t, np.zeros(n))
        want = np.eye(2)
        for k in range(n):
            want = want @ t[k]
            assert np.allclose(out[k] * np.exp(logs[k]), want)
        back = R.suffix_products(t)
        want = np.eye(2)
        for k in range(n - 1, -1, -1):
            assert np.allclose(back[k] / back[k].max(), want / want.max())
            want = t[k] @ want


def test_masked_scores(spark):
    d = spark.createDataFrame([(0, 0, True), (2, 0, False), (1, 1, True)], "pred_class int, y_class int, mean_reverting_state boolean")
    assert [r[0] for r in ml.mask_regime(d).select("pred_class").collect()] == [0, 1, 1]
