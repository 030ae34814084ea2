"""The chunked filter against the plain recursion over whole series."""
import numpy as np
import pytest

from spreadlens.operators import filtering as K, screens as S

N = 150


def legs(seed):
    r = np.random.default_rng(seed)
    x = 2 + np.cumsum(r.normal(0, 0.05, N))
    y = 0.5 + np.cumsum(r.normal(0, 0.01, N)) + (0.8 + np.cumsum(r.normal(0, 0.005, N))) * x + r.normal(0, 0.02, N)
    return y, x


def plain(y, x, qa, qb, r, m, p):
    """The textbook recursion with matrices: (paths, negative log-likelihood, last state, last covariance)."""
    m, p, nll, out = np.array(m, float), np.array(p, float), 0.0, []
    for u, v in zip(y, x):
        h = np.array([1.0, v])
        p = p + np.diag([qa, qb])
        e, s = u - h @ m, h @ p @ h + r
        k = p @ h / s
        nll += 0.5 * (np.log(2 * np.pi * s) + e * e / s)
        m, p = m + k * e, p - np.outer(k, h @ p)
        out.append((*m, e, p[0, 0], p[1, 1]))
    return np.array(out), nll, m, p


def prior(y, x):
    b = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
    a = y.mean() - b * x.mean()
    return a, b, np.var(y - a - b * x, ddof=1)


def table(spark, n=5):
    rows = [(f"p{p}", i + 8, float(y), float(x)) for p in range(n) for i, (y, x) in enumerate(zip(*legs(p)))]
    return spark.createDataFrame(rows, "pair string, i long, la double, lb double").repartition(3)


def test_elements_combine_in_any_grouping():
    y, x = legs(1)
    e = K.elements(y, x, np.float64(1e-5), 1e-6, 1e-3)
    part = lambda a, b: K.total(tuple(v[a:b] for v in e))
    whole = part(0, N)
    for cut in (1, 40, 149):
        assert all(np.allclose(u, v, rtol=1e-9, atol=1e-12) for u, v in zip(whole, K.combine(part(0, cut), part(cut, N))))
    m, p = K.apply((0.3, 0.7, 1.0, 0.1, 2.0), whole)[:2], K.apply((0.3, 0.7, 1.0, 0.1, 2.0), whole)[2:]
    _, _, want, cov = plain(y, x, 1e-5, 1e-6, 1e-3, (0.3, 0.7), [[1.0, 0.1], [0.1, 2.0]])
    assert np.allclose(m, want, atol=1e-9) and np.allclose(p, (cov[0, 0], cov[0, 1], cov[1, 1]), atol=1e-10)


@pytest.mark.parametrize("chunk", [7, 64])
def test_paths(spark, chunk):
    got = S.dynamic_hedge(table(spark), chunk_rows=chunk).orderBy("pair", "i").collect()
    for p in range(5):
        y, x = legs(p)
        a, b, r = prior(y, x)
        want = plain(y, x, 1e-7, 1e-5, r, (a, b), np.eye(2))[0]
        assert np.abs(np.array([row[2:] for row in got if row["pair"] == f"p{p}"]) - want).max() < 1e-8


def test_calibration(spark):
    d = table(spark, 3)
    fits = {r["pair"]: r for r in S.fit_dynamic_hedge(d.where("i < 108"), chunk_rows=11).collect()}
    later = S.forward_hedge(d.where("i >= 108"), S.fit_dynamic_hedge(d.where("i < 108"), chunk_rows=11), chunk_rows=11).orderBy("pair", "i").collect()
    for p in range(3):
        y, x = (v[:100] for v in legs(p))
        a, b, rv = prior(y, x)
        axes = [S._GRID[0], S._GRID[1], np.log(rv) + S._GRID[2]]
        for _ in range(2):
            cells = [np.exp(m.ravel()) for m in np.meshgrid(*axes, indexing="ij")]
            nll = [plain(y, x, *cell, (a, b), np.eye(2))[1] for cell in zip(*cells)]
            k = int(np.argmin(nll))
            best = [v[k] for v in cells]
            axes = [np.log(v) + np.linspace(-1, 1, 5) * (ax[1] - ax[0]) for v, ax in zip(best, axes)]
        f = fits[f"p{p}"]
        assert np.allclose([f["q_alpha"], f["q_beta"], f["r"]], best, rtol=1e-8) and abs(f["nll"] - min(nll)) < 1e-7
        _, _, m, cov = plain(y, x, *best, (a, b), np.eye(2))
        assert np.allclose([f["state_a"], f["state_b"], f["p00"], f["p01"], f["p11"]], [*m, cov[0, 0], cov[0, 1], cov[1, 1]], atol=1e-8)
        y, x = (v[100:] for v in legs(p))
        want = plain(y, x, *best, m, cov)[0]
        assert np.abs(np.array([r[2:] for r in later if r["pair"] == f"p{p}"]) - want).max() < 1e-8
    assert S.fit_dynamic_hedge(d.where("i < 30"), min_rows=30).count() == 0
