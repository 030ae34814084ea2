"""Unit-root, whiteness and dynamic-hedge screens over many pairs.

Tests reduce a series to a Gram matrix per block of bars, sum the blocks per pair, and solve one small
system per pair.  The dynamic hedge is a recursion whose chunks combine like filtering elements of a scan.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..core.ordered import BLOCK_ROWS, block_window, core_rows, halo_blocks
from ..core.scan import chunked_scan
from ..core.session import checkpointed
from .filtering import FilterMachine, GridMachine
from ..functions.tails import chi2_sf, unit_root_p

c = F.col


def adf(df: DataFrame, keys: Sequence[str], value: str, idx: str = "i", lags: int = 24, constant: bool = True,
        series: int = 1, prefix: str = "adf") -> DataFrame:
    """Augmented Dickey-Fuller with a fixed number of lags: ``<prefix>_stat``, ``<prefix>_pvalue``, ``n``."""
    keys = list(keys)
    types = dict(df.dtypes)
    head = [f"`{k}` {types[k]}" for k in keys]
    p = lags + 1 + int(constant)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        x = pdf["_x"].to_numpy(dtype=float)
        d = np.diff(x)
        g, n = np.zeros((p + 1, p + 1)), 0
        if len(d) > lags:
            # row t explains d[t] by x[t], d[t-1], ..., d[t-lags]
            t = np.arange(lags, len(d))
            cols = [x[t]] + [d[t - k] for k in range(1, lags + 1)]
            if constant:
                cols.insert(0, np.ones(len(t)))
            m = np.column_stack([*cols, d[t]])
            m = m[pdf["_core"].to_numpy(dtype=bool)[t + 1]]
            g, n = m.T @ m, len(m)
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "g": [g.ravel().tolist()], "n": [n]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.asarray(v, dtype=float) for v in pdf["g"]], axis=0).reshape(p + 1, p + 1)
        n = int(pdf["n"].sum())
        stat = np.nan
        if n > p:
            inv = np.linalg.pinv(g[:p, :p])
            b = inv @ g[:p, p]
            s2 = (g[p, p] - b @ g[:p, p]) / (n - p)
            j = int(constant)
            if s2 > 0 and inv[j, j] > 0:
                stat = float(b[j] / np.sqrt(s2 * inv[j, j]))
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, f"{prefix}_stat": [stat], f"{prefix}_pvalue": [unit_root_p(stat, series)], "n": [n]})

    d = halo_blocks(df.select(*keys, c(idx), c(value).cast("double").alias("_x")).where("_x IS NOT NULL"), idx, back=lags + 1)
    blocks = d.groupBy(*keys, "_blk").applyInPandas(part, ", ".join([*head, "g array<double>", "n bigint"]))
    return blocks.groupBy(*keys).applyInPandas(
        solve, ", ".join([*head, f"`{prefix}_stat` double", f"`{prefix}_pvalue` double", "n bigint"]))


def engle_granger(legs: DataFrame, keys: Sequence[str] = ("pair",), lags: int = 24) -> DataFrame:
    """Residual-based test: OLS per key, then ADF of the residual without constant, two-series p-value."""
    keys = list(keys)
    fit = legs.groupBy(*keys).agg(F.regr_intercept("la", "lb").alias("_a"), F.regr_slope("la", "lb").alias("_b"))
    r = legs.join(fit, keys).withColumn("_res", c("la") - c("_a") - c("_b") * c("lb"))
    return adf(r, keys, "_res", lags=lags, constant=False, series=2, prefix="eg")


def ljung_box(df: DataFrame, keys: Sequence[str], value: str, lags: int = 20, idx: str = "i", rows: int = BLOCK_ROWS) -> DataFrame:
    """Ljung-Box statistic of each key. Sums of products at all lags come from one matrix product a block of ``rows`` bars;
    a missing bar or value makes no product."""
    from .info import lag_products
    keys = list(keys)
    types = dict(df.dtypes)
    m = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.count(value).alias("n"))
    h = halo_blocks(df.select(*keys, idx, value).join(m.select(*keys, "_mu"), keys), idx, back=lags, rows=rows)
    h = h.select(*keys, c(idx).cast("long").alias("_i"), "_blk", "_core", (c(value) - c("_mu")).alias("_x"))

    def products(t: pa.Table) -> pa.Table:
        at, own = t.column("_i").to_numpy(), t.column("_core").to_numpy(zero_copy_only=False).astype(bool)
        head = t.slice(0, 1).select(keys)
        if not own.any():
            return pa.table({**{k: head.column(k).slice(0, 0) for k in keys}, "_k": pa.array([], pa.int32()), "_p": pa.array([], pa.float64())})
        values, lo = t.column("_x").to_numpy(zero_copy_only=False).astype(float), int(at[own].min())
        x = np.full(int(at[own].max()) - lo + 1 + lags, np.nan)
        near = at >= lo - lags
        x[at[near] - lo + lags] = values[near]
        sums = lag_products(x, x[None, lags:])["xy"][0][::-1]
        return pa.table({**{k: pa.repeat(head.column(k)[0], lags + 1) for k in keys}, "_k": pa.array(np.arange(lags + 1, dtype=np.int32)), "_p": pa.array(sums)})

    p = h.groupBy(*keys, "_blk").applyInArrow(products, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_k int, _p double"]))
    p = p.groupBy(*keys, "_k").agg(F.sum("_p").alias("_p"))
    g = p.groupBy(*keys).agg(F.max(F.when(c("_k") == 0, c("_p"))).alias("_g0"), F.collect_list(F.when(c("_k") > 0, F.struct("_k", "_p"))).alias("_all"))
    each = lambda v: F.pow(v["_p"] / c("_g0"), F.lit(2.0)) / (c("n") - v["_k"])
    q = F.aggregate(F.array_sort("_all"), F.lit(0.0), lambda s, v: s + each(v))
    s = g.join(m, keys).select(*keys, "n", (c("n") * (c("n") + 2) * q).alias("lb_stat"))

    def tail(batches):
        for pdf in batches:
            yield pdf.assign(lb_pvalue=[chi2_sf(float(v), lags) for v in pdf["lb_stat"]])

    types = dict(s.dtypes)
    return s.mapInPandas(tail, ", ".join([f"`{k}` {v}" for k, v in types.items()] + ["lb_pvalue double"]))


# ---- dynamic hedge -------------------------------------------------------------------------------------

_GRID = (np.linspace(-20, -2, 7), np.linspace(-20, -2, 7), np.linspace(-3, 1, 5))


def _ols(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prior and residual variance per key, and its number of rows."""
    x, y = c("lb"), c("la")
    slope = F.covar_samp("lb", "la") / F.greatest(F.var_samp("lb"), F.lit(1e-300))
    g = legs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), slope.alias("beta_ols"))
    g = g.withColumn("alpha_ols", c("_my") - c("beta_ols") * c("_mx"))
    v = legs.join(g, list(keys)).groupBy(*keys).agg(F.var_samp(y - c("alpha_ols") - c("beta_ols") * x).alias("_rv"))
    return g.select(*keys, "_n", "alpha_ols", "beta_ols").join(v, list(keys))


def dynamic_hedge(legs: DataFrame, q_alpha: float = 1e-7, q_beta: float = 1e-5, p0: float = 1.0, keys: Sequence[str] = ("pair",),
                  chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Filtered intercept, slope, one-step residual and state variances with default noise; the prior and
    the observation noise come from OLS over the key."""
    keys = list(keys)
    d = legs.select(*keys, "i", "la", "lb").join(_ols(legs, keys), keys)
    d = d.select(*keys, "i", "la", "lb", F.lit(q_alpha).alias("q_alpha"), F.lit(q_beta).alias("q_beta"), F.when(c("_rv") > 0, c("_rv")).otherwise(1e-4).alias("r"),
                 c("alpha_ols").alias("state_a"), c("beta_ols").alias("state_b"), F.lit(p0).alias("p00"), F.lit(0.0).alias("p01"), F.lit(p0).alias("p11"))
    return chunked_scan(d, keys, FilterMachine(), "i", chunk_rows).select(*keys, "i", *FilterMachine.shown)


def fit_dynamic_hedge(train: DataFrame, keys: Sequence[str] = ("pair",), min_rows: int = 30, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Noise calibration by likelihood on the train rows: a log grid and one finer pass around its best cell.

    The observation noise is relative to the OLS residual.  A task scores all cells on one chunk; a key's cells are
    sums over its chunks, and the smallest wins (of equal ones the first)."""
    keys = list(keys)
    legs = checkpointed(train.select(*keys, "i", "la", "lb"))
    prior = _ols(legs, keys).where(c("_n") >= min_rows).select(*keys, "alpha_ols", "beta_ols", F.log(F.greatest("_rv", F.lit(1e-8))).alias("_lr"))
    axes = [F.array(*[F.lit(float(v)) for v in _GRID[0]]), F.array(*[F.lit(float(v)) for v in _GRID[1]]), F.array(*[c("_lr") + float(v) for v in _GRID[2]])]
    names = ["q_alpha", "q_beta", "r"]
    grid = checkpointed(prior.select(*keys, "alpha_ols", "beta_ols", *[a.alias(f"_x_{n}") for a, n in zip(axes, names)]))
    for last in (False, True):
        cells = chunked_scan(legs.join(grid, keys), keys, GridMachine(), "i", chunk_rows, keep_rows=False)
        best = cells.groupBy(*keys, "cell").agg(F.sum("nll").alias("nll")).groupBy(*keys).agg(F.min(F.struct("nll", "cell")).alias("b")).select(*keys, "b.*")
        sizes = [F.size(f"_x_{n}") for n in names]
        at = [F.floor(c("cell") / (sizes[1] * sizes[2])), F.floor(c("cell") / sizes[2]) % sizes[1], c("cell") % sizes[2]]
        picked = best.join(grid, keys)
        values = {n: F.element_at(f"_x_{n}", (k + 1).cast("int")) for n, k in zip(names, at)}
        if last:
            break
        finer = {n: F.array(*[values[n] + float(v) * (c(f"_x_{n}")[1] - c(f"_x_{n}")[0]) for v in np.linspace(-1, 1, 5)]) for n in names}
        grid = checkpointed(picked.select(*keys, "alpha_ols", "beta_ols", *[x.alias(f"_x_{n}") for n, x in finer.items()]))
    fit = picked.select(*keys, *[F.exp(v).alias(n) for n, v in values.items()], "nll", "alpha_ols", "beta_ols")
    start = {"state_a": c("alpha_ols"), "state_b": c("beta_ols"), "p00": F.lit(1.0), "p01": F.lit(0.0), "p11": F.lit(1.0)}
    run = chunked_scan(legs.join(fit.drop("nll"), keys).withColumns(start), keys, FilterMachine(), "i", chunk_rows)
    end = run.groupBy(*keys).agg(F.max_by(F.struct("alpha_t", "beta_t", "var_alpha", "cov_ab", "var_beta"), "i").alias("e"))
    state = [c(f"e.{a}").alias(b) for a, b in zip(("alpha_t", "beta_t", "var_alpha", "cov_ab", "var_beta"), start)]
    return fit.join(end, keys).select(*keys, "q_alpha", "q_beta", "r", "nll", *state, "alpha_ols", "beta_ols")


def forward_hedge(test: DataFrame, fitted: DataFrame, keys: Sequence[str] = ("pair",), from_prior: bool = False, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Roll the fitted filter over later rows (or, ``from_prior``, over the train rows themselves)."""
    keys = list(keys)
    d = test.select(*keys, "i", "la", "lb").join(fitted, keys)
    if from_prior:
        d = d.withColumns({"state_a": c("alpha_ols"), "state_b": c("beta_ols"), "p00": F.lit(1.0), "p01": F.lit(0.0), "p11": F.lit(1.0)})
    return chunked_scan(d.select(*keys, "i", *FilterMachine.columns), keys, FilterMachine(), "i", chunk_rows).select(*keys, "i", *FilterMachine.shown)


def train_test_screen(legs: DataFrame, cut, lags: int = 24, min_train: int = 200, min_test: int = 100, burn_in: int = 50) -> DataFrame:
    """Static against dynamic hedge, in and out of sample, per pair: one row with four tests."""
    t = F.lit(cut).cast("timestamp")
    # the legs and the fits feed several tests each: cut their lineage once, reliably
    legs = checkpointed(legs.select("pair", "ts", "i", "la", "lb"))
    tr, te = legs.where(c("ts") < t), legs.where(c("ts") >= t)
    ok = legs.groupBy("pair").agg(F.count_if(c("ts") < t).alias("n_tr"), F.count_if(c("ts") >= t).alias("n_te"),
                                  F.min("i").alias("_i0")).where((c("n_tr") >= min_train) & (c("n_te") >= min_test))
    tr, te = tr.join(ok, "pair", "left_semi"), te.join(ok, "pair", "left_semi")
    fit = tr.groupBy("pair").agg(F.regr_intercept("la", "lb").alias("_a"), F.regr_slope("la", "lb").alias("static_beta"))
    res = lambda d: d.join(fit, "pair").withColumn("_s", c("la") - c("_a") - c("static_beta") * c("lb"))
    kf = checkpointed(fit_dynamic_hedge(tr))
    inn_in = forward_hedge(tr, kf, from_prior=True).join(ok.select("pair", "_i0"), "pair").where(c("i") >= c("_i0") + burn_in)
    inn_out = forward_hedge(te, kf)
    parts = [adf(res(tr), ["pair"], "_s", lags=lags, prefix="static_in").drop("n"), adf(res(te), ["pair"], "_s", lags=lags, prefix="static_out").drop("n"),
             adf(inn_in, ["pair"], "innovation", lags=lags, prefix="filter_in").drop("n"), adf(inn_out, ["pair"], "innovation", lags=lags, prefix="filter_out").drop("n")]
    out = fit.select("pair", "static_beta").join(kf.select("pair", "q_alpha", "q_beta", "r", "state_b"), "pair")
    for p in parts:
        out = out.join(p, "pair")
    std = inn_out.groupBy("pair").agg(F.stddev_samp("innovation").alias("filter_out_std"))
    return out.join(std, "pair")


THRESHOLDS = (0.001, 0.005, 0.01, 0.05, 0.10)


def pass_counts(screen: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs passing each p-value threshold, per test column."""
    long = screen.unpivot([*keys], list(cols), "test", "p") if keys else screen.select(*cols).unpivot([], list(cols), "test", "p")
    return long.groupBy(*keys, "test").agg(F.count("p").alias("n"), *[F.count_if(c("p") < x).alias(f"p_lt_{str(x).replace('0.', '')}") for x in THRESHOLDS])


def selected_schema(screen: DataFrame, max_p: float, top_n: int) -> DataFrame:
    """Best pairs by out-of-sample p-value in the pair-table schema."""
    null = F.lit(None).cast("double")
    return (screen.where(c("filter_out_pvalue") < max_p).orderBy("filter_out_pvalue", "pair").limit(top_n).select(
        "pair", "sym_a", "sym_b", "corr", F.lit(0.0).alias("alpha"), c("static_beta").alias("beta_a_on_b"), null.alias("beta_instability"),
        c("filter_out_std").alias("spread_vol"), c("filter_out_stat").alias("adf_stat"), c("filter_out_pvalue").alias("adf_pvalue"),
        null.alias("half_life_hours"), (-c("filter_out_pvalue")).alias("score"), F.lit("kalman_oos_cointegration").alias("selection_method")))


def expanding_oos(df: DataFrame, y: str, xs: Sequence[str], refit: int, min_train: int, key: str = "symbol", idx: str = "hour") -> DataFrame:
    """Expanding-window prediction with a refit every ``refit`` bars; R2 against the expanding mean.

    Gram sums per refit segment are accumulated over segments, so each segment's coefficients come from
    one small solve; rows join their segment's coefficients.
    """
    k = len(xs) + 1
    first = df.groupBy(key).agg(F.min(idx).alias("_i0"))
    d = df.join(first, key).withColumn("_pos", c(idx) - c("_i0"))
    # rows before min_train belong to segment 0; later segments hold `refit` bars each
    d = d.withColumn("seg", F.when(c("_pos") < min_train, 0).otherwise(F.floor((c("_pos") - min_train) / refit) + 1).cast("int"))
    v = [F.lit(1.0), *[c(x) for x in xs], c(y)]
    sums = [F.sum(v[i] * v[j]).alias(f"g_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    g = d.groupBy(key, "seg").agg(*sums)
    w = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    g = g.select(key, "seg", *[F.sum(f"g_{i}_{j}").over(w).alias(f"g_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).where("seg > 0")

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in range(len(pdf)):
                m = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        m[i, j] = m[j, i] = pdf[f"g_{i}_{j}"].iloc[r]
                rows.append(np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0].tolist())
            yield pd.DataFrame({key: pdf[key], "seg": pdf["seg"], "b": rows})

    types = dict(g.dtypes)
    coef = g.mapInPandas(solve, f"`{key}` {types[key]}, seg int, b array<double>")
    run = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(key, "seg").agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    before = before.select(key, "seg", F.coalesce(F.sum("_s").over(run), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy(key, "seg").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    e = d.withColumns({"_s": F.coalesce(F.sum(y).over(inside), F.lit(0.0)), "_c": F.count(y).over(inside)})
    e = e.where("seg > 0").join(before, [key, "seg"]).join(coef, [key, "seg"])
    pred = c("b")[0] + sum((c("b")[i + 1] * c(x) for i, x in enumerate(xs)), F.lit(0.0))
    mean = (c("_s0") + c("_s")) / F.nullif(c("_c0") + c("_c"), F.lit(0))
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                              (1 - F.sum((c(y) - pred) * (c(y) - pred)) / F.sum((c(y) - mean) * (c(y) - mean))).alias("r2_oos"))


def return_pca(returns: DataFrame, k: int = 5, value: str = "r") -> tuple[DataFrame, DataFrame]:
    """Principal components of standardised returns: spectrum and scores, signs fixed by the largest loading.

    The symbol-by-symbol correlation matrix is tiny; it comes from the pair moments, and scores are sums of
    loadings times z-scores by joins.
    """
    spark = returns.sparkSession
    st = returns.groupBy("symbol").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).where(c("s") > 0)
    z = returns.join(st, "symbol").select("symbol", "i", ((c(value) - c("m")) / c("s")).alias("z"))
    from .pairs import pair_moments
    mom = pair_moments(z.withColumnRenamed("z", "lp"), value="lp")
    r = mom.select("sym_a", "sym_b", ((c("sab") - c("sa") * c("sb") / c("n")) / F.sqrt((c("saa") - c("sa") * c("sa") / c("n")) * (c("sbb") - c("sb") * c("sb") / c("n")))).alias("r"))

    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        syms = sorted(set(pdf["sym_a"]) | set(pdf["sym_b"]))
        at = {s: n for n, s in enumerate(syms)}
        m = np.eye(len(syms))
        for a, b, v in zip(pdf["sym_a"], pdf["sym_b"], pdf["r"]):
            m[at[a], at[b]] = m[at[b], at[a]] = v
        val, vec = np.linalg.eigh(m)
        order = np.argsort(-val)[:k]
        rows = []
        for pc, j in enumerate(order):
            v = vec[:, j] * np.sign(vec[np.argmax(np.abs(vec[:, j])), j])
            rows += [(pc + 1, float(val[j]), float(val[j] / len(syms)), s, float(v[at[s]])) for s in syms]
        return pd.DataFrame(rows, columns=["pc", "eigenvalue", "share", "symbol", "loading"])

    load = r.groupBy(F.lit(0).alias("_g")).applyInPandas(eig, "pc int, eigenvalue double, share double, symbol string, loading double")
    scores = z.join(F.broadcast(load), "symbol").groupBy("i", "pc").agg(F.sum(c("z") * c("loading")).alias("score"))
    return load, scores
