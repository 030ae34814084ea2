"""Regression and time-series inference on keyed series.

Everything reduces to a few sums per key: Gram sums for least squares, and for Newey-West variances
the outer product of *moving sums* of the scores.  With Bartlett weights the long-run covariance is
exactly ``sum_t u_t u_t' / (L + 1)`` where ``u_t`` is the sum of the scores over the last ``L + 1`` bars
and windows hang over both ends, so one window frame replaces ``L`` lag columns.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import BLOCK_ROWS, block_window, core_rows, halo_blocks
from ..core.session import checkpointed
from ..functions.tails import NORMAL, normal_cdf

c = F.col
EULER_GAMMA = 0.5772156649015329


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Correlation of complete rows as an aggregate; null (not an error) where a side does not vary."""
    a, b = (c(x) if isinstance(x, str) else x for x in (a, b))
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sharpe(value: str | Column, per_year: float) -> Column:
    v = c(value) if isinstance(value, str) else value
    return F.avg(v) / F.nullif(F.stddev_samp(v), F.lit(0.0)) * math.sqrt(per_year)


def simple_ols(y: str, x: str) -> dict[str, Column]:
    """Slope, t value, R2 and n of a one-regressor fit as aggregate expressions."""
    n = F.regr_count(y, x)
    b = F.regr_slope(y, x)
    r2 = safe_corr(y, x) * safe_corr(y, x)
    se = F.sqrt((F.regr_syy(y, x) - b * F.regr_sxy(y, x)) / (n - 2) / F.regr_sxx(y, x))
    return {"slope": b, "t": b / se, "r2": r2, "n": n}


def _padded(df: DataFrame, keys: list[str], idx: str, cols: Sequence[str], lag: int) -> DataFrame:
    """Rows plus ``lag`` zero rows after the end of each key, so that windows may hang over."""
    ends = df.groupBy(*keys).agg(F.max(idx).alias("_e"))
    pad = ends.withColumn(idx, F.explode(F.sequence(c("_e") + 1, c("_e") + lag))).drop("_e") if lag else None
    base = df.select(*keys, idx, *cols)
    return base if pad is None else base.unionByName(pad.withColumns({x: F.lit(0.0) for x in cols}), allowMissingColumns=True)


def bartlett(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], lag: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Long-run cross products of ``cols`` (already centred), one row per key, columns ``s_i_j``; the
    index must be gap-free inside a key."""
    keys = list(keys)
    d = _padded(df, keys, idx, cols, lag)
    h = halo_blocks(d, idx, back=lag, rows=rows)
    w = block_window(keys, idx).rowsBetween(-lag, 0)
    h = core_rows(h.withColumns({f"_u_{x}": F.sum(x).over(w) for x in cols}))
    return h.groupBy(*keys).agg(*[
        (F.sum(c(f"_u_{a}") * c(f"_u_{b}")) / (lag + 1)).alias(f"s_{i}_{j}")
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j])


def hac_variance(df: DataFrame, keys: Sequence[str], value: str, lag: int, idx: str = "i") -> DataFrame:
    """Newey-West long-run variance per key with moments: ``n, mean, sd, hac_var``."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    d = df.join(m.select(*keys, "mean"), keys).withColumn("_x", c(value) - c("mean"))
    s = bartlett(d, keys, idx, ["_x"], lag)
    return m.join(s, keys).withColumn("hac_var", F.greatest(c("s_0_0") / c("n"), F.lit(1e-20))).drop("s_0_0")


def hac_sharpe(df: DataFrame, keys: Sequence[str], value: str, lag: int, per_year: float, idx: str = "i") -> DataFrame:
    v = hac_variance(df, keys, value, lag, idx)
    k = math.sqrt(per_year)
    return v.withColumns({"iid_sharpe": c("mean") / c("sd") * k, "hac_sharpe": c("mean") / F.sqrt("hac_var") * k,
                          "inflation": F.sqrt("hac_var") / c("sd")})


def sharpe_with_se(df: DataFrame, keys: Sequence[str], value: str, per_year: float, idx: str = "i") -> DataFrame:
    """Annualised Sharpe with a HAC standard error; the lag follows from each key's length.

    The longest lag of all keys is taken from the count table first; products are formed up to it and
    mask lags past the key's own.
    """
    keys = list(keys)
    m = (df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                               F.var_pop(value).alias("g0"))
         .where((c("n") >= 30) & (c("g0") > 0))
         .withColumn("lag", F.greatest(F.lit(1), F.floor(4 * F.pow(c("n") / 100.0, F.lit(2 / 9)))).cast("int")))
    max_lag = m.agg(F.max("lag")).first()[0] or 1
    d = df.join(m.select(*keys, "mean", "lag"), keys).withColumn("_x", c(value) - c("mean"))
    h = halo_blocks(d, idx, back=max_lag)
    w = block_window(keys, idx)
    # autocovariances divide by the number of products, so each lag keeps its own mean
    prods = {f"_q{j}": F.when(c("lag") >= j, c("_x") * F.lag("_x", j).over(w)) for j in range(1, max_lag + 1)}
    h = core_rows(h.withColumns(prods))
    q = h.groupBy(*keys).agg(*[F.avg(f"_q{j}").alias(f"_q{j}") for j in range(1, max_lag + 1)])
    s = m.join(q, keys)
    hac = c("g0")
    for j in range(1, max_lag + 1):
        hac = hac + F.coalesce(2.0 * (1.0 - F.lit(float(j)) / (c("lag") + 1)) * c(f"_q{j}"), F.lit(0.0))
    infl = hac / c("g0")
    sh = c("mean") / c("sd")
    k = math.sqrt(per_year)
    return s.select(*keys, "n", "lag", (sh * k).alias("sharpe_ann"),
                    (F.sqrt((1 + 0.5 * sh * sh) * infl / c("n")) * k).alias("se_ann"), infl.alias("inflation"))


def deflated_sharpe(trials: DataFrame, sr: str = "sr", skew: str = "skew", kurt: str = "kurt", n: str = "n") -> DataFrame:
    """Expected maximum Sharpe under N trials and the deflated probability; one row per trial.

    The trial table is small by nature; the normal quantiles depend only on its row count.
    """
    one = Window.partitionBy(F.lit(0))
    d = trials.withColumns({"_v": F.coalesce(F.var_samp(sr).over(one), F.lit(0.0)), "_n": F.count(F.lit(1)).over(one)})

    def run(batches):
        for pdf in batches:
            k = np.maximum(pdf["_n"].to_numpy(), 2)
            z1 = np.array([NORMAL.inv_cdf(1 - 1 / x) for x in k])
            z2 = np.array([NORMAL.inv_cdf(1 - 1 / (x * math.e)) for x in k])
            sr0 = np.sqrt(np.maximum(pdf["_v"].to_numpy(), 1e-30)) * ((1 - EULER_GAMMA) * z1 + EULER_GAMMA * z2)
            s = pdf[sr].to_numpy()
            den = np.sqrt(np.maximum(1 - pdf[skew].to_numpy() * s + (pdf[kurt].to_numpy() - 1) / 4 * s * s, 1e-12))
            stat = (s - sr0) * np.sqrt(np.maximum(pdf[n].to_numpy() - 1, 0)) / den
            yield pdf.drop(columns=["_v", "_n"]).assign(sr_0=sr0, dsr=[normal_cdf(float(x)) for x in stat])

    schema = trials.schema.simpleString()[7:-1] + ",sr_0:double,dsr:double"
    return d.mapInPandas(run, schema.replace(":", " "))


# ---- multi-regressor least squares -----------------------------------------------------------------

def gram(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Count and all products of ``[1, xs..., y]`` on complete rows: one map-side-combined aggregate."""
    v = [F.lit(1.0), *[c(x) for x in xs], c(y)]
    full = df.dropna(subset=[*xs, y])
    return full.groupBy(*keys).agg(*[F.sum(v[i] * v[j]).alias(f"g_{i}_{j}")
                                     for i in range(len(v)) for j in range(i, len(v))])


def _gram_matrix(pdf: pd.DataFrame, r: int, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = pdf[f"g_{i}_{j}"].iloc[r]
    return g


def ols_fit(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], standardise: bool = False,
            min_n: int = 1) -> DataFrame:
    """Coefficients, R2 and n per key.  ``b`` holds ``[const, xs...]``; with ``standardise`` the slopes
    are per population standard deviation of the regressor."""
    keys = list(keys)
    k = len(xs) + 2
    g = gram(df, keys, y, xs)
    types = dict(g.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in range(len(pdf)):
                m = _gram_matrix(pdf, r, k)
                n = m[0, 0]
                mean = m[0, 1:] / n
                cov = m[1:, 1:] / n - np.outer(mean, mean)
                sxx, sxy, syy = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
                b = np.linalg.pinv(sxx) @ sxy if len(xs) else np.zeros(0)
                r2 = float(b @ sxy / syy) if syy > 0 else float("nan")
                sd = np.sqrt(np.maximum(np.diag(sxx), 0.0))
                b0 = mean[-1] - mean[:-1] @ b
                if standardise:
                    b0, b = mean[-1], b * np.where(sd > 0, sd, 1.0)
                rows.append({**{q: pdf[q].iloc[r] for q in keys}, "n": int(n), "b": [float(b0), *map(float, b)], "r2": r2,
                             "x_mean": list(map(float, mean[:-1])), "x_sd": list(map(float, sd))})
            yield pd.DataFrame(rows, columns=[*keys, "n", "b", "r2", "x_mean", "x_sd"])

    schema = ", ".join([*(f"`{q}` {types[q]}" for q in keys), "n bigint", "b array<double>", "r2 double",
                        "x_mean array<double>", "x_sd array<double>"])
    return g.mapInPandas(run, schema).where(c("n") >= min_n)


def ols_hac(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], lag: int, idx: str = "i",
            standardise: bool = True, min_n: int = 30) -> DataFrame:
    """Least squares with Newey-West t values: Gram pass, residual pass, moving-sum score pass.

    Rows missing a regressor or the target leave the regression and contribute a zero score, so the
    bar index stays gap-free; keys are numbered on the rows they have.
    """
    keys = list(keys)
    fit = ols_fit(df, keys, y, xs, standardise, min_n)
    d = df.select(*keys, idx, y, *xs).dropna(subset=[y, *xs])
    d = d.join(fit, keys) if keys else d.join(F.broadcast(fit))
    z = [F.lit(1.0)]
    for i, x in enumerate(xs):
        z.append((c(x) - c("x_mean")[i]) / F.when(c("x_sd")[i] > 0, c("x_sd")[i]).otherwise(1.0) if standardise else c(x))
    yhat = sum((c("b")[i] * zi for i, zi in enumerate(z)), F.lit(0.0))
    e = c(y) - yhat
    p = len(z)
    d = d.withColumns({f"_s{i}": zi * e for i, zi in enumerate(z)})
    d = d.withColumns({f"_z{i}_{j}": z[i] * z[j] for i in range(p) for j in range(i, p)})
    bread = d.groupBy(*keys).agg(*[F.sum(f"_z{i}_{j}").alias(f"q_{i}_{j}") for i in range(p) for j in range(i, p)])
    meat = bartlett(d, keys, idx, [f"_s{i}" for i in range(p)], lag)
    j = fit.join(bread, keys).join(meat, keys) if keys else fit.join(F.broadcast(bread)).join(F.broadcast(meat))
    types = dict(fit.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for r in range(len(pdf)):
                q, s = np.zeros((p, p)), np.zeros((p, p))
                for a in range(p):
                    for b in range(a, p):
                        q[a, b] = q[b, a] = pdf[f"q_{a}_{b}"].iloc[r]
                        s[a, b] = s[b, a] = pdf[f"s_{a}_{b}"].iloc[r]
                inv = np.linalg.pinv(q)
                var = np.diag(inv @ s @ inv)
                coef = np.asarray(pdf["b"].iloc[r], dtype=float)
                t = coef / np.sqrt(np.where(var > 0, var, np.nan))
                out.append({**{k: pdf[k].iloc[r] for k in keys}, "n": pdf["n"].iloc[r], "r2": pdf["r2"].iloc[r],
                            "b": list(coef), "t": [float(x) for x in t]})
            yield pd.DataFrame(out, columns=[*keys, "n", "r2", "b", "t"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n bigint", "r2 double", "b array<double>", "t array<double>"])
    return j.mapInPandas(run, schema)


def two_regressor_r2(y: str, a: str, b: str) -> tuple[Column, Column, Column]:
    """R2 of y on a, on b and on both, from pairwise correlations of complete rows."""
    ok = c(y).isNotNull() & c(a).isNotNull() & c(b).isNotNull()
    v = lambda x: F.when(ok, c(x).cast("double"))
    ra, rb, rab = safe_corr(v(y), v(a)), safe_corr(v(y), v(b)), safe_corr(v(a), v(b))
    joint = (ra * ra + rb * rb - 2 * ra * rb * rab) / F.nullif(1 - rab * rab, F.lit(0.0))
    return ra * ra, rb * rb, joint


# ---- bootstraps by replication -----------------------------------------------------------------------

def hash_unit(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from keys only: the same on every cluster layout, after a retry and in any engine
    (the first 40 bits of the digest of the parts joined by bars)."""
    h = F.md5(F.concat_ws("|", *[(c(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 10), 16, 10).cast("double") / float(1 << 40)


def hash_normal(*parts: Column | str) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    u = F.greatest(hash_unit(*parts, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * hash_unit(*parts, F.lit("v")))


def cluster_bootstrap(sums: DataFrame, cluster: str, reps: int, seed: int, total: str = "s", count: str = "n",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Cluster bootstrap of a mean from per-cluster sums.

    Each draw position of each replicate picks one cluster by hash; only (replicate, cluster rank)
    pairs meet the pre-aggregated sums, never raw rows.
    """
    keys = list(keys)
    w = Window.partitionBy(*[c(k) for k in keys] or [F.lit(0)])
    ranked = sums.withColumns({"_k": F.row_number().over(w.orderBy(cluster)) - 1, "_m": F.count(F.lit(1)).over(w)})
    draws = (ranked.select(*keys, "_k", "_m").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
             .withColumn("_pick", F.floor(hash_unit(*keys, "rep", "_k", F.lit(seed)) * c("_m")).cast("int"))
             .groupBy(*keys, "rep", c("_pick").alias("_k")).agg(F.count(F.lit(1)).alias("_w")))
    b = (draws.join(ranked, [*keys, "_k"]).groupBy(*keys, "rep")
         .agg((F.sum(c(total) * c("_w")) / F.sum(c(count) * c("_w"))).alias("stat")))
    point = sums.groupBy(*keys).agg((F.sum(total) / F.sum(count)).alias("point"), F.count(F.lit(1)).alias("n_clusters"))
    ci = b.groupBy(*keys).agg(
        F.percentile("stat", 0.025).alias("lo"), F.percentile("stat", 0.975).alias("hi"),
        F.stddev_samp("stat").alias("se"),
        (2.0 * F.least(F.avg((c("stat") <= 0).cast("double")), F.avg((c("stat") >= 0).cast("double")))).alias("p"))
    return point.join(ci, keys) if keys else point.join(F.broadcast(ci))


def block_bootstrap(series: DataFrame, value: str, block: int, reps: int, seed: int, stat: str = "mean",
                    idx: str = "i", per_year: float = 1.0, circular: bool = True) -> DataFrame:
    """Block bootstrap of a mean or Sharpe.

    A block contributes only its count, sum and sum of squares; these are window sums of the series
    computed once, and a replicate is a weighted sum over its drawn block starts.  The last block is
    used whole, so a replicate has ``ceil(n/block)*block`` draws.
    """
    n = series.agg(F.count(value).alias("n"), F.min(idx).alias("i0"))
    s = series.select((c(idx)).alias("_i"), c(value).cast("double").alias("x"))
    s = s.join(F.broadcast(n)).withColumn("_p", c("_i") - c("i0"))
    if circular:
        # wrap-around rows stand after the end
        s = s.unionByName(s.where(c("_p") < block - 1).withColumn("_p", c("_p") + c("n")))
    h = halo_blocks(s, "_p", fwd=block)
    w = block_window([], "_p").rowsBetween(0, block - 1)
    h = core_rows(h.withColumns({"_c": F.count("x").over(w), "_s": F.sum("x").over(w), "_q": F.sum(c("x") * c("x")).over(w)}))
    starts = h.where((c("_p") < c("n")) & (c("_c") == block)).select("_p", "_s", "_q", "n")
    span = F.when(F.lit(circular), c("n")).otherwise(c("n") - block + 1)
    draws = (n.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).repartition("rep")  # a replicate's draws are made by its task
             .withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(c("n") / block))))
             .withColumn("_p", F.floor(hash_unit("rep", "_d", F.lit(seed)) * span).cast("long")).select("rep", "_p"))
    g = draws.join(starts, "_p").groupBy("rep").agg(
        F.sum("_s").alias("s"), F.sum("_q").alias("q"), (F.count(F.lit(1)) * block).alias("m"))
    mean = c("s") / c("m")
    sd = F.sqrt(F.greatest((c("q") - c("s") * mean) / (c("m") - 1), F.lit(0.0)))
    st = mean if stat == "mean" else F.coalesce(mean / F.nullif(sd, F.lit(0.0)) * math.sqrt(per_year), F.lit(0.0))
    point = F.avg(value) if stat == "mean" else sharpe(value, per_year)
    ci = g.select(st.alias("stat")).agg(F.percentile("stat", 0.025).alias("lo"), F.percentile("stat", 0.975).alias("hi"),
                                        F.stddev_samp("stat").alias("se"), F.count("stat").alias("reps"))
    return series.agg(point.alias("point"), F.count(value).alias("n")).join(F.broadcast(ci))


def market_beta(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Beta (sample covariance over population variance, as published), alpha and neutralised Sharpe inputs."""
    b = F.covar_samp(x, y) / F.var_pop(x)
    return df.groupBy(*keys).agg(b.alias("beta"), (F.avg(y) - b * F.avg(x)).alias("alpha"), safe_corr(x, y).alias("corr"),
                                 F.count(F.lit(1)).alias("n"))


def sign_test_p(k: Column, n: Column) -> Column:
    """Exact two-sided sign test from a win count, by a fold over binomial terms in logs."""
    lo = F.when(2 * k >= n, k).otherwise(F.lit(0).cast("long"))
    hi = F.when(2 * k >= n, n).otherwise(k)
    # log of C(n, i) / 2^n by recurrence from i = 0; the last step's log of zero is not used
    zero = F.struct((-n * math.log(2.0)).alias("lp"), F.lit(0.0).alias("tot"))
    fold = F.aggregate(F.sequence(F.lit(0).cast("long"), n), zero, lambda a, i: F.struct(
        (a["lp"] + F.log(F.greatest(n - i, F.lit(1)).cast("double") / (i + 1))).alias("lp"),
        (a["tot"] + F.when(i.between(lo, hi), F.exp(a["lp"])).otherwise(0.0)).alias("tot")))
    return F.least(F.lit(1.0), 2.0 * fold["tot"])


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return mean / F.nullif(sd / F.sqrt(n), F.lit(0.0))


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def value_positions(df: DataFrame, value: str, keys: Sequence[str] = (), limit: int = 250_000) -> DataFrame:
    """Per key and distinct value: its count ``_c`` and the number of rows below it ``_before``; null keys are left out.

    Equal values collapse map-side first. While a bucket of distinct values (a key's at first) holds more than ``limit``, it
    is cut at 64 approximate quantiles of its own, so 64^n times as many values take n passes more. Values are counted inside
    each bucket and bucket totals are scanned: neither a hot key nor a hot value puts an ordering of many rows into one task.
    """
    keys = list(keys)
    known = df.where(c(value).isNotNull()).dropna(subset=keys) if keys else df.where(c(value).isNotNull())
    v = checkpointed(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))).withColumn("_b", F.array().cast("array<int>"))
    while True:
        full = v.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m")).where(c("_m") > limit).drop("_m")
        if full.isEmpty():
            break
        cuts = v.join(full, [*keys, "_b"], "left_semi").groupBy(*keys, "_b").agg(
            F.percentile_approx(value, [k / 64 for k in range(1, 64)], 10_000).alias("_q"))
        deeper = F.concat("_b", F.array(F.size(F.filter("_q", lambda q: q < c(value)))))
        v = checkpointed(v.join(cuts, [*keys, "_b"], "left").withColumn("_b", F.when(c("_q").isNull(), c("_b")).otherwise(deeper)).drop("_q"))
    total = v.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    part = [c(k) for k in keys] or [F.lit(0)]
    scan = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*keys, "_b", F.coalesce(F.sum("_n").over(scan), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (v.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(total, [*keys, "_b"])
            .select(*keys, value, "_c", (c("_off") + c("_in")).alias("_before")))


def tie_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average ranks of large groups: positions of the distinct values joined back."""
    keys = list(keys)
    r = value_positions(df, value, keys).select(*keys, value, (c("_before") + (c("_c") + 1) / 2.0).alias(out))
    return df.join(r, [*keys, value])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles of large groups, read off the value positions."""
    keys = list(keys)
    names = list(names or [f"q{k}" for k in range(len(probs))])
    v = value_positions(df, value, keys)
    n = v.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    v = v.join(n, keys) if keys else v.join(F.broadcast(n))
    at = lambda r: F.max(F.when((c("_before") <= r) & (r < c("_before") + c("_c")), c(value)))
    aggs = []
    for p, name in zip(probs, names):
        pos = (c("_n") - 1) * p
        aggs += [at(F.floor(pos)).alias(f"_l_{name}"), at(F.ceil(pos)).alias(f"_h_{name}"), F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    g = v.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(c(f"_l_{x}") + (c(f"_h_{x}") - c(f"_l_{x}")) * c(f"_f_{x}")).alias(x) for x in names])


def exact_medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the exact median of each column under its own name; null where a column is."""
    keys = list(keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("_col"), c(x).cast("double").alias("_val")) for x in cols]))
    long = df.select(*keys, pairs.alias("_x")).select(*keys, "_x._col", "_x._val")
    q = exact_quantiles(long, "_val", [0.5], [*keys, "_col"], ["_q"])
    wide = q.groupBy(*keys).agg(*[F.max(F.when(c("_col") == x, c("_q"))).alias(x) for x in cols])
    return df.select(*keys).distinct().join(wide, keys, "left") if keys else wide


def standardise(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Population z-scores within keys; a constant column gives 0.  Statistics come from an aggregate
    joined back, so a large group is never one window."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(*[F.avg(x).alias(f"_a_{x}") for x in cols], *[F.stddev_pop(x).alias(f"_s_{x}") for x in cols])
    d = df.join(st, keys) if keys else df.join(F.broadcast(st))
    return d.withColumns({f"{x}_z": F.when(c(f"_s_{x}") > 1e-12, (c(x) - c(f"_a_{x}")) / c(f"_s_{x}")).otherwise(
        F.when(c(x).isNotNull(), 0.0)) for x in cols}).drop(*[f"_{p}_{x}" for p in "as" for x in cols])


def demean(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    st = df.groupBy(*keys).agg(*[F.avg(x).alias(f"_a_{x}") for x in cols])
    return df.join(st, list(keys)).withColumns({f"{x}_d": c(x) - c(f"_a_{x}") for x in cols}).drop(*[f"_a_{x}" for x in cols])


def winsorise(df: DataFrame, cols: Sequence[str], upper: float | None = None, lower: float | None = None) -> DataFrame:
    """Clip at exact quantiles of the whole sample (one row broadcast back per column)."""
    d = df
    for x in cols:
        for p, name in ((upper, "_u"), (lower, "_l")):
            if p is not None:
                d = d.join(F.broadcast(exact_quantiles(df, x, [p], names=[name])))
                e = F.least(c(x), c(name)) if name == "_u" else F.greatest(c(x), c(name))
                d = d.withColumn(x, F.when(c(x).isNotNull(), e)).drop(name)
    return d


def rank_correlation(df: DataFrame, a: str, b: str, keys: Sequence[str], min_n: int = 10) -> DataFrame:
    keys = list(keys)
    d = df.where(c(a).isNotNull() & c(b).isNotNull())
    d = d.withColumns({"_ra": average_rank(a, keys), "_rb": average_rank(b, keys)})
    return d.groupBy(*keys).agg(safe_corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n")).where(c("n") >= min_n)


def partial_rank_correlation(df: DataFrame, a: str, b: str, ctrl: str, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    d = df.where(c(a).isNotNull() & c(b).isNotNull() & c(ctrl).isNotNull())
    d = d.withColumns({f"_r_{x}": average_rank(x, keys) for x in (a, b, ctrl)})
    g = d.groupBy(*keys).agg(safe_corr(f"_r_{a}", f"_r_{b}").alias("_ab"), safe_corr(f"_r_{a}", f"_r_{ctrl}").alias("_ac"),
                             safe_corr(f"_r_{b}", f"_r_{ctrl}").alias("_bc"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "n", ((c("_ab") - c("_ac") * c("_bc")) / F.sqrt((1 - c("_ac") * c("_ac")) * (1 - c("_bc") * c("_bc")))).alias("partial_rho"))
