"""Pair statistics from moment matrices.

All C(N,2) pairs need sums such as ``sum(x_a * x_b)``.  Joining the panel with itself would shuffle
N*(N-1)/2 rows per bar; instead each block of bars becomes small symbol-by-bar matrices, and a tile, two
blocks of symbols over one block of bars, gives the moments of all its pairs as matrix products.  What leaves
the task is one row per pair and block, whatever the number of bars.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..core.ordered import core_rows, halo_blocks, block_window  # noqa: F401

LEVEL = ["n", "sa", "sb", "saa", "sbb", "sab"]
LAGGED = ["m", "la", "lb", "pa", "pb", "laa", "lbb", "lab", "paa", "pbb", "pab", "lapa", "lapb", "lbpa", "lbpb"]
RETURN = ["ra", "rb", "raa", "rbb", "rab"]
MOMENTS = LEVEL + LAGGED + RETURN
SWAPPED = {m: t if (t := m.translate(str.maketrans("ab", "ba"))) in MOMENTS else m for m in MOMENTS}
TILE_SYMBOLS = 128


def _matrix(t: pa.Table, idx: str, lo: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, values by symbol and bar, which bars are the block's own) of one side of a tile."""
    code = pc.dictionary_encode(t.column("symbol").combine_chunks())
    names = np.array(code.dictionary.to_pylist(), dtype=object)
    bars, own = t.column(idx).to_numpy() - lo, t.column("_core").to_numpy(zero_copy_only=False).astype(bool)
    x = np.full((len(names), width), np.nan)
    x[code.indices.to_numpy(), bars] = t.column("x").to_numpy(zero_copy_only=False).astype(float)
    core = np.zeros(width, dtype=bool)
    core[bars[own]] = True
    return names, x, core


def _tile_moments(x: np.ndarray, y: np.ndarray, core: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over the bars that both have, for every row of x (a) with every row of y (b)."""
    def level(v):
        ok = np.isfinite(v) & core
        w = np.where(ok, v, 0.0)
        return ok.astype(float), w, w * w

    def moves(v):
        ok = np.isfinite(v[:, 1:]) & np.isfinite(v[:, :-1]) & core[1:]
        last, prior = np.where(ok, v[:, 1:], 0.0), np.where(ok, v[:, :-1], 0.0)
        return ok.astype(float), last, prior

    (ka, a, aa), (kb, b, bb) = level(x), level(y)
    (ma, la, pa_), (mb, lb, pb) = moves(x), moves(y)
    ra, rb = la - pa_, lb - pb
    return {
        "n": ka @ kb.T, "sa": a @ kb.T, "sb": ka @ b.T, "saa": aa @ kb.T, "sbb": ka @ bb.T, "sab": a @ b.T,
        "m": ma @ mb.T, "la": la @ mb.T, "lb": ma @ lb.T, "pa": pa_ @ mb.T, "pb": ma @ pb.T,
        "laa": (la * la) @ mb.T, "lbb": ma @ (lb * lb).T, "lab": la @ lb.T,
        "paa": (pa_ * pa_) @ mb.T, "pbb": ma @ (pb * pb).T, "pab": pa_ @ pb.T,
        "lapa": (la * pa_) @ mb.T, "lapb": la @ pb.T, "lbpa": pa_ @ lb.T, "lbpb": ma @ (lb * pb).T,
        "ra": ra @ mb.T, "rb": ma @ rb.T, "raa": (ra * ra) @ mb.T, "rbb": ma @ (rb * rb).T, "rab": ra @ rb.T,
    }


def _block_moments(keys: list[str], idx: str, schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        down, across = t.column("_down")[0].as_py(), t.column("_across")[0].as_py()
        bars = t.column(idx).to_numpy()
        lo, width = int(bars.min()), int(bars.max() - bars.min() + 1)
        if down == across:
            names, x, core = _matrix(t, idx, lo, width)
            found, (u, v) = _tile_moments(x, x, core), np.triu_indices(len(names), 1)
            left, right = names[u], names[v]
        else:
            sides = [t.filter(pc.equal(t.column("_side"), k)) for k in (down, across)]
            if not (sides[0].num_rows and sides[1].num_rows):
                return schema.empty_table()
            (left_names, x, cx), (right_names, y, cy) = (_matrix(s, idx, lo, width) for s in sides)
            found = _tile_moments(x, y, cx | cy)
            u, v = (k.ravel() for k in np.indices((len(left_names), len(right_names))))
            left, right = left_names[u], right_names[v]
        turned = (left > right).astype(bool)  # the pair's first symbol is the smaller one
        cols = {k: pa.repeat(t.column(k)[0], len(left)) for k in keys}
        cols["sym_a"], cols["sym_b"] = pa.array(np.where(turned, right, left)), pa.array(np.where(turned, left, right))
        cols.update({m: pa.array(np.where(turned, found[SWAPPED[m]][u, v], found[m][u, v])) for m in MOMENTS})
        return pa.table(cols).cast(schema)

    return run


def pair_moments(panel: DataFrame, value: str = "lp", idx: str = "i", keys: list[str] | None = None,
                 rows: int = 4096, symbols: int = TILE_SYMBOLS) -> DataFrame:
    """Moments of every unordered symbol pair, per ``keys``: one row per (keys, pair).

    ``panel`` is gridded on ``idx``.  A task holds a tile: two blocks of about ``symbols`` symbols over ``rows`` bars,
    so a row is sent once for each block of symbols and no task holds all symbols or all bars.  Values are measured
    from the symbol's first value so that the products stay small; slopes, residuals and correlations do not depend
    on it, the intercept is restored by :func:`pair_fit`.
    """
    keys = list(keys or [])
    base = panel.groupBy(*keys, "symbol").agg(F.min_by(value, idx).alias("x0"))
    d = (panel.select(*keys, "symbol", idx, value).join(base, [*keys, "symbol"])
         .select(*keys, "symbol", idx, (F.col(value) - F.col("x0")).alias("x")))
    d = halo_blocks(d, idx, back=1, rows=rows)
    blocks = base.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("symbol") / symbols)).cast("int").alias("_blocks"))
    d = d.join(F.broadcast(blocks)).withColumn("_side", F.pmod(F.xxhash64("symbol"), F.col("_blocks")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *keys, "symbol", idx, "x", "_core", "_blk", "_side",
        F.least("_side", "_other").alias("_down"), F.greatest("_side", "_other").alias("_across"))
    shape = StructType([*(panel.schema[k] for k in keys), StructField("sym_a", StringType()), StructField("sym_b", StringType()),
                        *(StructField(m, DoubleType()) for m in MOMENTS)])
    part = d.groupBy(*keys, "_blk", "_down", "_across").applyInArrow(_block_moments(keys, idx, to_arrow_schema(shape)), shape)
    total = part.groupBy(*keys, "sym_a", "sym_b").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    a = base.select(*keys, F.col("symbol").alias("sym_a"), F.col("x0").alias("a0"))
    b = base.select(*keys, F.col("symbol").alias("sym_b"), F.col("x0").alias("b0"))
    return total.join(a, [*keys, "sym_a"]).join(b, [*keys, "sym_b"])


FIT = ["corr", "alpha", "beta", "spread_vol", "spread_sd0", "phi", "ar_b", "ar_resid_sd"]


def _closed_forms(p: pd.DataFrame) -> dict[str, np.ndarray]:
    n, m = p["n"], p["m"]
    sxx, sxy, syy = p["sbb"] - p["sb"] ** 2 / n, p["sab"] - p["sa"] * p["sb"] / n, p["saa"] - p["sa"] ** 2 / n
    corr = (p["rab"] - p["ra"] * p["rb"] / m) / np.sqrt((p["raa"] - p["ra"] ** 2 / m) * (p["rbb"] - p["rb"] ** 2 / m))
    b = sxy / sxx
    al = (p["sa"] - b * p["sb"]) / n
    ssr = np.maximum(syy - sxy * sxy / sxx, 0.0)
    # residual r = a - alpha - beta*b: sums of r_t, r_{t-1} and their products over rows with a predecessor
    sl, sp = p["la"] - m * al - b * p["lb"], p["pa"] - m * al - b * p["pb"]
    spp = p["paa"] + m * al * al + b * b * p["pbb"] - 2 * al * p["pa"] - 2 * b * p["pab"] + 2 * al * b * p["pb"]
    sll = p["laa"] + m * al * al + b * b * p["lbb"] - 2 * al * p["la"] - 2 * b * p["lab"] + 2 * al * b * p["lb"]
    slp = (p["lapa"] - b * p["lapb"] - al * p["la"] - al * p["pa"] + al * b * p["pb"] + m * al * al
           - b * p["lbpa"] + b * b * p["lbpb"] + al * b * p["lb"])
    vpp, vlp, vll = spp - sp * sp / m, slp - sl * sp / m, sll - sl * sl / m
    phi = vlp / vpp
    return {"corr": corr, "alpha": al + p["a0"] - b * p["b0"], "beta": b, "spread_vol": np.sqrt(ssr / (n - 1)), "spread_sd0": np.sqrt(ssr / n),
            "phi": phi, "ar_b": phi - 1, "ar_resid_sd": np.sqrt(np.maximum(vll - vlp * vlp / vpp, 0.0) / m)}


def pair_fit(moments: DataFrame) -> DataFrame:
    """OLS hedge, residual spread, return correlation and AR(1) of the residual, all in closed form from
    one row of moments per pair; undefined values are null."""
    keys = [x for x in moments.columns if x not in (*MOMENTS, "a0", "b0")]
    types = dict(moments.dtypes)

    def run(batches):
        for pdf in batches:
            with np.errstate(all="ignore"):
                cols = _closed_forms(pdf)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "pair": pdf["sym_a"] + "_" + pdf["sym_b"], "n": pdf["n"], **cols})

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "pair string", "n double", *(f"{x} double" for x in FIT)])
    d = moments.mapInPandas(run, schema)
    ok = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.col(x))
    return d.withColumns({x: ok(x) for x in FIT})


def half_life_ar(b: Column) -> Column:
    """-ln 2 / b of dx = a + b x_{t-1}; null (no reversion) where b >= 0."""
    return F.when(b < 0, -F.log(F.lit(2.0)) / b)


def half_life_ou(b: Column) -> Column:
    """-ln 2 / ln(1 + b), defined for -1 < b < 0."""
    return F.when((b > -1) & (b < 0), -F.log(F.lit(2.0)) / F.log(1 + b))


def ou_kappa(phi: Column) -> Column:
    """Reversion speed -ln(phi); 0 where phi >= 1, and 5 where phi <= 0 (fixed values)."""
    return F.when(phi >= 1, 0.0).when(phi <= 0, 5.0).otherwise(-F.log(phi))


def score_candidates(moments: DataFrame, min_corr: float = 0.2, max_pairs: int | None = None) -> DataFrame:
    """Pairs that pass the correlation gate with their regression columns; the best ``max_pairs`` where ranking is asked for."""
    d = pair_fit(moments).where(F.col("corr") >= min_corr)
    return d if max_pairs is None else d.orderBy(F.col("corr").desc(), "pair").limit(max_pairs)


def rank_by_correlation(panel: DataFrame, top_n: int = 20, min_corr: float = 0.2, idx: str = "i") -> DataFrame:
    """Fallback ranking with the full pair-table schema; untested columns stay null."""
    null = F.lit(None).cast("double")
    return score_candidates(pair_moments(panel, idx=idx), min_corr, top_n).select(
        "pair", "sym_a", "sym_b", "corr", "alpha", F.col("beta").alias("beta_a_on_b"),
        null.alias("beta_instability"), "spread_vol", null.alias("adf_stat"), null.alias("adf_pvalue"),
        null.alias("half_life_hours"), F.col("corr").alias("score"),
        F.lit("correlation_fallback").alias("selection_method"))


def pair_legs(panel: DataFrame, pairs: DataFrame, cols: list[str], on: list[str] | None = None) -> DataFrame:
    """Both legs of each selected pair on the shared time stamps, ``_a``/``_b`` suffixed.

    The pair list joins the panel twice by symbol, then the legs meet on ``(pair, ts)``; work is
    selected pairs x bars.
    """
    on = on or ["ts", "i"]
    a = panel.select(F.col("symbol").alias("sym_a"), *on, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = panel.select(F.col("symbol").alias("sym_b"), *on, *[F.col(c).alias(f"{c}_b") for c in cols])
    left = pairs.join(a, "sym_a")
    right = pairs.select("pair", "sym_b").join(b, "sym_b").drop("sym_b")
    return left.join(right, ["pair", *on])


def static_spread(legs: DataFrame) -> DataFrame:
    return legs.withColumn("spread", F.col("lp_a") - (F.col("alpha") + F.col("beta") * F.col("lp_b")))


def beta_segments(legs: DataFrame, k: int, min_rows: int = 30, min_total: int = 50, keys=("pair",)) -> DataFrame:
    """Slope stability over ``k`` contiguous equal parts: sample sd of slopes over |mean|.

    Rows are numbered from the dense index, so no ordering of a whole pair is needed.
    """
    keys = list(keys)
    span = legs.groupBy(*keys).agg(F.min("i").alias("_i0"), F.count(F.lit(1)).alias("_n"))
    # part s covers rows [floor(s*n/k), floor((s+1)*n/k))
    rn = F.col("i") - F.col("_i0")
    seg = F.floor(((rn + 1) * k - 1) / F.col("_n"))
    s = (legs.join(span, keys).where(F.col("_n") >= min_total).withColumn("_seg", seg)
         .groupBy(*keys, "_seg").agg(F.regr_slope("lp_a", "lp_b").alias("b"), F.count(F.lit(1)).alias("c"))
         .where(F.col("c") >= min_rows))
    return (s.groupBy(*keys).agg(F.avg("b").alias("_mu"), F.stddev_samp("b").alias("_sd"), F.count("b").alias("n_seg"))
            .where(F.col("n_seg") >= 2)
            .select(*keys, "n_seg", (F.col("_sd") / (F.abs("_mu") + 1e-9)).alias("beta_instability")))


def composite_score(rows: DataFrame, parts: dict[str, tuple[float, Column]]) -> DataFrame:
    """Weighted sum of z-scores across the candidates; a constant part scores 0.  The window holds
    one row per candidate pair, capped by the correlation gate."""
    w = Window.partitionBy(F.lit(0))
    d = rows.withColumns({f"_p_{k}": e for k, (_, e) in parts.items()})
    z = {k: F.when(F.stddev_pop(f"_p_{k}").over(w) > 1e-12,
                   (F.col(f"_p_{k}") - F.avg(f"_p_{k}").over(w)) / F.stddev_pop(f"_p_{k}").over(w)).otherwise(0.0)
         for k in parts}
    total = sum((z[k] * wt for k, (wt, _) in parts.items()), F.lit(0.0))
    return d.withColumn("score", total).drop(*[f"_p_{k}" for k in parts])


def variance_ratio(series: DataFrame, keys: list[str], value: str, k: int, idx: str = "i") -> DataFrame:
    """Variance of k-step changes over k times the variance of one-step changes."""
    d = halo_blocks(series, idx, back=k)
    w = block_window(keys, idx)
    d = core_rows(d.withColumns({"_d1": F.col(value) - F.lag(value, 1).over(w),
                                 "_dk": F.col(value) - F.lag(value, k).over(w)}))
    return (d.groupBy(*keys).agg(F.count(value).alias("n"), F.var_samp("_d1").alias("_v1"), F.var_samp("_dk").alias("_vk"))
            .where((F.col("n") >= 5 * k) & (F.col("_v1") > 0))
            .select(*keys, (F.col("_vk") / (k * F.col("_v1"))).alias("vr")))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a pass rate."""
    p = k / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return mid - half, mid + half


def select_ou(panel: DataFrame, windows: DataFrame, n_pairs: int, hl_min: float, hl_max: float,
              min_obs_frac: float = 0.9, min_obs: int = 100) -> DataFrame:
    """Per window: pairs with positive hedge and half-life in the band, fastest first, then tightest."""
    inside = (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("train_end"))
    train = panel.join(F.broadcast(windows.select("split_id", "train_start", "train_end")), inside)
    need = train.groupBy("split_id").agg((F.max("i") - F.min("i") + 1).alias("_bars"))
    fit = pair_fit(pair_moments(train, keys=["split_id"])).join(F.broadcast(need), "split_id")
    d = (fit.withColumn("half_life", half_life_ou(F.col("ar_b")))
         .where((F.col("n") >= min_obs_frac * F.col("_bars")) & (F.col("n") >= min_obs) & (F.col("beta") > 0)
                & F.col("half_life").between(hl_min, hl_max) & (F.col("ar_resid_sd") > 0) & (F.col("spread_sd0") > 0))
         .withColumn("resid_ratio", F.col("ar_resid_sd") / F.col("spread_sd0")))
    w = Window.partitionBy("split_id").orderBy("half_life", "resid_ratio", "pair")
    return (d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_pairs)
            .select("split_id", "pair", "sym_a", "sym_b", "alpha", "beta", F.lit(0.0).alias("mu"),
                    F.col("spread_sd0").alias("sd"), "half_life", "resid_ratio", "rank"))


def select_random(panel: DataFrame, windows: DataFrame, n_pairs: int, seed: int, min_obs_frac: float = 0.9) -> DataFrame:
    """Placebo choice: pairs in the order of a keyed hash, so the draw does not depend on partitions."""
    inside = (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("train_end"))
    train = panel.join(F.broadcast(windows.select("split_id", "train_start", "train_end")), inside)
    need = train.groupBy("split_id").agg((F.max("i") - F.min("i") + 1).alias("_bars"))
    fit = pair_fit(pair_moments(train, keys=["split_id"])).join(F.broadcast(need), "split_id")
    d = fit.where((F.col("n") >= min_obs_frac * F.col("_bars")) & (F.col("spread_sd0") > 0))
    h = F.md5(F.concat_ws("|", "pair", F.lit(str(seed)), F.col("split_id").cast("string")))
    w = Window.partitionBy("split_id").orderBy(h)
    return (d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_pairs)
            .select("split_id", "pair", "sym_a", "sym_b", "alpha", "beta", F.lit(0.0).alias("mu"),
                    F.col("spread_sd0").alias("sd"), "rank"))
