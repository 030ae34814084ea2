"""Placebo and surrogate series as table transforms.  Randomness is a hash of keys, so a rerun of a lost
task gives the same rows."""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.ordered import YEAR_US, int_div, running_sum
from .inference import hash_normal, hash_unit
from .panel import index_ts

c = F.col


def random_walks(grid: DataFrame, keys: Sequence[str], sigma: Column, seed: int, step_us: int, reps: int = 1, idx: str = "i", out: str = "walk") -> DataFrame:
    """Random walks on a gridded table with matched increment size; adds ``rep`` and the walk."""
    d = grid.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    d = d.withColumns({"_e": hash_normal(*keys, "rep", idx, F.lit(seed)) * sigma, "_ts": index_ts(idx, step_us)})
    return running_sum(d, [*keys, "rep"], [idx], {out: "_e"}, YEAR_US, ts="_ts").drop("_e", "_ts")


def block_shuffle(series: DataFrame, keys: Sequence[str], value: str, block: int, seed: int, idx: str = "i") -> DataFrame:
    """Permute whole blocks of a gridded series; the tail short of a block stays.  Blocks are ranked by
    hash on one row per block and rows join their new place by arithmetic."""
    keys = list(keys)
    span = series.groupBy(*keys).agg(F.min(idx).alias("_i0"), F.count(F.lit(1)).alias("_n"))
    d = series.join(span, keys).withColumn("_b", int_div(c(idx) - c("_i0"), block))
    whole = d.where((c("_b") + 1) * block <= c("_n")).select(*keys, "_b").distinct()
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", *[c(k) for k in keys], c("_b").cast("string"), F.lit(str(seed)))))
    new = whole.withColumn("_to", F.row_number().over(w) - 1)
    d = d.join(new, [*keys, "_b"], "left")
    to = F.coalesce(c("_to"), c("_b"))
    return d.select(*keys, (c("_i0") + to * block + (c(idx) - c("_i0") - c("_b") * block)).alias(idx), c(value))


def phase_randomised(series: DataFrame, keys: Sequence[str], value: str, seed: int, idx: str = "i") -> DataFrame:
    """Same spectrum, random phases: one transform per series (a group is one series of a bounded window)."""
    keys = list(keys)
    types = dict(series.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        x = pdf[value].to_numpy(dtype=float)
        label = "|".join(str(pdf[k].iloc[0]) for k in keys) + f"|{seed}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "little"))
        f = np.fft.rfft(x - x.mean())
        ph = np.exp(2j * np.pi * rng.random(len(f)))
        ph[0] = 1.0
        if len(x) % 2 == 0:
            ph[-1] = 1.0
        out = pdf[[*keys, idx]].copy()
        out[value] = np.fft.irfft(np.abs(f) * ph, n=len(x)) + x.mean()
        return out

    return series.select(*keys, idx, value).groupBy(*keys).applyInPandas(
        run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{idx}` bigint", f"`{value}` double"]))


def cointegrated(grid: DataFrame, keys: Sequence[str], beta: float, half_life: float, sigma_x: float, sigma_e: float, seed: int, step_us: int) -> DataFrame:
    """Positive control ``la = beta * lb + AR(1)`` with a known half-life."""
    keys = list(keys)
    phi = float(np.exp(-np.log(2.0) / half_life))
    types = dict(grid.dtypes)
    d = random_walks(grid.select(*keys, "i"), keys, F.lit(sigma_x), seed, step_us, out="lb")
    d = d.withColumn("_u", hash_normal(*keys, "i", F.lit(seed + 1)) * sigma_e)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        u, e = pdf["_u"].to_numpy(), np.zeros(len(pdf))
        for t in range(1, len(u)):
            e[t] = phi * e[t - 1] + u[t]
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "i": pdf["i"], "la": beta * pdf["lb"].to_numpy() + e, "lb": pdf["lb"]})

    return d.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "i bigint, la double, lb double"]))


def permute_labels(df: DataFrame, keys: Sequence[str], label: str, seed: int, reps: int = 1, ident: str = "pair") -> DataFrame:
    """Permute a column within keys: rank rows by id and labels by hash, meet on rank.  A key is one split's
    list of pairs."""
    keys = list(keys)
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = Window.partitionBy(*keys, "rep")
    a = d.drop(label).withColumn("_r", F.row_number().over(w.orderBy(ident)))
    b = d.select(*keys, "rep", label, ident).withColumn("_r", F.row_number().over(w.orderBy(hash_unit(ident, *keys, "rep", F.lit(seed)), ident))).drop(ident)
    return a.join(b, [*keys, "rep", "_r"]).drop("_r")


def inject_breaks(rows: DataFrame, keys: Sequence[str], mag: float, prob: float, seed: int, ramp: float = 0.3, min_rows: int = 40) -> DataFrame:
    """Push leg A away from the mean by a ramp that starts at a random bar of the first 70 % of the group.

    Needs ``i, la, spread, mu``; groups below ``min_rows`` or above the break probability stay as they are.
    """
    keys = list(keys)
    span = rows.groupBy(*keys).agg(F.min("i").alias("_i0"), F.count(F.lit(1)).alias("_n"))
    lo, hi = F.floor(c("_n") * 0.10), F.floor(c("_n") * 0.70)
    span = span.withColumns({"_tb": lo + F.floor(hash_unit(*keys, F.lit(seed), F.lit("t")) * (hi - lo + 1)),
                             "_hit": (hash_unit(*keys, F.lit(seed), F.lit("p")) < prob) & (c("_n") >= min_rows)})
    d = rows.join(span, keys).withColumn("_k", c("i") - c("_i0"))
    side = d.where(c("_k") == c("_tb")).select(*keys, F.when(c("spread") >= c("mu"), 1.0).otherwise(-1.0).alias("_side"))
    d = d.join(side, keys, "left")
    length = F.greatest(F.lit(2), F.floor((c("_n") - c("_tb")) * ramp))
    share = F.least(F.lit(1.0), (c("_k") - c("_tb")) / (length - 1))
    add = F.when(c("_hit") & (c("_k") >= c("_tb")), c("_side") * share * mag).otherwise(0.0)
    return d.withColumn("la", c("la") + add).withColumn("spread", c("spread") + add).drop("_i0", "_n", "_tb", "_hit", "_k", "_side")
