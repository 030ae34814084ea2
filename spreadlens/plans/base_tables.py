"""Shared DataFrames of the registered queries (the Spark side of the oracle's common CTEs)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core.ordered import DAY_US
from ..operators import bars as B, pairs as P, panel as N
from ..sources.adapters import Tables
from .registry import rnd


def daily_panel(t: Tables) -> DataFrame:
    return t.store("panel", lambda: N.close_panel(t.daily, DAY_US, min_coverage=0.5))


def selected_pairs(t: Tables, top_n: int | None = None) -> DataFrame:
    return t.store(f"pairs_{top_n}", lambda: P.score_candidates(P.pair_moments(daily_panel(t)), 0.2, top_n).select(
        "pair", "sym_a", "sym_b", "corr", "alpha", "beta", "spread_vol"))


def pair_legs(t: Tables, top_n: int | None = None) -> DataFrame:
    return P.pair_legs(daily_panel(t), selected_pairs(t, top_n), ["close", "lp", "volume_usdt"])


def tape_pairs(t: Tables) -> DataFrame:
    """Every unordered pair of the tape's symbols, with the hedge of their hourly closes."""
    def build():
        s = t.bars_1h.select("symbol").distinct()
        p = s.select(F.col("symbol").alias("sym_a")).join(s.select(F.col("symbol").alias("sym_b")), F.col("sym_a") < F.col("sym_b"))
        p = p.withColumn("pair", F.concat_ws("_", "sym_a", "sym_b"))
        legs = B.pair_legs(t.bars_1h.select("symbol", "ts", F.log("close").alias("lc")), p, "ts")
        return legs.groupBy("pair", "sym_a", "sym_b").agg(rnd(F.regr_slope("lc_a", "lc_b")).alias("beta"))
    return t.store("tape_pairs", build)


def spreads(t: Tables, top_n: int | None = None) -> DataFrame:
    return P.static_spread(pair_legs(t, top_n)).withColumnRenamed("lp_a", "la").withColumnRenamed("lp_b", "lb")
