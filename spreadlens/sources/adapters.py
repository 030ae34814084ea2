"""Deterministic views that present the test tables as market data.

``trades``, ``book`` and ``bars_1h`` come from ``events``; ``daily`` comes from ``lineitem``.  Prices
are built from whole cents so that sums are exact whatever the order of addition.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.ordered import DAY_US, YEAR_US, running_sum
from ..core.session import checkpointed, prepare

LEVELS = 10


def _cents(value: str):
    return F.round(F.col(value) * 100.0).cast("long")


class Tables:
    """Lazy access to the parquet tables and to the market-data views over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepare(spark), root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        e = self.raw("events")
        t = F.col("event_type")
        side = F.when(t.isin("purchase", "signup"), "buy").when(t.isin("error", "view"), "sell").otherwise("")
        px = (F.lit(10000) + 10 * F.pmod(_cents("value"), F.lit(5))
              + F.when(t.isin("purchase", "signup"), 5).when(t.isin("error", "view"), -5).otherwise(0))
        amount = 1 + F.pmod(F.col("event_id") * 7919, F.lit(2000))
        return (e.select(F.col("event_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("ts"),
                         F.concat(F.lit("S"), F.pmod("user_id", F.lit(8)).cast("string")).alias("symbol"),
                         side.alias("side"), px.cast("long").alias("px_c"), amount.cast("long").alias("amount"))
                .withColumns({"price": F.col("px_c").cast("double") / 100.0,
                              "notional": (F.col("px_c") * F.col("amount")).cast("double") / 100.0}))

    @cached_property
    def book(self) -> DataFrame:
        e = self.raw("events").where("event_id % 2 = 0")
        mid = F.lit(10000) + 10 * F.pmod(_cents("value"), F.lit(5))
        cols = [F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                F.concat(F.lit("S"), F.pmod("user_id", F.lit(8)).cast("string")).alias("symbol")]
        for i in range(1, LEVELS + 1):
            off = 5 + 10 * (i - 1)
            cols += [((mid - off).cast("double") / 100.0).alias(f"bid_px_{i}"),
                     (1 + F.pmod(F.col("event_id") * (30 + i), F.lit(97))).cast("long").alias(f"bid_sz_{i}"),
                     ((mid + off).cast("double") / 100.0).alias(f"ask_px_{i}"),
                     (1 + F.pmod(F.col("event_id") * (60 + i), F.lit(89))).cast("long").alias(f"ask_sz_{i}")]
        return e.select(*cols)

    @cached_property
    def stored(self) -> dict[str, DataFrame]:
        """Tables written once per (session, folder): what a deployment keeps as stores."""
        return {}

    def store(self, name: str, build) -> DataFrame:
        """The stored table ``name``, built and cut from its lineage by a reliable checkpoint at first use."""
        if name not in self.stored:
            self.stored[name] = checkpointed(build())
        return self.stored[name]

    @cached_property
    def bars_1h(self) -> DataFrame:
        h = F.date_trunc("hour", "ts")
        return (self.trades.groupBy("symbol", h.alias("ts")).agg(
            (F.min_by("px_c", "trade_id").cast("double") / 100.0).alias("open"),
            (F.max("px_c").cast("double") / 100.0).alias("high"),
            (F.min("px_c").cast("double") / 100.0).alias("low"),
            (F.max_by("px_c", "trade_id").cast("double") / 100.0).alias("close"),
            F.sum("amount").cast("double").alias("volume")))

    @property
    def daily(self) -> DataFrame:
        return self.store("daily", self._daily)

    def _daily(self) -> DataFrame:
        l = self.raw("lineitem").select(
            F.concat(F.lit("P"), F.pmod("l_suppkey", F.lit(12)).cast("string")).alias("symbol"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            (_cents("l_extendedprice") % 201 - 100).alias("r"), F.col("l_quantity").cast("long").alias("q"))
        # stored, or each of the sums below would read all line items again
        own = checkpointed(l.groupBy("symbol", "ts").agg(F.sum("r").alias("r"), F.sum("q").alias("volume")))
        common = own.groupBy("ts").agg(F.sum("r").alias("rc"))
        own = running_sum(own, ["symbol"], ["ts"], {"cum": "r"}, width_us=YEAR_US)
        common = running_sum(common, [], ["ts"], {"cumc": "rc"}, width_us=YEAR_US)
        return own.join(common, "ts").select(
            "symbol", "ts", F.exp(4.6 + (F.col("cum") + F.col("cumc")).cast("double") / 1e4).alias("close"),
            F.col("volume").cast("double").alias("volume"))


STEP_1D = DAY_US
