"""Trade bars over a stream: the batch bar with a watermark.  Right-closed buckets as in the batch."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.bars import right_edge, sum_if

c = F.col


def stream_trade_bars(ticks: DataFrame, step_us: int, late: str = "10 seconds") -> DataFrame:
    """Append-mode bars of a tick stream; a bar is final when the watermark passes its right edge."""
    d = ticks.withColumn("bar", right_edge("ts", step_us)).withWatermark("bar", late)
    return d.groupBy("symbol", F.window("bar", f"{step_us} microseconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("amount").cast("double").alias("volume_base"),
        F.sum("notional").alias("volume_quote"),
        sum_if(c("amount"), c("side") == "buy").cast("double").alias("buy_volume_base"),
        sum_if(c("amount"), c("side") == "sell").cast("double").alias("sell_volume_base")
    ).select("symbol", c("_w.start").alias("ts"), "trade_count", "volume_base", "volume_quote", "buy_volume_base", "sell_volume_base",
             (c("buy_volume_base") - c("sell_volume_base")).alias("signed_volume_base"), (c("volume_quote") / F.nullif(c("volume_base"), F.lit(0.0))).alias("vwap"))
