"""Chunked and blocked computations against plain windows, with chunks and blocks far below the data size."""
import random

from pyspark.sql import Window, functions as F

from spreadlens.core import ordered as O
from spreadlens.operators import inference as I


def tape(spark, n=400):
    r = random.Random(1)
    rows = [(k, "A" if r.random() < 0.7 else "B", 1_000_000 * (k // 3), r.choice([None, 1.0, 2.0, 5.0])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, k string, us long, v double").withColumn("ts", F.timestamp_micros("us"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select("id", *cols).collect())


def test_carry_previous_and_running_sum(spark):
    d, w = tape(spark), Window.partitionBy("k").orderBy("ts", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    args = (["k"], ["ts", "id"])
    assert rows(O.carry_forward(d, *args, ["v"], 7_000_000), "v") == rows(d.withColumn("v", F.last("v", True).over(up)), "v")
    assert rows(O.previous_row(d, *args, {"p": "v"}, 7_000_000), "p") == rows(d.withColumn("p", F.lag("v").over(w)), "p")
    d2 = d.fillna(0.0)
    assert rows(O.running_sum(d2, *args, {"s": "v"}, 7_000_000), "s") == rows(d2.withColumn("s", F.sum("v").over(up)), "s")
    assert rows(O.row_index(d, *args, "rn", 7_000_000), "rn") == rows(d.withColumn("rn", F.row_number().over(w).cast("long")), "rn")


def test_halo_blocks_equal_plain_window(spark):
    d = spark.range(500).withColumns({"k": F.lit("x"), "v": F.sin("id")})
    h = O.halo_blocks(d, "id", back=9, fwd=4, rows=20)
    f = lambda w: {"m": F.sum("v").over(w.rowsBetween(-9, 0)), "l": F.lead("v", 4).over(w)}
    assert rows(O.core_rows(h.withColumns(f(O.block_window(["k"], "id")))), "m", "l") == rows(d.withColumns(f(Window.partitionBy("k").orderBy("id"))), "m", "l")


def test_positions_and_quantiles_with_a_hot_value(spark):
    d = spark.range(1000).withColumns({"k": F.lit("x"), "v": F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") % 41).cast("double"))})
    q = I.exact_quantiles(d, "v", [0.1, 0.5, 0.99], ["k"]).first()
    e = d.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("q")).first()["q"]
    assert [q["q0"], q["q1"], q["q2"]] == e
    a = rows(I.tie_ranks(d, "v", "r", ["k"]), "r")
    assert a == rows(d.withColumn("r", I.average_rank("v", ["k"])), "r")


def test_full_buckets_are_cut_again(spark):
    table = lambda x, *cols: sorted(tuple(r) for r in x.select(*cols).collect())
    d = spark.range(6000).withColumns({"k": F.when(F.col("id") % 5 == 0, "small").when(F.col("id") % 997 == 1, None).otherwise("large"),
                                       "v": F.when(F.col("id") % 4 == 0, -1.0).otherwise(F.round(F.exp(F.pmod(F.xxhash64("id"), F.lit(2000)) / 150.0), 9))})
    d = d.unionByName(d.limit(50).withColumns({"k": F.lit("none"), "v": F.lit(None).cast("double")}))
    w = Window.partitionBy("k").orderBy("v")
    known = d.where("k IS NOT NULL AND v IS NOT NULL")
    want = known.groupBy("k", "v").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for limit in (2, 40, 1000, 250_000):
        assert table(I.value_positions(d, "v", ["k"], limit), "k", "v", "_c", "_before") == table(want, "k", "v", "_c", "_before")
    whole = known.groupBy("v").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert table(I.value_positions(known, "v", (), 30), "v", "_c", "_before") == table(whole, "v", "_c", "_before")
    m = {r["k"]: (r["v"], r["w"]) for r in I.exact_medians(d.withColumn("w", -F.col("v")), ["v", "w"], ["k"]).where("k IS NOT NULL").collect()}
    e = {r["k"]: (r["v"], r["w"]) for r in d.where("k IS NOT NULL").groupBy("k").agg(F.median("v").alias("v"), F.median(-F.col("v")).alias("w")).collect()}
    assert m == e and m["none"] == (None, None)


def test_bartlett_equals_the_textbook_sum(spark):
    r = random.Random(2)
    x = [r.gauss(0, 1) for _ in range(300)]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i long, x double")
    m = sum(x) / len(x)
    c = [v - m for v in x]
    want = sum(v * v for v in c) / 300
    for j in range(1, 13):
        want += 2 * (1 - j / 13) * sum(a * b for a, b in zip(c[j:], c)) / 300
    got = I.hac_variance(d, ["k"], "x", 12).first()["hac_var"]
    assert abs(got - want) < 1e-10
