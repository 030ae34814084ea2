"""Baselines, boosted trees, scoring and regime masks on sample tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from .inference import hash_unit

c = F.col


def majority_class(train: DataFrame, label: str = "y_class", keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent class per key; the smallest wins a tie."""
    g = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(*keys).agg(F.max_by(label, F.struct("n", -c(label))).alias("pred_class"))


def persist_class(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pred_class", F.lit(1))


def stratified_random(train: DataFrame, rows: DataFrame, ident: Sequence[str], seed: int, keys: Sequence[str] = (), label: str = "y_class",
                      uniform=None) -> DataFrame:
    """Random classes with the train shares: a keyed uniform number against cumulative shares."""
    keys = list(keys)
    sh = train.groupBy(*keys).agg(F.avg((c(label) == 0).cast("double")).alias("_p0"), F.avg((c(label) <= 1).cast("double")).alias("_p1"))
    d = rows.join(sh, keys) if keys else rows.join(F.broadcast(sh))
    u = uniform if uniform is not None else hash_unit(*ident, F.lit(seed))
    return d.withColumn("pred_class", F.when(u < c("_p0"), 0).when(u < c("_p1"), 1).otherwise(2)).drop("_p0", "_p1")


def boosted_classes(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "y_class", trees: int = 10, depth: int = 4):
    """Three-class gradient-boosted trees as one-vs-rest; returns scored rows and the model."""
    va = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    base = GBTClassifier(featuresCol="_x", maxIter=trees, maxDepth=depth, seed=7)
    m = OneVsRest(classifier=base, featuresCol="_x", labelCol="_y", predictionCol="_p").fit(va.transform(train).withColumn("_y", c(label).cast("double")))
    out = m.transform(va.transform(rows)).withColumn("pred_class", c("_p").cast("int"))
    return out.drop("_x", "_p", "rawPrediction"), m


def forest_classes(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "y_class", trees: int = 20, depth: int = 5):
    va = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    m = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=7).fit(
        va.transform(train).withColumn("_y", c(label).cast("double")))
    out = m.transform(va.transform(rows)).withColumn("pred_class", c("_p").cast("int"))
    return out.drop("_x", "_p", "rawPrediction", "probability"), m


def importances(model, features: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def scores(pred: DataFrame, keys: Sequence[str] = (), label: str = "y_class") -> DataFrame:
    """Accuracy and macro-F1 from the confusion counts; a class with no true positives scores 0."""
    keys = list(keys)
    n = pred.groupBy(*keys, label, "pred_class").agg(F.count(F.lit(1)).alias("n"))
    long = (n.select(*keys, c(label).alias("k"), F.when(c(label) == c("pred_class"), c("n")).otherwise(0).alias("tp"), c("n").alias("sup"), F.lit(0).cast("long").alias("prd"))
            .unionByName(n.select(*keys, c("pred_class").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), c("n").alias("prd"))))
    per = long.groupBy(*keys, "k").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("prd").alias("prd"))
    return per.groupBy(*keys).agg(F.sum("sup").alias("n"), (F.sum("tp") / F.sum("sup")).alias("accuracy"),
                                  F.avg(2 * c("tp") / (c("sup") + c("prd"))).alias("macro_f1"))


def trading_scores(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Spread-unit P&L of a class call per sample: trades, mean, total, mean-to-std, drawdown, win rate.

    Samples of a key are ordered by time and pair; the running sums cross year chunks."""
    from .backtest import class_signal, equity_curve
    keys = list(keys)
    d = pred.withColumn("signal", class_signal()).withColumn("trade", c("signal") * c("y_regression"))
    day = d.groupBy(*keys, "ts").agg(F.sum("trade").alias("trade_day"))
    dd = equity_curve(day, keys, "trade_day").groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    on = c("signal") != 0
    g = d.groupBy(*keys).agg(F.count_if(on).alias("trades"), F.avg(F.when(on, c("trade"))).alias("mean_trade"), F.sum("trade").alias("total"),
                             (F.avg(F.when(on, c("trade"))) / F.nullif(F.stddev_samp(F.when(on, c("trade"))), F.lit(0.0))).alias("mean_to_std"),
                             F.avg(F.when(on, (c("trade") > 0).cast("double"))).alias("win_rate"))
    return g.join(dd, keys)


def walk_forward(samples: DataFrame, windows: DataFrame, features: Sequence[str], assign) -> DataFrame:
    """Train and score every window: a loop over the calendar windows, each fit distributed."""
    rows = windows.select("split_id").orderBy("split_id").toLocalIterator()
    tagged = assign(samples)
    out = None
    for r in rows:
        s = tagged.where(c("split_id") == r["split_id"])
        tr, te = s.where(c("ts") < c("train_end")), s.where(c("ts") >= c("train_end"))
        p = forest_classes(tr, te, features, trees=8, depth=4)[0].withColumn("model", F.lit("trees"))
        p = p.unionByName(te.join(F.broadcast(majority_class(tr))).withColumn("model", F.lit("majority")))
        p = p.unionByName(persist_class(te).withColumn("model", F.lit("persist")))
        out = p if out is None else out.unionByName(p)
    return out


def mask_regime(pred: DataFrame) -> DataFrame:
    """Rows outside the mean-reverting state become class 1."""
    return pred.withColumn("pred_class", F.when(c("mean_reverting_state"), c("pred_class")).otherwise(1))
