"""Evaluation: confusion counts, accuracy, per-class precision / recall / F1.

All three are aggregates; per-class numbers come from the confusion table
(at most classes^2 rows), never from the scored rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.density import col


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (pred.groupBy(col(label).alias("label"), col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))


def accuracy_from_confusion(conf: DataFrame) -> DataFrame:
    return conf.agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
                     / F.sum("n")).alias("accuracy"))


def per_label(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision = tp / predicted, recall = tp / true, over the union of the
    true and predicted classes; 0 when a denominator is 0."""
    return per_label_from_confusion(confusion(pred, label, prediction))


def per_label_from_confusion(conf: DataFrame) -> DataFrame:
    by_class = conf.select(F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("n_true"),
                 F.lit(0).cast("long").alias("n_pred"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("n_true"),
                 F.col("n").alias("n_pred"), F.lit(0).cast("long").alias("tp")))))
    t = by_class.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_true")), F.lit(0.0))
    t = t.select(F.col("cls").alias("label"), prec.alias("precision"), rec.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return t.withColumn("f1", f1)
