"""Accuracy measures and weighted averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.ordinals import with_running_sum

STEP_BLOCK = 65_536


def accuracy(predictions: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    return predictions.agg((F.avg(hit) * 100.0).alias("accuracy"))


def balanced_accuracy(predictions: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Mean recall over the classes present in the truth, in percent."""
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    recall = predictions.groupBy(truth).agg(F.avg(hit).alias("recall"))
    return recall.agg((F.avg("recall") * 100.0).alias("balanced_accuracy"))


def weighted_meter(values: DataFrame, name: str = "name", value: str = "val", weight: str = "n") -> DataFrame:
    return values.groupBy(name).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("avg"), F.sum(weight).alias("count")
    )


def running_weighted_meter(
    values: DataFrame, name: str = "name", step: str = "step", value: str = "val", weight: str = "n"
) -> DataFrame:
    """The meter after every step. Steps are integers, unique per name; a long series is cut into blocks."""
    sums = {"sum": F.col(value) * F.col(weight), "count": F.col(weight).cast("bigint")}
    summed = with_running_sum(values, [name], F.floor(F.col(step) / STEP_BLOCK), [step], sums)
    return summed.withColumn("avg", F.col("sum") / F.col("count"))
