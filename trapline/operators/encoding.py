"""Dense integer codes for labels, locations and rows. Codes come from the whole table: encode
first, select splits afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.ordinals import with_sorted_ordinal

DETECTOR_CLASSES = 20


def label_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Sorted distinct values -> 0..C-1. Only the distinct values are numbered."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return with_sorted_ordinal(values, [column], code)


def label_encode(df: DataFrame, column: str, code: str) -> DataFrame:
    return df.join(label_codes(df, column, code), column, "left")


def joint_label_encode(train: DataFrame, test: DataFrame, column: str, code: str) -> tuple[DataFrame, DataFrame]:
    """Codes over the labels of a training subset and the test rows together."""
    codes = label_codes(train.select(column).unionByName(test.select(column)), column, code)
    return train.join(codes, column, "left"), test.join(codes, column, "left")


def location_encode(df: DataFrame, column: str = "location", code: str = "loc_id") -> DataFrame:
    return label_encode(df, column, code)


def num_classes(df: DataFrame, column: str = "category_id", from_detector: bool = False) -> DataFrame:
    """Distinct classes of the whole table; boxes made by a detector have a fixed number instead."""
    count = F.lit(DETECTOR_CLASSES).cast("bigint") if from_detector else F.countDistinct(column)
    return df.agg(count.alias("num_classes"))


def row_ids(df: DataFrame, key: list[str], name: str = "im_id") -> DataFrame:
    """Dense row number over the whole table in key order."""
    return with_sorted_ordinal(df, key, name)
