"""Context vectors: cyclic time, normalized boxes and location.

Computed on the whole table, before any split is selected. The location part stays sparse (`loc_id`);
`location_one_hot` makes it dense on demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import boxes
from trapline.functions.capture_time import cyclic_encode, time_shares
from trapline.operators.encoding import location_encode

# Weights of year, day, hour, minute and second (two entries each but for the year).
TIME_SCALES = [100.0] + [10.0] * 2 + [1.0] * 2 + [0.1] * 2 + [0.01] * 2


def bbox_normalize(rows: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("x1", "y1", "width", "height", "img_width", "img_height")]
    return rows.withColumns(boxes.normalized(*parts))


def multi_box_flag(count: Column) -> Column:
    return (count > 1).cast("double")


def year_scale(rows: DataFrame, column: str = "datetime", name: str = "year_scaled") -> DataFrame:
    """Year scaled to [0, 1] by the extremes of the whole table; 0 if there is only one year."""
    year = F.year(F.col(column))
    first, last = F.year(F.min(column)), F.year(F.max(column))
    ends = rows.agg(F.struct(first.alias("lo"), last.alias("hi"))).scalar()
    span = ends["hi"] - ends["lo"]
    return rows.withColumn(name, F.when(span == 0, F.lit(0.0)).otherwise((year - ends["lo"]) / span))


def time_normalize(rows: DataFrame, column: str = "datetime") -> DataFrame:
    return rows.withColumns(time_shares(F.col(column)))


def hour_of_day(column: Column) -> Column:
    return F.hour(column)


def context_features(rows: DataFrame) -> DataFrame:
    """Adds `con_time` (9), `con_time_scaled` (9), `con_bbox` (5), `loc_id` and `hour`."""
    base = location_encode(bbox_normalize(time_normalize(year_scale(rows))))
    cyclic = [part for s in ("day", "hour", "minute", "second") for part in cyclic_encode(F.col(f"{s}_share"))]
    times = [F.col("year_scaled"), *cyclic]
    return base.withColumns(
        {
            "con_time": F.array(*times),
            "con_time_scaled": F.array(*[t * F.lit(s) for t, s in zip(times, TIME_SCALES)]),
            "con_bbox": F.array(
                "center_x", "center_y", "rel_width", "rel_height", multi_box_flag(F.col("boxes_per_img_id"))
            ),
            "hour": hour_of_day(F.col("datetime")),
        }
    )


def location_one_hot(loc_id: Column, n_locations: Column) -> Column:
    """Dense indicator of `n_locations` entries."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    return F.concat(zeros(loc_id), F.array(F.lit(1.0)), zeros(n_locations - loc_id - 1))


def context_standard(features: DataFrame, dense: bool = False) -> DataFrame:
    """`con_time` followed by the location indicator: sparse as a struct, or one dense array."""
    sparse = F.struct(F.col("con_time").alias("time"), F.col("loc_id"))
    if not dense:
        return features.withColumn("con_standard", sparse)
    size = features.agg(F.max("loc_id") + 1).scalar()
    return features.withColumn(
        "con_standard", F.concat("con_time", location_one_hot(F.col("loc_id"), size))
    )


def split_select(rows: DataFrame, splits) -> DataFrame:
    return rows.where(F.col("img_set").isin(*splits))
