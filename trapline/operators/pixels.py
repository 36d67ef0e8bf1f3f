"""Pixels of every crop, as image structs (`height, width, nChannels, mode, data`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.boxes import _slice_bound
from trapline.functions.hashing import digest
from trapline.operators.ordinals import hex_bucket, with_ordinal
from trapline.session import cut

BOXES_PER_ROW = 64
LISTS_PER_PART = 1_024  # of one picture that a task gets together
TASK_BYTES = 64 << 20  # of pixels of a task, about
BYTES = "ISO-8859-1"  # one character per byte, so joining strings joins bytes


def _cut_out(box: Column) -> Column:
    """data[y1:y2, x1:x2], row by row of the picture; an empty slice gives a 0 x 0 picture."""
    x1, x2 = _slice_bound(box["x1"], F.col("width")), _slice_bound(box["x2"], F.col("width"))
    y1, y2 = _slice_bound(box["y1"], F.col("height")), _slice_bound(box["y2"], F.col("height"))
    empty = (x2 <= x1) | (y2 <= y1)
    line = lambda y: F.decode(
        F.substring(F.col("data"), (y * F.col("width") + x1) * F.col("nChannels") + 1, (x2 - x1) * F.col("nChannels")),
        BYTES,
    )
    lines = F.transform(F.sequence(y1, F.greatest(y2 - 1, y1)), line)
    return F.struct(
        box["img_path"].alias("img_path"),
        F.when(empty, 0).otherwise(y2 - y1).alias("height"),
        F.when(empty, 0).otherwise(x2 - x1).alias("width"),
        F.col("nChannels").alias("nChannels"),
        F.col("mode").alias("mode"),
        F.when(empty, F.lit(b"")).otherwise(F.encode(F.array_join(lines, ""), BYTES)).alias("data"),
    )


def _dealt(images: DataFrame, lists: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a share number `_part`, dealt to tasks of about TASK_BYTES of pixels.

    Shuffled pixels can be much smaller than they are in a task, so the size of a shuffle does not tell how many tasks
    they need. Tables that are small for the machines at hand are left to adaptive execution.
    """
    whole = images.join(crowded, "img_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))))).drop("_last")
    shares = lists.withColumn("_part", F.floor(F.col("list_no") / LISTS_PER_PART).cast("int"))
    size = F.col("height").cast("bigint") * F.col("width") * F.col("nChannels")
    tasks = -(-images.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // TASK_BYTES)
    if tasks <= images.sparkSession.sparkContext.defaultParallelism:
        return whole, shares
    return tuple(side.repartition(tasks, "img_id", "_part") for side in (whole, shares))


def crop_pixels(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """`images`: (img_id, height, width, nChannels, mode, data), as Spark's image source reads them.

    Boxes travel in lists of at most 64, so a picture is shuffled once, and once more per LISTS_PER_PART lists of it.
    All byte work is done by built-in functions.
    """
    boxes = manifest.select("img_id", "img_path", "x1", "x2", "y1", "y2")
    placed = with_ordinal(boxes.withColumn("_h", digest(F.col("img_path"))), ["img_id"], hex_bucket(F.col("_h")), ["_h", "img_path"], "_at")
    lists = placed.groupBy("img_id", F.floor(F.col("_at") / BOXES_PER_ROW).alias("list_no")).agg(
        F.collect_list(F.struct("img_path", "x1", "x2", "y1", "y2")).alias("boxes")
    )
    share = BOXES_PER_ROW * LISTS_PER_PART
    sizes = boxes.groupBy("img_id").agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    crowded = cut(sizes.select("img_id", F.floor((F.col("_n") - 1) / share).cast("int").alias("_last")))
    whole, shares = _dealt(images, lists, crowded)
    return shares.join(whole, ["img_id", "_part"]).select("img_id", F.inline(F.transform("boxes", _cut_out)))
