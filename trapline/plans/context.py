"""The context table: one row per crop with capture time, burst, counts and sample flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.capture_time import time_of_day
from trapline.operators import bursts, sampling
from trapline.session import cut


def crops_with_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest rows with file, location, capture time and frame size of their image.

    A manifest made by `crop_manifest` has all of them and is not joined again.
    """
    wanted = ["file_name", "location", "datetime", "img_width", "img_height"]
    if not set(wanted) <= set(manifest.columns):
        frames = images.select(F.col("id").alias("img_id"), *wanted)
        manifest = manifest.drop(*wanted).join(frames, "img_id")
    return manifest.withColumn("time", time_of_day(F.col("datetime")))


def context_table(
    crops: DataFrame, gap_seconds: float = bursts.GAP_SECONDS, seed: int = sampling.SAMPLE_SEED,
    rates: dict[str, float] = sampling.RATES, train_sets=sampling.TRAIN_SETS,
) -> DataFrame:
    """`crops` has a `species`; see `crops_with_images`.

    A crop whose burst is longer than one list part has a row per part; `list_part = 0` gives every crop once.
    The crops, their images and the bursts (narrow rows, one per image) feed several branches, so they are written out once.
    """
    crops = cut(crops)
    counts = bursts.boxes_per_image(crops)
    neighbours = bursts.burst_neighbours(bursts.counted_images(crops, counts), gap_seconds)
    sizes = cut(bursts.with_burst_sizes(neighbours, counts))
    flagged = sampling.stratified_sample(crops, rates, seed, train_sets)
    return bursts.attach_burst(flagged, sizes, bursts.burst_lists(sizes, crops))
