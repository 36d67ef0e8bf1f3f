"""Image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_images(spark: SparkSession, path: str | list[str], rgb: bool = False) -> DataFrame:
    """Decoded pictures with their file name; unreadable files are left out.

    The bytes of coloured pictures are in BGR order, or with `rgb` in RGB order; a fourth channel stays last.
    """
    pictures = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    named = pictures.withColumn("file_name", F.element_at(F.split("origin", "/"), -1)).drop("origin")
    return named.withColumn("data", swapped_channels(F.col("data"), F.col("nChannels"))) if rgb else named


def swapped_channels(data: Column, channels: Column) -> Column:
    """BGR to RGB and back."""
    digits = F.hex(data)
    three = F.unhex(F.regexp_replace(digits, "(..)(..)(..)", "$3$2$1"))
    four = F.unhex(F.regexp_replace(digits, "(..)(..)(..)(..)", "$3$2$1$4"))
    return F.when(channels == 3, three).when(channels == 4, four).otherwise(data)

