"""Crop file names: `{image}_{number}_{species}.jpg`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_name(image_id: Column, number: Column, species: Column) -> Column:
    return F.concat(image_id, F.lit("_"), number.cast("string"), F.lit("_"), species, F.lit(".jpg"))


def parse_image_id(img_name: Column) -> Column:
    """Everything before the first underscore. Only for imported names: own tables carry the id."""
    return F.split(img_name, "_")[0]


def parse_species(img_name: Column) -> Column:
    """Everything after the second underscore, without any `.jpg`."""
    parts = F.split(img_name, "_")
    tail = F.when(F.size(parts) > 2, F.slice(parts, F.lit(3), F.size(parts))).otherwise(
        F.array().cast("array<string>")
    )
    return F.replace(F.array_join(tail, "_"), F.lit(".jpg"), F.lit(""))
