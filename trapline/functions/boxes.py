"""Box columns. A box is `array<double>` [x, y, w, h]; an absent one is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_AREA = 4096.0  # default threshold, 64 x 64 px


def ratio_to_px(bbox: Column, img_width: Column, img_height: Column) -> Column:
    return F.array(bbox[0] * img_width, bbox[1] * img_height, bbox[2] * img_width, bbox[3] * img_height)


def or_zero_box(bbox: Column) -> Column:
    return F.coalesce(bbox, F.array(*[F.lit(0.0)] * 4))


def box_area(bbox: Column) -> Column:
    return bbox[2] * bbox[3]


def is_malformed(bbox: Column) -> Column:
    """A box that is present but is not four numbers."""
    # Null for a box with a null in it. A lambda would be interpreted row by row, and the filter around it with it.
    not_a_number = F.array_contains(bbox, F.lit(math.nan))
    return bbox.isNotNull() & ((F.size(bbox) != 4) | F.coalesce(not_a_number, F.lit(True)))


def truncated(bbox: Column) -> dict[str, Column]:
    """Integer corners, toward zero; the far corner is computed after truncation."""
    x1, y1, w, h = (bbox[i].cast("int") for i in range(4))
    return {"x1": x1, "x2": x1 + w, "y1": y1, "y2": y1 + h, "width": w, "height": h}


def _slice_bound(v: Column, length: Column) -> Column:
    return F.when(v < 0, F.greatest(v + length, F.lit(0))).otherwise(F.least(v, length))


def slice_is_empty(x1: Column, x2: Column, y1: Column, y2: Column, width: Column, height: Column) -> Column:
    """True when the pixel slice [y1:y2, x1:x2] of the image holds nothing."""
    return (_slice_bound(x2, width) <= _slice_bound(x1, width)) | (
        _slice_bound(y2, height) <= _slice_bound(y1, height)
    )


def normalized(x1, y1, w, h, img_width, img_height) -> dict[str, Column]:
    """Size and centre as shares of the image, and the area ratio. A zero-sized image gives null."""
    full_w = F.nullif(img_width, F.lit(0)).cast("double")
    full_h = F.nullif(img_height, F.lit(0)).cast("double")
    rel_w, rel_h = w / full_w, h / full_h
    return {
        "rel_width": rel_w,
        "rel_height": rel_h,
        "center_x": x1 / full_w + rel_w / 2,
        "center_y": y1 / full_h + rel_h / 2,
        "area_ratio": (w.cast("double") * h) / (full_w * full_h),
    }
