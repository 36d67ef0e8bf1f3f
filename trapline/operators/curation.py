"""From annotation tables to the boxes worth cropping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions import boxes, names
from trapline.operators.ordinals import with_ordinal_by_range


def bbox_ratio_to_px(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes given as shares of the image -> pixels, with area; an absent box becomes the zero box."""
    sizes = images.select(F.col("id").alias("image_id"), "img_width", "img_height")
    px = boxes.ratio_to_px(F.col("bbox"), F.col("img_width"), F.col("img_height"))
    scaled = annotations.join(sizes, "image_id").withColumn("bbox", F.when(F.col("bbox").isNotNull(), px))
    return bbox_default(scaled).drop("img_width", "img_height")


def bbox_default(annotations: DataFrame) -> DataFrame:
    """No box -> zero box and area 0; otherwise the area is that of the box."""
    return annotations.withColumn("bbox", boxes.or_zero_box(F.col("bbox"))).withColumn(
        "area", boxes.box_area(F.col("bbox"))
    )


def bbox_truncate(annotations: DataFrame) -> DataFrame:
    return annotations.withColumns(boxes.truncated(F.col("bbox")))


def filter_has_box(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.col("bbox").isNotNull())


def malformed_boxes(annotations: DataFrame) -> DataFrame:
    """Boxes with missing or non-numeric parts, set apart instead of cropped."""
    return annotations.where(boxes.is_malformed(F.col("bbox")))


def with_area(annotations: DataFrame) -> DataFrame:
    return annotations.withColumn("area", F.coalesce(F.col("area"), boxes.box_area(F.col("bbox"))))


def filter_min_area(annotations: DataFrame, threshold: float = boxes.MIN_AREA) -> DataFrame:
    return with_area(annotations).where(F.col("area") >= F.lit(float(threshold)))


def prune_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations whose image is there."""
    kept = images.select(F.col("id").alias("image_id"))
    return annotations.join(kept, "image_id", "left_semi")


def prune_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with at least one of the annotations."""
    used = annotations.select(F.col("image_id").alias("id"))
    return images.join(used, "id", "left_semi")


def intersect_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def is_curated(threshold: float = boxes.MIN_AREA) -> Column:
    """A well-formed box of at least `threshold` px."""
    bbox = F.col("bbox")
    area = F.coalesce("area", boxes.box_area(bbox))
    return bbox.isNotNull() & ~boxes.is_malformed(bbox) & (area >= F.lit(float(threshold)))


def curated(annotations: DataFrame, threshold: float = boxes.MIN_AREA) -> DataFrame:
    return annotations.where(is_curated(threshold))


def curation_report(annotations: DataFrame, images: DataFrame, threshold: float = boxes.MIN_AREA) -> DataFrame:
    """Image and annotation counts in total and after each filter: two scans, one shuffle on image id."""
    big = is_curated(threshold)
    per_image = prune_annotations(
        annotations.groupBy("image_id").agg(
            F.count_if(F.col("bbox").isNotNull()).alias("boxed"), F.count_if(big).alias("big")
        ),
        images,
    )
    after = per_image.agg(
        F.count_if(F.col("boxed") > 0).alias("boxed_images"),
        F.coalesce(F.sum("boxed"), F.lit(0)).alias("boxed_annotations"),
        F.count_if(F.col("big") > 0).alias("big_images"),
        F.coalesce(F.sum("big"), F.lit(0)).alias("big_annotations"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("has_box").alias("stage"), F.col("boxed_images").alias("images"),
                         F.col("boxed_annotations").alias("annotations")),
                F.struct(F.lit("min_area").alias("stage"), F.col("big_images").alias("images"),
                         F.col("big_annotations").alias("annotations")),
            )
        )
    )
    total = images.agg(F.count("*").alias("images")).select(
        F.lit("total").alias("stage"), "images",
        annotations.agg(F.count("*")).scalar().alias("annotations"),
    )
    return total.unionByName(after)


def crop_ordinal(annotations: DataFrame) -> DataFrame:
    """0-based crop number inside each image, in annotation-id order. A crowded image is cut into ranges of ids."""
    return with_ordinal_by_range(annotations, ["image_id"], ["id"], "num_box")


def category_lookup(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds `species`. The category table is a file: Catalyst broadcasts it by its real size."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("species"))
    return annotations.drop("species").join(named, "category_id")


def category_misses(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations whose category is unknown, set apart."""
    known = categories.select(F.col("id").alias("category_id"))
    return annotations.join(known, "category_id", "left_anti")


def join_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    return annotations.join(images.withColumnRenamed("id", "image_id"), "image_id", "left")


def normalize_columns(images: DataFrame) -> DataFrame:
    """Image sizes get their own names, so that they cannot meet the box sizes in a join."""
    return images.select(
        "id", "file_name", "location", "datetime",
        F.col("width").alias("img_width"), F.col("height").alias("img_height"),
        *[c for c in ("img_set",) if c in images.columns],
    )


def crop_manifest(
    annotations: DataFrame, images: DataFrame, categories: DataFrame, threshold: float = boxes.MIN_AREA
) -> DataFrame:
    """One row per crop, named `{image}_{number}_{species}.jpg`.

    Carries the annotation, image and category ids, so later steps need not parse names or match boxes, and all that
    later steps want from image and category, so they need not be joined again.
    """
    sides = [f"_box_{i}" for i in range(4)]  # moved as numbers, which are narrower than an array
    box = [F.col("bbox")[i].alias(name) for i, name in enumerate(sides)]
    kept = curated(annotations, threshold).select("id", "image_id", "category_id", *box)
    numbered = crop_ordinal(kept)
    also = [c for c in ("file_name", "location", "datetime") if c in images.columns]
    frames = images.select(F.col("id").alias("image_id"), "img_set", "img_width", "img_height", *also)
    crops = category_lookup(numbered.join(frames, "image_id"), categories)
    name = names.crop_name(F.col("image_id"), F.col("num_box"), F.col("species"))
    placed = crops.withColumn("img_name", name).withColumns(boxes.truncated(F.array(*sides)))
    return placed.select(
        F.col("id").alias("ann_id"), F.col("image_id").alias("img_id"), "category_id", "num_box", "img_name",
        "x1", "x2", "y1", "y2", "width", "height",
        F.concat("img_set", F.lit("/"), "img_name").alias("img_path"), "img_set",
        (F.col("width").cast("bigint") * F.col("height")).alias("area"),
        boxes.slice_is_empty(
            F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), F.col("img_width"), F.col("img_height")
        ).alias("crop_is_empty"),
        "species", *also, "img_width", "img_height",
    )


def manifest_of_shares(
    annotations: DataFrame, images: DataFrame, categories: DataFrame, threshold: float = boxes.MIN_AREA
) -> DataFrame:
    """The crop manifest of a collection whose boxes are shares of the image: pixels first, then the minimum area.

    An absent box is the zero box, which no positive threshold keeps; a given area is replaced by that of the pixels.
    """
    return crop_manifest(bbox_ratio_to_px(annotations, images), images, categories, threshold)


def manifest_cast_area(manifest: DataFrame) -> DataFrame:
    sizes = {c: F.col(c).cast("int") for c in ("x1", "x2", "y1", "y2", "width", "height")}
    return manifest.withColumns(sizes).withColumn("area", F.col("width").cast("bigint") * F.col("height"))


def join_boxes(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Annotations matched to imported crops by image and integer box; equal boxes fan out.

    `annotations` has integer boxes (`bbox_truncate`); unmatched ones keep nulls.
    """
    left = annotations.drop("x2", "y2", "area").withColumnRenamed("image_id", "img_id")
    right = manifest.select(
        "img_id", "x1", "y1", "width", "height", "x2", "y2", "img_name", "img_path", "img_set", "area"
    )
    return left.join(right, ["img_id", "x1", "y1", "width", "height"], "left")


def drop_unmatched(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["img_name"])
