"""Queries and SQL for scans of boxes, filters, joins and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.checks import fixtures as fx
from trapline.functions import names
from trapline.operators import curation
from trapline.operators.features import split_select
from trapline.plans.splits import splits_of
from trapline.sources.tables import union_splits


def whole(name: str):
    return F.col(name).cast("bigint").alias(name)


def near(column, name: str, places: int = 6):
    """Rounded by arithmetic that both engines do alike; their own `round` differ on ties."""
    scale = F.lit(10.0**places)
    return (F.floor(column * scale + F.lit(0.5)) / scale).alias(name)


def box_columns(bbox="bbox"):
    return [near(F.col(bbox)[i], n) for i, n in enumerate(("bx", "byy", "bw", "bh"))]


def ratio_boxes(spark, d):
    shares = F.transform("bbox", lambda v: v / 1000.0)
    return fx.annotations(spark, d).withColumn("bbox", shares)


def bbox_ratio_to_px(spark, d):
    px = curation.bbox_ratio_to_px(ratio_boxes(spark, d), fx.images(spark, d))
    return px.select("id", *box_columns(), near(F.col("area"), "area", 6))


def bbox_default(spark, d):
    return curation.bbox_default(fx.annotations(spark, d)).select("id", *box_columns(), near(F.col("area"), "area", 6))


SIDES = ("x1", "x2", "y1", "y2", "width", "height")


def bbox_truncate(spark, d):
    boxes = curation.bbox_truncate(curation.bbox_default(fx.annotations(spark, d)))
    return boxes.select("id", *[whole(c) for c in SIDES])


def join_boxes(spark, d):
    left = curation.bbox_truncate(curation.bbox_default(fx.annotations(spark, d)))
    return curation.join_boxes(left, fx.crops(spark, d)).select("id", "img_id", "img_name", "img_path", whole("area"))


def drop_unmatched(spark, d):
    return curation.drop_unmatched(join_boxes(spark, d)).select("id", "img_path")


def raw_images(spark, d):
    return (
        fx.images(spark, d).withColumnRenamed("img_width", "width").withColumnRenamed("img_height", "height")
    )


def union_of_splits(spark, d):
    rows = fx.crops(spark, d)
    folders = splits_of("cct20", "folders")
    parts = {f: rows.where(F.col("img_set") == f).select("img_name") for f in folders}
    united = union_splits(parts)
    return united.select("img_name", "img_set", F.concat("img_set", F.lit("/"), "img_name").alias("img_path"))


def split_roles(spark, d):
    rows = split_select(fx.crops(spark, d), splits_of("cct20", "pretrain"))
    return rows.select("img_path", "img_set")


_TRUNC = ", ".join(
    [
        "trunc(coalesce(bx, 0))::bigint as x1", "trunc(coalesce(bx, 0))::bigint + trunc(coalesce(bw, 0))::bigint as x2",
        "trunc(coalesce(byy, 0))::bigint as y1", "trunc(coalesce(byy, 0))::bigint + trunc(coalesce(bh, 0))::bigint as y2",
        "trunc(coalesce(bw, 0))::bigint as width", "trunc(coalesce(bh, 0))::bigint as height",
    ]
)
_MATCHED = f"""{fx.CROPS_SQL}, cut as (select id, image_id, {_TRUNC} from annotations),
matched as (select a.id, a.image_id as img_id, c.img_name, c.img_path, c.area
            from cut a left join crops c on a.image_id = c.img_id and a.x1 = c.x1 and a.y1 = c.y1
             and a.width = c.width and a.height = c.height)"""

def manifest_of_shares(spark, d):
    """Boxes as shares of the frame, back to pixels and cropped."""
    images = fx.images(spark, d)
    frames = images.select(F.col("id").alias("image_id"), "img_width", "img_height")
    w, h, b = F.col("img_width"), F.col("img_height"), F.col("bbox")
    shares = fx.annotations(spark, d).join(frames, "image_id", "left").withColumn(
        "bbox", F.when(b.isNotNull(), F.array(b[0] / w, b[1] / h, b[2] / w, b[3] / h))
    )
    rows = curation.manifest_of_shares(shares.drop("img_width", "img_height"), images, fx.categories(spark, d))
    return rows.select("ann_id", "img_id", whole("num_box"), "species", *[whole(c) for c in ("x1", "y1", "width", "height")])


CHECKS = {
    "bbox_ratio_to_px": (
        bbox_ratio_to_px,
        f"""{fx.CURATION_SQL}, px as (
          select a.id, coalesce(bx / 1000e0 * img_width, 0) as bx, coalesce(byy / 1000e0 * img_height, 0) as byy,
                 coalesce(bw / 1000e0 * img_width, 0) as bw, coalesce(bh / 1000e0 * img_height, 0) as bh
          from annotations a join images i on i.id = a.image_id)
        select id, floor((bx) * 1e6 + 0.5e0) / 1e6 as bx, floor((byy) * 1e6 + 0.5e0) / 1e6 as byy, floor((bw) * 1e6 + 0.5e0) / 1e6 as bw, floor((bh) * 1e6 + 0.5e0) / 1e6 as bh,
               floor((bw * bh) * 1e6 + 0.5e0) / 1e6 as area from px""",
    ),
    "bbox_default": (
        bbox_default,
        f"""{fx.CURATION_SQL}
        select id, floor((coalesce(bx, 0)) * 1e6 + 0.5e0) / 1e6 as bx, floor((coalesce(byy, 0)) * 1e6 + 0.5e0) / 1e6 as byy,
               floor((coalesce(bw, 0)) * 1e6 + 0.5e0) / 1e6 as bw, floor((coalesce(bh, 0)) * 1e6 + 0.5e0) / 1e6 as bh,
               floor((coalesce(bw * bh, 0)) * 1e6 + 0.5e0) / 1e6 as area from annotations""",
    ),
    "bbox_truncate": (bbox_truncate, f"{fx.CURATION_SQL} select id, {_TRUNC} from annotations"),
    "filter_has_box": (
        lambda s, d: curation.filter_has_box(fx.annotations(s, d)).select("id", "image_id"),
        f"{fx.CURATION_SQL} select id, image_id from annotations where has_box",
    ),
    "filter_min_area": (
        lambda s, d: curation.filter_min_area(curation.filter_has_box(fx.annotations(s, d))).select(
            "id", near(F.col("area"), "area", 6)
        ),
        f"""{fx.CURATION_SQL} select id, floor((coalesce(area, bw * bh)) * 1e6 + 0.5e0) / 1e6 as area from annotations
        where has_box and coalesce(area, bw * bh) >= 4096""",
    ),
    "prune_annotations": (
        lambda s, d: curation.prune_annotations(fx.annotations(s, d), fx.images(s, d)).select("id", "image_id"),
        f"{fx.CURATION_SQL} select id, image_id from annotations where image_id in (select id from images)",
    ),
    "prune_images": (
        lambda s, d: curation.prune_images(fx.images(s, d), curation.curated(fx.annotations(s, d))).select("id"),
        f"{fx.CROPS_SQL} select id from images where id in (select image_id from kept)",
    ),
    "curation_report": (
        lambda s, d: curation.curation_report(fx.annotations(s, d), fx.images(s, d)).select(
            "stage", whole("images"), whole("annotations")
        ),
        f"""{fx.CROPS_SQL}, there as (select a.* from annotations a semi join images i on i.id = a.image_id)
        select 'total' as stage, (select count(*) from images) as images, (select count(*) from annotations) as annotations
        union all select 'has_box', count(distinct image_id), count(*) from there where has_box
        union all select 'min_area', count(distinct image_id), count(*) from there
                  where has_box and coalesce(area, bw * bh) >= 4096""",
    ),
    "parse_image_id": (
        lambda s, d: fx.crops(s, d).select("img_path", names.parse_image_id(F.col("img_name")).alias("img_id")),
        f"{fx.CROPS_SQL} select img_path, split_part(img_name, '_', 1) as img_id from crops",
    ),
    "parse_species": (
        lambda s, d: fx.crops(s, d).select("img_path", names.parse_species(F.col("img_name")).alias("species")),
        f"{fx.CROPS_SQL} select img_path, species from crops",
    ),
    "manifest_cast_area": (
        lambda s, d: curation.manifest_cast_area(
            fx.crops(s, d).withColumns({c: F.col(c).cast("double") + 0.9 for c in SIDES})
        ).select("img_path", *[whole(c) for c in SIDES], whole("area")),
        f"""{fx.CROPS_SQL} select img_path, x1::bigint as x1, x2::bigint as x2, y1::bigint as y1, y2::bigint as y2,
        width::bigint as width, height::bigint as height, area::bigint as area from crops""",
    ),
    "normalize_columns": (
        lambda s, d: curation.normalize_columns(raw_images(s, d)).select(
            "id", "file_name", "location", "datetime", whole("img_width"), whole("img_height")
        ),
        f"""{fx.CURATION_SQL} select id, file_name, location, datetime, img_width::bigint as img_width,
        img_height::bigint as img_height from images""",
    ),
    "drop_unmatched": (
        drop_unmatched, f"{_MATCHED} select id, img_path from matched where img_name is not null",
    ),
    "split_select": (
        split_roles,
        f"""{fx.CROPS_SQL} select img_path, img_set from crops
        where img_set in ('train_images', 'trans_val_images', 'cis_val_images')""",
    ),
    "join_boxes": (
        join_boxes, f"{_MATCHED} select id, img_id, img_name, img_path, area::bigint as area from matched",
    ),
    "join_images": (
        lambda s, d: curation.join_images(fx.annotations(s, d), fx.images(s, d)).select(
            "id", "image_id", "file_name", "location", "datetime"
        ),
        f"""{fx.CURATION_SQL} select a.id, a.image_id, i.file_name, i.location, i.datetime
        from annotations a left join images i on i.id = a.image_id""",
    ),
    "category_lookup": (
        lambda s, d: curation.category_lookup(fx.annotations(s, d), fx.categories(s, d)).select("id", "species"),
        f"{fx.CURATION_SQL} select a.id, c.name as species from annotations a join categories c on c.id = a.category_id",
    ),
    "crop_ordinal": (
        lambda s, d: curation.crop_ordinal(curation.curated(fx.annotations(s, d))).select("id", "image_id", whole("num_box")),
        f"""{fx.CROPS_SQL} select id, image_id, row_number() over (partition by image_id order by id) - 1 as num_box
        from kept""",
    ),
    "crop_manifest": (
        lambda s, d: fx.manifest(s, d).select(
            "ann_id", "img_id", "img_name", "img_path", "img_set", *[whole(c) for c in SIDES], whole("area"), "crop_is_empty"
        ),
        f"""{fx.CROPS_SQL} select ann_id, img_id, img_name, img_path, img_set, x1::bigint as x1, x2::bigint as x2,
        y1::bigint as y1, y2::bigint as y2, width::bigint as width, height::bigint as height, area::bigint as area,
        least(x2, img_width) <= x1 or least(y2, img_height) <= y1 as crop_is_empty from crops""",
    ),
    "manifest_of_shares": (
        manifest_of_shares,
        f"""{fx.CURATION_SQL}, shares as (
          select a.*, i.img_width, i.img_height, bx / img_width as rx, byy / img_height as ry, bw / img_width as rw, bh / img_height as rh
          from annotations a join images i on i.id = a.image_id where has_box),
        px as (select *, rx * img_width as px, ry * img_height as py, rw * img_width as pw, rh * img_height as ph from shares),
        numbered as (select *, row_number() over (partition by image_id order by id) - 1 as num_box from px where pw * ph >= 4096)
        select n.id as ann_id, image_id as img_id, num_box, c.name as species, trunc(px)::bigint as x1, trunc(py)::bigint as y1,
               trunc(pw)::bigint as width, trunc(ph)::bigint as height
        from numbered n join categories c on c.id = n.category_id""",
    ),
    "intersect_ids": (
        lambda s, d: curation.intersect_ids(
            fx.images(s, d), fx.annotations(s, d).withColumn("id", F.col("image_id")), "id"
        ),
        f"{fx.CURATION_SQL} select id from images intersect select image_id as id from annotations",
    ),
    "union_splits": (
        union_of_splits, f"{fx.CROPS_SQL} select img_name, img_set, img_path from crops",
    ),
}
