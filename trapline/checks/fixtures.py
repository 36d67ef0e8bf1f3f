"""Collection tables derived from the given parquet tables, in Spark and (for the checks) in SQL.

`events` plays images, `lineitem` annotations, `nation` categories, `embeddings` features. Every row of
the given tables is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.hashing import digest
from trapline.operators import bursts, curation, sampling
from trapline.plans.context import crops_with_images
from trapline.session import configure, cut

BATCH = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    last = n % 10
    split = (
        F.when(last == 0, "cis_test_images").when(last == 1, "trans_test_images")
        .when(last == 2, "cis_val_images").when(last == 3, "trans_val_images").otherwise("train_images")
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("img"), n).alias("id"),
        F.concat(F.lit("f"), n, F.lit(".jpg")).alias("file_name"),
        F.concat("event_type", F.lit("-"), F.col("user_id") % 4).alias("location"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("datetime"),
        (F.lit(640) + 64 * (n % 3)).cast("int").alias("img_width"),
        F.lit(480).alias("img_height"),
        split.alias("img_set"),
    )


IMAGES_SQL = """
images as (
  select concat('img', event_id::varchar) as id, concat('f', event_id::varchar, '.jpg') as file_name,
         concat(event_type, '-', (user_id % 4)::varchar) as location,
         date_trunc('second', ts)::timestamp as datetime,
         (640 + 64 * (event_id % 3))::int as img_width, 480 as img_height,
         case event_id % 10 when 0 then 'cis_test_images' when 1 then 'trans_test_images'
              when 2 then 'cis_val_images' when 3 then 'trans_val_images' else 'train_images' end as img_set
  from events)"""


ANNOTATION_SOURCE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_extendedprice", "l_discount")


def annotation_columns() -> list[Column]:
    """Columns of an annotation, made of ANNOTATION_SOURCE."""
    bbox = F.array(
        F.col("l_quantity") * 4.5, F.col("l_tax") * 1000.0 + 0.75,
        F.col("l_extendedprice") / 700.0, F.lit(20.0) + F.col("l_discount") * 1000.0,
    )
    return [
        digest(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("id"),
        F.concat(F.lit("img"), F.col("l_orderkey")).alias("image_id"),
        (F.col("l_partkey") % 25).alias("category_id"),
        F.when(F.col("l_linenumber") != 7, bbox).alias("bbox"),
        F.when(F.col("l_linenumber") <= 2, bbox[2] * bbox[3] * 0.9).alias("area"),
    ]


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No box on the 7th line, a given area on the first two; some image ids do not exist, on purpose."""
    return table(spark, sf_dir, "lineitem").select(*annotation_columns())


ANNOTATIONS_SQL = """
annotations as (
  select md5(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar)) as id,
         concat('img', l_orderkey::varchar) as image_id, l_partkey % 25 as category_id, l_linenumber <> 7 as has_box,
         case when l_linenumber <> 7 then l_quantity * 4.5e0 end as bx,
         case when l_linenumber <> 7 then l_tax * 1000e0 + 0.75e0 end as byy,
         case when l_linenumber <> 7 then l_extendedprice / 700e0 end as bw,
         case when l_linenumber <> 7 then 20e0 + l_discount * 1000e0 end as bh,
         case when l_linenumber <= 2 then (l_extendedprice / 700e0) * (20e0 + l_discount * 1000e0) * 0.9e0 end as area
  from lineitem)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names contain `_`, which exercises species parsing."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("name"),
    )


CATEGORIES_SQL = """
categories as (select n_nationkey as id, lower(replace(n_name, ' ', '_')) as name from nation)"""

BOXES_SQL = """
kept as (select * from annotations where has_box and coalesce(area, bw * bh) >= 4096),
crops as (
  select k.id as ann_id, k.image_id as img_id, k.category_id, num_box, c.name as species,
         concat(k.image_id, '_', num_box::varchar, '_', c.name, '.jpg') as img_name,
         concat(i.img_set, '/', k.image_id, '_', num_box::varchar, '_', c.name, '.jpg') as img_path,
         trunc(bx)::int as x1, trunc(bx)::int + trunc(bw)::int as x2, trunc(byy)::int as y1,
         trunc(byy)::int + trunc(bh)::int as y2, trunc(bw)::int as width, trunc(bh)::int as height,
         trunc(bw)::bigint * trunc(bh)::bigint as area,
         i.img_set, i.file_name, i.location, i.datetime, i.img_width, i.img_height
  from (select *, row_number() over (partition by image_id order by id) - 1 as num_box from kept) k
  join images i on i.id = k.image_id join categories c on c.id = k.category_id)"""

CROPS_SQL = f"with {IMAGES_SQL}, {ANNOTATIONS_SQL}, {CATEGORIES_SQL}, {BOXES_SQL}"
CURATION_SQL = f"with {IMAGES_SQL}, {ANNOTATIONS_SQL}, {CATEGORIES_SQL}"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.crop_manifest(
        annotations(spark, sf_dir), images(spark, sf_dir), categories(spark, sf_dir)
    )


def crops_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with their image and species."""
    return crops_with_images(manifest(spark, sf_dir), images(spark, sf_dir))


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[..., DataFrame]) -> DataFrame:
    """A table that later steps read from storage; built from the whole given tables on first use."""
    where = (spark.sparkContext.applicationId, sf_dir, name)
    if where not in _stored:
        _stored[where] = cut(build(spark, sf_dir))
    return _stored[where]


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest that curation has written."""
    return stored(spark, sf_dir, "crops", crops_of)


def counted_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops with the number of crops of their image."""
    return stored(
        spark, sf_dir, "counted",
        lambda s, d: bursts.attach_box_count(crops(s, d), bursts.boxes_per_image(crops(s, d))),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the location and capture time of the event of the same number."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        shots = images(spark, sf_dir).select(F.col("id").alias("img_id"), "location", "datetime")
        vectors = table(spark, sf_dir, "embeddings").withColumn("img_id", F.concat(F.lit("img"), "vec_id"))
        return vectors.join(shots, "img_id").drop("img_id")

    return stored(spark, sf_dir, "items", build)


ITEMS_SQL = f"""with {IMAGES_SQL},
items as (select e.*, i.location, i.datetime from embeddings e join images i on i.id = concat('img', e.vec_id::varchar))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding pairs in batches: the second view mixes a vector with its own reverse."""
    x1 = F.col("embedding").cast("array<double>")
    x2 = F.zip_with(x1, F.reverse(x1), lambda a, b: F.lit(0.8) * a + F.lit(0.2) * b)
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / BATCH).alias("batch_id"), (F.col("vec_id") % BATCH).alias("pos"),
        x1.alias("x1"), x2.alias("x2"),
    )


PAIRS_SQL = f"""with pairs as (
  select vec_id // {BATCH} as batch_id, vec_id % {BATCH} as pos, embedding::double[] as x1,
         list_transform(range(1, 65), lambda k: 0.8e0 * embedding[k]::double + 0.2e0 * embedding[65 - k]::double) as x2
  from embeddings)"""


def draw_sql(*parts: str) -> str:
    """SQL of `hashing.unit_draw`; parts are SQL expressions of type varchar."""
    text = f"md5(concat_ws('|', {', '.join(parts)}))"
    return f"((('0x' || substr({text}, 1, 13))::bigint)::double + 0.5e0) / {16**13}::double"


SEED = sampling.SAMPLE_SEED
