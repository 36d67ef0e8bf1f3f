"""One key holds a third of all rows: results stay whole and equal a plain computation."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.functions.hashing import digest
from trapline.operators import bursts, curation, draws, ordinals, positives, sampling

N = 9000


@pytest.fixture(scope="module")
def crops(spark):
    """A third of the crops lie in one image, one location, one species and one instant."""
    hot = F.col("id") % 3 == 0
    n = F.col("id").cast("string")
    table = spark.range(N).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("i"), F.floor(F.col("id") / 4).cast("string"))).alias("img_id"),
        F.concat(F.lit("p"), n).alias("img_path"), F.concat(F.lit("p"), n).alias("img_name"),
        F.when(hot, "x").otherwise(F.concat(F.lit("l"), F.floor(F.col("id") / 4) % 5)).alias("location"),
        F.when(hot, F.lit(0)).otherwise(F.floor(F.col("id") / 4) % 7200).alias("s"),
        F.when(hot, "fox").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("species"),
        F.concat(F.lit("f"), n).alias("file_name"), F.lit("train").alias("img_set"),
    )
    start = F.lit("2020-01-01 10:00:00").cast("timestamp_ntz")
    return table.withColumn("datetime", start + F.make_dt_interval(secs=F.col("s"))).drop("s").cache()


def test_crop_numbers(spark, monkeypatch):
    rows = spark.range(N).select(
        F.md5(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 900).cast("string")).alias("image_id")
    )
    plain = rows.withColumn("want", F.row_number().over(W.partitionBy("image_id").orderBy("id")) - 1)
    for most in (ordinals.PLAIN_ROWS, 100):
        monkeypatch.setattr(ordinals, "PLAIN_ROWS", most)
        found = curation.crop_ordinal(rows).join(plain, ["id", "image_id"])
        assert found.count() == N and found.where("num_box <> want").count() == 0


def test_ranges_cut_a_crowded_image(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "PLAIN_ROWS", 100)
    rows = spark.range(N).select(F.concat(F.lit("same-"), F.lpad("id", 9, "0")).alias("id"), F.lit("hot").alias("image_id"))
    ranged = rows.repartitionByRange(8, "image_id", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) > 1 and max(r["count"] for r in ranged) < N / 2
    found = curation.crop_ordinal(rows).agg(F.min("num_box"), F.max("num_box"), F.countDistinct("num_box")).first()
    assert tuple(found) == (0, N - 1, N)


@pytest.mark.parametrize("counters", [1, 7, 1 << 16])
def test_crowded_groups_behind_counters(spark, monkeypatch, counters):
    """Groups that share a full counter are still counted one by one."""
    monkeypatch.setattr(ordinals, "PLAIN_ROWS", 100)
    monkeypatch.setattr(ordinals, "COUNTERS", counters)
    group = F.when(F.col("id") < 101, "a").when(F.col("id") < 300, "b").when(F.col("id") < 400, "c").otherwise(F.concat(F.lit("g"), F.col("id") % 40))
    rows = spark.range(1000).select(group.alias("g"), (F.col("id") % 2).alias("k"), "id")
    assert {r.g for r in ordinals.crowded_groups(rows, ["g"]).collect()} == {"a", "b"}
    assert ordinals.crowded_groups(rows, ["g", "k"]) is None
    assert ordinals.crowded_groups(rows.limit(0), ["g"]) is None


def test_no_window_sees_a_crowded_group(crops, monkeypatch):
    monkeypatch.setattr(ordinals, "PLAIN_ROWS", 100)
    hashed = crops.withColumns({"_h": digest(F.col("img_path")), "n": F.lit(N // 3)})
    largest = hashed.groupBy("species", ordinals.hex_bucket(F.col("_h"))(F.col("n"))).count().agg(F.max("count")).first()[0]
    assert largest < 100
    plain = hashed.withColumn("want", F.row_number().over(W.partitionBy("species").orderBy("_h")) - 1)
    found = ordinals.with_ordinal(plain, ["species"], ordinals.hex_bucket(F.col("_h")), ["_h"], "at")
    assert found.count() == N and found.where("at <> want").count() == 0


def test_sample_ranks(crops):
    flagged = sampling.stratified_sample(crops)
    for rate, name in ((0.01, "is_in_train_1perc"), (0.1, "is_in_train_10perc")):
        sizes = {r.species: (r.n, r.k) for r in flagged.groupBy("species").agg(F.count("*").alias("n"), F.count_if(name).alias("k")).collect()}
        assert all(k == int(np.ceil(n * rate)) for n, k in sizes.values()) and sizes["fox"][0] == N // 3


def test_sizes_and_members_of_a_crowded_image(crops):
    near = bursts.burst_neighbours(bursts.burst_images(crops))
    counts = bursts.boxes_per_image(crops)
    sizes = bursts.with_burst_sizes(near, counts)
    members = bursts.burst_members(near, crops).groupBy("img_id").agg((F.count("*") - 1).alias("n"))
    both = sizes.join(members, "img_id")
    assert both.where("n <> burst_size").count() == 0 and both.count() == counts.count()
    attached = bursts.attach_burst(crops, sizes, bursts.burst_lists(sizes, crops))
    assert attached.where("list_part = 0").count() == N and attached.where("prev_same_next_img_boxes is null").count() == 0
    # 3,000 crops in one image: every member but the crop itself, in several parts.
    hot = attached.where("img_id = 'hot'").groupBy("img_path").agg(
        F.count("*").alias("parts"), F.flatten(F.collect_list("prev_same_next_img_boxes")).alias("paths")
    )
    assert hot.where((F.size("paths") != N // 3 - 1) | (F.size(F.array_distinct("paths")) != N // 3 - 1)).count() == 0
    assert hot.where("parts < 2 or array_contains(paths, img_path)").count() == 0
    drawn = positives.positive_burst(crops, sizes)
    assert drawn.count() == N and drawn.where("partner is null").count() == 0


def test_many_images_at_one_instant(spark):
    t = datetime(2020, 1, 1)
    rows = [(f"a{n}", "x", t) for n in range(2000)] + [("b", "x", t + timedelta(seconds=2)), ("c", "x", t - timedelta(seconds=5))]
    found = bursts.burst_neighbours(spark.createDataFrame(rows, "img_id string, location string, datetime timestamp_ntz"))
    kinds = Counter((r.prev_img, r.next_img) for r in found.collect())
    assert kinds == {("c", "b"): 2000, ("a0", None): 1, (None, "a0"): 1}


def test_class_partners(crops):
    found = positives.positive_class(crops, label="species").join(crops.select("img_path", "species"), "img_path")
    theirs = crops.select(F.col("img_path").alias("partner"), F.col("species").alias("other"))
    assert found.join(theirs, "partner").where("species = other").count() == N


def test_context_partners_of_one_crowded_instant(crops, monkeypatch):
    monkeypatch.setattr(draws, "GROUP_ROWS", 500)
    found = draws.positive_context(crops, "img_path")
    assert found.count() == N and found.select("img_path").distinct().count() == N
    hot = crops.where("img_id = 'hot'").select("img_path")
    inside = found.join(hot, "img_path")
    picks = Counter(r.partner for r in inside.collect())
    assert set(picks) <= {r.img_path for r in hot.collect()}
    # 3,000 uniform draws among 3,000 rows reach about 1 - 1/e of them.
    assert abs(len(picks) / (N // 3) - 0.632) < 0.05
