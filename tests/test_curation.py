from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trapline.functions import boxes, names
from trapline.operators import curation, ordinals
from trapline.plans.splits import SPLITS, splits_of

ANNOTATION = "id string, image_id string, category_id bigint, bbox array<double>, area double"


@pytest.fixture
def images(spark):
    rows = [("i1", "f1.jpg", "a", datetime(2020, 1, 1), 200, 100, "train"), ("i2", "f2.jpg", "a", datetime(2020, 1, 2), 200, 100, "test")]
    return spark.createDataFrame(
        rows, "id string, file_name string, location string, datetime timestamp_ntz, img_width int, img_height int, img_set string"
    )


def annotations(spark, rows):
    floats = [(*r[:3], r[3] and [v if v is None else float(v) for v in r[3]], r[4]) for r in rows]
    return spark.createDataFrame(floats, ANNOTATION)


def test_ratio_boxes(spark, images):
    rows = annotations(spark, [("a", "i1", 1, [0.5, 0.25, 0.1, 0.2], None), ("b", "i1", 1, None, None)])
    found = {r.id: r for r in curation.bbox_ratio_to_px(rows, images).collect()}
    assert found["a"].bbox == [100.0, 25.0, 20.0, 20.0] and found["a"].area == 400.0
    assert found["b"].bbox == [0.0] * 4 and found["b"].area == 0.0


def test_truncation_before_the_far_corner(spark):
    rows = annotations(spark, [("a", "i1", 1, [10.9, 5.9, 3.9, 2.9], None), ("b", "i1", 1, [-1.5, 0.0, 2.0, 2.0], None)])
    found = {r.id: r for r in curation.bbox_truncate(rows).collect()}
    a = found["a"]
    assert (a.x1, a.y1, a.width, a.height, a.x2, a.y2) == (10, 5, 3, 2, 13, 7)
    assert found["b"].x1 == -1


def test_min_area_keeps_the_threshold_itself(spark):
    rows = annotations(
        spark, [("a", "i1", 1, [0.0, 0, 1, 1], 4095.9), ("b", "i1", 1, [0.0, 0, 1, 1], 4096.0), ("c", "i1", 1, [0.0, 0, 64, 64], None)]
    )
    assert {r.id for r in curation.filter_min_area(rows).collect()} == {"b", "c"}


def test_malformed_boxes_are_set_apart(spark, images):
    rows = annotations(
        spark,
        [("a", "i1", 1, [0.0, 0, 90, 90], None), ("b", "i1", 1, [0.0, None, 90, 90], None), ("c", "i1", 1, [0.0, 1.0], None),
         ("d", "i1", 1, None, None)],
    )
    assert {r.id for r in curation.malformed_boxes(rows).collect()} == {"b", "c"}
    assert {r.id for r in curation.curated(rows).collect()} == {"a"}


def test_malformed_boxes_are_found_without_a_lambda(spark):
    """A lambda keeps the filter around it, and all it computes, out of the generated code."""
    nan, inf = float("nan"), float("inf")
    boxes_of = [[1, 2, 3, 4], [1, nan, 3, 4], [1, None, 3, 4], [nan, None, 3, 4], [1], [], [1, 2, 3, 4, 5], [inf, -0.0, 3, 4], [None] * 4, None]
    rows = spark.createDataFrame([(str(i), b and [v if v is None else float(v) for v in b]) for i, b in enumerate(boxes_of)], "id string, bbox array<double>")
    bad = curation.malformed_boxes(rows)
    assert {r.id for r in bad.collect()} == {"1", "2", "3", "4", "5", "6", "8"}
    assert "lambda" not in bad._jdf.queryExecution().optimizedPlan().toString()


def test_report_counts_images_and_annotations(spark, images):
    rows = annotations(
        spark, [("a", "i1", 1, [0.0, 0, 90, 90], None), ("b", "i1", 1, None, None), ("c", "i2", 1, [0.0, 0, 2, 2], None),
                ("d", "none", 1, [0.0, 0, 90, 90], None)]
    )
    found = {r.stage: (r.images, r.annotations) for r in curation.curation_report(rows, images).collect()}
    assert found == {"total": (2, 4), "has_box": (2, 2), "min_area": (1, 1)}


def test_manifest_names_numbers_and_flags(spark, images):
    categories = spark.createDataFrame([(1, "red_fox")], "id bigint, name string")
    rows = annotations(
        spark, [("b", "i1", 1, [190.0, 0, 70, 70], None), ("a", "i1", 1, [0.0, 0, 70, 70], None), ("c", "i2", 9, [0.0, 0, 70, 70], None),
                ("d", "i2", 1, [200.0, 0, 70, 70], None)]
    )
    found = {r.ann_id: r for r in curation.crop_manifest(rows, images, categories).collect()}
    assert found["a"].img_name == "i1_0_red_fox.jpg" and found["b"].img_name == "i1_1_red_fox.jpg"
    assert found["a"].img_path == "train/i1_0_red_fox.jpg"
    assert not found["b"].crop_is_empty and found["d"].crop_is_empty
    assert "c" not in found
    assert [r.id for r in curation.category_misses(rows, categories).collect()] == ["c"]


def test_equal_boxes_fan_out(spark):
    left = annotations(spark, [("a", "i1", 1, [1.2, 2.0, 3.0, 4.0], None), ("b", "i1", 1, [9.0, 2.0, 3.0, 4.0], None)])
    manifest = spark.createDataFrame(
        [("i1", 1, 2, 3, 4, 4, 6, "n0", "p0", "train", 12), ("i1", 1, 2, 3, 4, 4, 6, "n1", "p1", "train", 12)],
        "img_id string, x1 int, y1 int, width int, height int, x2 int, y2 int, img_name string, img_path string, img_set string, area bigint",
    )
    joined = curation.join_boxes(curation.bbox_truncate(left), manifest)
    assert sorted((r.id, r.img_name) for r in joined.collect() if r.img_name) == [("a", "n0"), ("a", "n1")]
    assert joined.where(F.col("id") == "b").count() == 1
    assert curation.drop_unmatched(joined).count() == 2


@pytest.mark.parametrize(
    "name, image, species",
    [("a1_0_red_fox.jpg", "a1", "red_fox"), ("a1_0_fox.jpg.jpg", "a1", "fox"), ("a1_0.jpg", "a1", ""), ("x", "x", "")],
)
def test_names(spark, name, image, species):
    row = spark.range(1).select(
        names.parse_image_id(F.lit(name)).alias("i"), names.parse_species(F.lit(name)).alias("s")
    ).first()
    assert (row.i, row.s) == (image, species)


def test_normalized_box(spark):
    parts = boxes.normalized(*[F.lit(v) for v in (10, 0, 20, 5, 100, 0)])
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert row.rel_width == 0.2 and row.center_x == 0.2 and row.rel_height is None and row.area_ratio is None


def test_empty_slices_follow_array_slicing(spark):
    import numpy as np

    picture = np.zeros((5, 7))
    spans = [(x1, x2, y1, y2) for x1 in (-3, 0, 6, 9) for x2 in (-1, 0, 7, 12) for y1 in (-9, 2, 5) for y2 in (-2, 3, 5, 8)]
    rows = spark.createDataFrame(spans, "x1 int, x2 int, y1 int, y2 int")
    flag = boxes.slice_is_empty(F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), F.lit(7), F.lit(5))
    for r in rows.withColumn("flag", flag).collect():
        assert r.flag == (picture[r.y1 : r.y2, r.x1 : r.x2].size == 0), r


def test_positions_do_not_depend_on_buckets_or_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 3 != 0).cast("int").alias("g"), "id").repartition(7)
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        expected[r.id] = sum(1 for i in expected if (i % 3 != 0) == (r.id % 3 != 0))
    for width in (1, 10, 5000):
        found = ordinals.with_ordinal(rows, ["g"], F.floor(F.col("id") / width), ["id"], "n")
        assert {r.id: r.n for r in found.collect()} == expected
    everything = ordinals.with_sorted_ordinal(rows, ["id"], "n")
    assert all(r.id == r.n for r in everything.collect())


def test_running_sums(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 5, 3.0), ("a", 9, 4.0), ("b", 2, 7.0)], "g string, k int, v double")
    for inclusive, want in ((True, {1: 2.0, 5: 5.0, 9: 9.0, 2: 7.0}), (False, {1: 0.0, 5: 2.0, 9: 5.0, 2: 0.0})):
        found = ordinals.with_running_sum(rows, ["g"], F.floor(F.col("k") / 4), ["k"], {"s": F.col("v")}, inclusive)
        assert {r.k: r.s for r in found.collect()} == want


def test_split_catalogue():
    assert splits_of("kenya", "pretrain") == ["train", "val"]
    assert set(SPLITS) == {"cct20", "icct", "serengeti", "kenya", "fmow"}
    assert set(splits_of("cct20", "probe_test")) <= set(splits_of("cct20", "folders"))
