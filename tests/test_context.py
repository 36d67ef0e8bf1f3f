import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trapline.functions import capture_time
from trapline.operators import bursts, encoding, features, sampling

START = datetime(2019, 6, 1, 12, 0, 0)
IMAGE = "img_id string, location string, datetime timestamp_ntz"


def seq(spark, rows):
    return spark.createDataFrame([(i, loc, START + timedelta(seconds=s) if s is not None else None) for i, loc, s in rows], IMAGE)


def test_nearest_images_of_a_burst(spark):
    rows = seq(spark, [("a", "x", 0), ("b", "x", 0), ("c", "x", 5), ("d", "x", 11), ("e", "y", 1), ("f", None, 1), ("g", "x", None)])
    found = {r.img_id: (r.prev_img, r.next_img) for r in bursts.burst_neighbours(rows).collect()}
    assert found == {
        "a": (None, "c"), "b": (None, "c"), "c": ("a", None), "d": (None, None), "e": (None, None),
        "f": (None, None), "g": (None, None),
    }


@pytest.mark.parametrize("gap", [5.0, 40.0, 2000.0])
def test_neighbours_equal_a_search_over_all_pairs(spark, gap):
    """Times crowd around the edges of the hour blocks and repeat."""
    rng = random.Random(3)
    rows = [
        (f"i{n:04d}", rng.choice("xy"), rng.choice([0, 3600, 7200]) + rng.choice([-5.0, -4.5, -0.25, 0.0, 0.25, 4.75, 5.0, 40.0, 900.0]))
        for n in range(250)
    ]
    want = {}
    for i, loc, t in rows:
        before = [(t - u, j) for j, l2, u in rows if l2 == loc and j != i and t - gap <= u < t]
        after = [(u - t, j) for j, l2, u in rows if l2 == loc and j != i and t < u <= t + gap]
        want[i] = (min(before)[1] if before else None, min(after)[1] if after else None)
    table = seq(spark, rows)
    for part in (table, table.repartition(5, "img_id")):
        assert {r.img_id: (r.prev_img, r.next_img) for r in bursts.burst_neighbours(part, gap).collect()} == want


def crops(spark):
    rows = [("a", 0, "p1"), ("a", 0, "p2"), ("b", 3, "p3"), ("c", 20, "p4")]
    return spark.createDataFrame(
        [(i, "x", START + timedelta(seconds=s), p, p) for i, s, p in rows], f"{IMAGE}, img_name string, img_path string"
    )


def test_lists_hold_the_burst_without_the_crop(spark):
    rows = crops(spark)
    near = bursts.burst_neighbours(bursts.burst_images(rows))
    sizes = bursts.with_burst_sizes(near, bursts.boxes_per_image(rows))
    full = bursts.attach_burst(rows, sizes, bursts.burst_lists(sizes, rows)).collect()
    assert {r.img_path: r.prev_same_next_img_boxes for r in full} == {
        "p1": ["p2", "p3"], "p2": ["p1", "p3"], "p3": ["p1", "p2"], "p4": [],
    }
    assert {r.img_path: r.boxes_per_prev_same_next_img for r in full} == {"p1": 2, "p2": 2, "p3": 2, "p4": 0}
    # A longer list comes in parts, and is whole in them; every crop has part 0.
    parted = bursts.attach_burst(rows, sizes, bursts.burst_lists(sizes, rows, part=1)).collect()
    whole = {p: sorted(x for r in parted if r.img_path == p for x in r.prev_same_next_img_boxes) for p in ("p1", "p2", "p3", "p4")}
    assert whole == {"p1": ["p2", "p3"], "p2": ["p1", "p3"], "p3": ["p1", "p2"], "p4": []}
    assert sorted(r.img_path for r in parted if r.list_part == 0) == ["p1", "p2", "p3", "p4"]
    assert {r.img_path: r.boxes_per_prev_same_next_img for r in parted} == {"p1": 2, "p2": 2, "p3": 2, "p4": 0}
    members = bursts.burst_members(near, rows).where(F.col("img_id") == "a").collect()
    assert {(r.relation, r.img_path) for r in members} == {("same", "p1"), ("same", "p2"), ("next", "p3")}


def test_counts_come_with_the_neighbours(spark):
    """Sizes by counts that images carry equal those looked up by links, which then takes no join."""
    placed = [("a", "x", 0, "p1"), ("a", "x", 0, "p2"), ("a", "x", 0, "p2"), ("b", "x", 0, "p3"), ("c", "x", 3, "p4"), ("c", "y", 9, "p5"),
              ("d", "x", 5, "p6"), ("e", "y", 12, "p7"), ("f", None, 1, "p8"), ("g", "x", None, "p9"), (None, "x", 4, "q1"), ("h", "x", 8, None)]
    rows = spark.createDataFrame([(i, loc, START + timedelta(seconds=s) if s is not None else None, p, p) for i, loc, s, p in placed],
                                 f"{IMAGE}, img_name string, img_path string")
    counts = bursts.boxes_per_image(rows)
    near = bursts.burst_neighbours(bursts.counted_images(rows, counts))
    columns = ["img_id", "prev_img", "next_img", "boxes_per_img_id", "n_prev", "n_next", "burst_size"]
    found = bursts.with_burst_sizes(near, counts).select(columns)
    looked_up = bursts.with_burst_sizes(bursts.burst_neighbours(bursts.burst_images(rows)), counts).select(columns)
    sizes = {r.img_id: r.burst_size for r in found.collect()}
    # c has crops at two times: at x it follows a, at y it precedes e.
    assert sizes["a"] == 1 + 2 and sizes["b"] == 2 and sizes["c"] == 1 + 2 + 1 and sizes["e"] == 2 and sizes["f"] == sizes["g"] == 0
    assert sorted(map(str, found.collect())) == sorted(map(str, looked_up.collect()))
    assert "Join" not in bursts.with_burst_sizes(spark.createDataFrame(near.limit(0).collect(), near.schema), counts)._jdf.queryExecution().optimizedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("x, want", [(0.0, (0.5, 0.0)), (0.25, (0.0, 0.5)), (0.5, (0.5, 1.0)), (1.0, (0.5, 0.0))])
def test_cyclic(spark, x, want):
    s, c = capture_time.cyclic_encode(F.lit(x))
    assert one(spark, s) == pytest.approx(want[0]) and one(spark, c) == pytest.approx(want[1])


@pytest.mark.parametrize("text, want", [("2019-03-01", 60), ("2020-12-31", 365), ("2021-01-01", 0)])
def test_leap_days(spark, text, want):
    assert one(spark, capture_time.leap_day_index(F.lit(text).cast("timestamp_ntz"))) == want


@pytest.mark.parametrize("hour", [7, 14])
def test_hours(spark, hour):
    assert one(spark, features.hour_of_day(F.lit(f"2020-01-01 {hour:02d}:00:00").cast("timestamp_ntz"))) == hour


def test_year_scale(spark):
    def scaled(*years):
        rows = spark.createDataFrame([(datetime(y, 5, 5),) for y in years], "datetime timestamp_ntz")
        return [r.year_scaled for r in features.year_scale(rows).orderBy("datetime").collect()]

    assert scaled(2010, 2012, 2014) == [0.0, 0.5, 1.0]
    assert scaled(2010, 2010) == [0.0, 0.0]


def test_capture_times_that_are_none(spark):
    from trapline.sources.coco import bad_capture_times, with_capture_time

    rows = spark.createDataFrame([("2013-02-03 04:05:06",), ("soon",), (None,)], "date_captured string")
    got = [r.datetime for r in with_capture_time(rows).collect()]
    assert got == [datetime(2013, 2, 3, 4, 5, 6), None, None]
    assert bad_capture_times(rows).count() == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_capture_times_are_clock_readings_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        from trapline.sources.coco import with_capture_time

        texts = [("2024-03-10 02:30:00",), ("2024-01-01T00:00:00+02:00",)]
        rows = with_capture_time(spark.createDataFrame(texts, "date_captured string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.datetime for r in rows] == [datetime(2024, 3, 10, 2, 30), datetime(2024, 1, 1)]


def test_codes_are_positions_of_sorted_labels(spark):
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 50).alias("label"), "id")
    want = {r.id: r.y for r in encoding.label_encode(rows, "label", "y").collect()}
    labels = sorted(f"k{i}" for i in range(50))
    assert all(labels[y] == f"k{i % 50}" for i, y in want.items())


def sample_rows(spark, n, species="fox", split="train"):
    return spark.createDataFrame(
        [(f"{species}{i}", f"{species}{i}.jpg", species, split) for i in range(n)],
        "img_path string, file_name string, species string, img_set string",
    )


@pytest.mark.parametrize("n, column, want", [(70, "is_in_train_10perc", 7), (71, "is_in_train_10perc", 8), (5, "is_in_train_1perc", 1)])
def test_exact_sample_sizes(spark, n, column, want):
    flagged = sampling.stratified_sample(sample_rows(spark, n).unionByName(sample_rows(spark, 30, "owl", "test")))
    assert flagged.where(F.col(column)).count() == want
    assert flagged.count() == n + 30


def test_fewer_files_than_the_quota(spark):
    rows = sample_rows(spark, 3).withColumn("file_name", F.lit("same.jpg"))
    assert sampling.stratified_sample(rows, {"all": 1.0}).where("all").count() == 3


def test_flags_follow_the_file_unless_restricted(spark):
    rows = sample_rows(spark, 1).unionByName(sample_rows(spark, 1, "owl", "test").withColumn("file_name", F.lit("fox0.jpg")))
    assert sampling.stratified_sample(rows, {"f": 1.0}).where("f").count() == 2
    assert sampling.stratified_sample(rows, {"f": 1.0}, restrict=True).where("f").count() == 1


def test_uniform_sample_is_exact_and_stable(spark):
    rows = spark.range(1001).select(F.col("id").cast("string").alias("k"))
    a = {r.k for r in sampling.uniform_sample(rows, "k", 0.1, 7).collect()}
    b = {r.k for r in sampling.uniform_sample(rows.repartition(13), "k", 0.1, 7).collect()}
    assert a == b and len(a) == 100
    assert a != {r.k for r in sampling.uniform_sample(rows, "k", 0.1, 8).collect()}


def test_uniform_sample_without_moving_rows(spark, monkeypatch):
    """The threshold is found by counts of the hash; the sample itself is a filter."""
    hashes = spark.createDataFrame([(h,) for h in ("a1", "a2", "a2b", "b", "c0ffee", "c0ffef", "d")], "h string")
    for few in (1, 100):
        assert [sampling.kth_smallest(hashes, k, few) for k in range(8)] == [None, "a1", "a2", "a2b", "b", "c0ffee", "c0ffef", "d"]
    rows = spark.range(5_000).withColumnRenamed("id", "k")
    want = {r.k for r in sampling.uniform_sample(rows, "k", 0.3, 7).collect()}
    monkeypatch.setattr(sampling, "FEW", 1)
    sample = sampling.uniform_sample(rows, "k", 0.3, 7)
    assert "Exchange" not in sample._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in sample.collect()} == want and len(want) == 1_500
    assert sampling.uniform_sample(rows, "k", 0.0, 7).count() == 0 and sampling.uniform_sample(rows, "k", 1.0, 7).count() == 5_000
