"""Queries and SQL for bursts, encodings and context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.checks import fixtures as fx
from trapline.checks.curation_checks import near, whole
from trapline.functions.capture_time import cyclic_encode, leap_day_index, parse_capture_time, time_of_day, time_shares
from trapline.operators import bursts, encoding, features, sampling
from trapline.plans.context import context_table
from trapline.plans.splits import splits_of

LONG_GAP = 60.0


def neighbours(spark, d, gap):
    return bursts.burst_neighbours(bursts.burst_images(fx.crops(spark, d)), gap)


def sizes(spark, d, gap):
    counts = bursts.boxes_per_image(fx.crops(spark, d))
    images = bursts.counted_images(fx.crops(spark, d), counts)
    return bursts.with_burst_sizes(bursts.burst_neighbours(images, gap), counts)


def stored_sizes(spark, d):
    """The bursts at the long gap, as written by an earlier step."""
    return fx.stored(spark, d, "sizes", lambda s, p: sizes(s, p, LONG_GAP))


def neighbour_ids(spark, d, gap):
    return neighbours(spark, d, gap).select("img_id", "prev_img", "next_img")


def positive_paths(spark, d):
    return bursts.attach_burst(
        fx.crops(spark, d), stored_sizes(spark, d), bursts.burst_lists(stored_sizes(spark, d), fx.crops(spark, d))
    )


def joined(column):
    return F.array_join(column, ",")


def flagship(spark, d, gap=LONG_GAP):
    rows = context_table(fx.crops(spark, d), gap)
    return rows.select(
        "ann_id", whole("category_id"), "img_id", "img_name", "img_path", "img_set", "file_name", "location",
        "datetime", "time", "species", *[whole(c) for c in ("x1", "y1", "x2", "y2", "width", "height", "area")],
        whole("img_width"), whole("img_height"), whole("list_part"), joined("prev_same_next_img_boxes").alias("prev_same_next_img_boxes"),
        whole("boxes_per_prev_same_next_img"), whole("boxes_per_img_id"), "is_in_train_1perc", "is_in_train_10perc",
    )


def with_counts(spark, d):
    return bursts.attach_box_count(fx.crops(spark, d), bursts.boxes_per_image(fx.crops(spark, d)))


def featured(spark, d):
    return features.context_features(fx.counted_crops(spark, d))


def vector_columns(column, names, places=6):
    return [near(F.col(column)[i], n, places) for i, n in enumerate(names)]


TIME_NAMES = ["year", "day_sin", "day_cos", "hour_sin", "hour_cos", "minute_sin", "minute_cos", "second_sin", "second_cos"]


def orders(spark, d):
    return fx.table(spark, d, "orders")


def joint_codes(spark, d):
    rows = fx.crops(spark, d).select("img_path", "img_set", "species")
    train = features.split_select(rows, splits_of("cct20", "probe_train"))
    test = features.split_select(rows, splits_of("cct20", "probe_test"))
    a, b = encoding.joint_label_encode(train, test, "species", "y")
    return a.unionByName(b).select("img_path", whole("y"))


def sample_positions(spark, d):
    flagged = sampling.stratified_sample(fx.crops(spark, d))
    return sampling.sample_positions(flagged, "is_in_train_10perc", splits_of("cct20", "probe_train")).select(
        "img_path", whole("position")
    )


def text_times(spark, d):
    text = fx.images(spark, d).withColumn("date_captured", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    parsed = text.withColumn("datetime", parse_capture_time(F.col("date_captured")))
    return parsed.select("id", "datetime", time_of_day(F.col("datetime")).alias("time"))


def shares(spark, d):
    parts = time_shares(F.col("ts"))
    return fx.table(spark, d, "events").select("event_id", *[near(c, n, 9) for n, c in parts.items()])


def cyclic(spark, d):
    s, c = cyclic_encode(F.col("value") / 100.0)
    return fx.table(spark, d, "events").select("event_id", near(s, "sin_part"), near(c, "cos_part"))


def one_hot(spark, d):
    rows = encoding.location_encode(fx.crops(spark, d))
    size = rows.agg(F.max("loc_id") + 1).scalar()
    dense = features.location_one_hot(F.col("loc_id"), size)
    return rows.select("img_path", whole("loc_id"), joined(dense.cast("array<int>").cast("array<string>")).alias("one_hot"))


def merged_paths(spark, d):
    """Own crops of an image and those of its neighbours, as one set, part by part."""
    members = bursts.burst_members(neighbours(spark, d, LONG_GAP), fx.crops(spark, d))
    sized = members.join(stored_sizes(spark, d).select("img_id", (F.col("burst_size") + 1).alias("size")), "img_id")
    part = bursts.path_part(F.col("img_path"), F.col("size"))
    own = F.collect_set(F.when(F.col("relation") == "same", F.col("img_path")))
    near_by = F.collect_set(F.when(F.col("relation") != "same", F.col("img_path")))
    both = sized.groupBy("img_id", part.alias("list_part")).agg(own.alias("a"), near_by.alias("b"))
    return both.select("img_id", whole("list_part"), joined(bursts.merge_path_sets("a", "b")).alias("paths"))


def neighbours_sql(gap: float) -> str:
    """A plain interval self-join: every pair within the gap, then the nearest by (difference, id)."""
    return f"""seq as (select distinct img_id, location, datetime from crops),
pairs as (select a.img_id, b.img_id as other, epoch(b.datetime) - epoch(a.datetime) as diff
          from seq a join seq b on a.location = b.location and a.img_id <> b.img_id
           and b.datetime between a.datetime - interval {int(gap)} seconds and a.datetime + interval {int(gap)} seconds),
prev as (select img_id, arg_min(other, (-diff, other)) as prev_img, min(-diff) as prev_gap from pairs where diff < 0 group by img_id),
next as (select img_id, arg_min(other, (diff, other)) as next_img, min(diff) as next_gap from pairs where diff > 0 group by img_id),
near as (select s.*, prev_img, next_img, prev_gap, next_gap from seq s left join prev using (img_id) left join next using (img_id))"""


MEMBERS_SQL = """members as (
  select n.img_id, 'same' as relation, c.img_path from near n join crops c on c.img_id = n.img_id
  union all select n.img_id, 'prev', c.img_path from near n join crops c on c.img_id = n.prev_img
  union all select n.img_id, 'next', c.img_path from near n join crops c on c.img_id = n.next_img),
lists as (select c.img_path, count(m.img_path) as n, string_agg(m.img_path, ',' order by m.img_path) as paths
          from crops c left join members m on m.img_id = c.img_id and m.img_path <> c.img_path group by c.img_path)"""

COUNTS_SQL = "counts as (select img_id, count(distinct img_path) as boxes_per_img_id from crops group by img_id)"

TRAIN = "('train', 'train_images')"
SAMPLE_SQL = f"""ranked as (
  select species, file_name, row_number() over (partition by species order by md5(concat_ws('|', '42', species, file_name)), file_name) - 1 as rank
  from (select distinct species, file_name from crops where img_set in {TRAIN})),
quota as (select species, count(*) as n from crops where img_set in {TRAIN} group by species),
picked as (select file_name, bool_or(rank < ceil(n * 0.01e0)) as p1, bool_or(rank < ceil(n * 0.1e0)) as p10
           from ranked join quota using (species) group by file_name),
flagged as (select c.*, coalesce(p1, false) as is_in_train_1perc, coalesce(p10, false) as is_in_train_10perc
            from crops c left join picked using (file_name))"""

_SHARES = """leap as (select img_path, datetime, year(datetime) as yr,
  (list_value(0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)[month(datetime)] + day(datetime) - 1) / 366e0 as d,
  hour(datetime) / 23e0 as h, minute(datetime) / 59e0 as m, floor(second(datetime)) / 59e0 as s from crops),
ends as (select min(yr) as lo, max(yr) as hi from leap),
vec as (select img_path, case when hi = lo then 0e0 else (yr - lo) / (hi - lo)::double end as y,
  (sin(pi() * (2 * d - 1)) + 1) / 2 as ds, (cos(pi() * (2 * d - 1)) + 1) / 2 as dc,
  (sin(pi() * (2 * h - 1)) + 1) / 2 as hs, (cos(pi() * (2 * h - 1)) + 1) / 2 as hc,
  (sin(pi() * (2 * m - 1)) + 1) / 2 as ms, (cos(pi() * (2 * m - 1)) + 1) / 2 as mc,
  (sin(pi() * (2 * s - 1)) + 1) / 2 as ss, (cos(pi() * (2 * s - 1)) + 1) / 2 as sc from leap, ends)"""


def _time_select(scales):
    cols = ["y", "ds", "dc", "hs", "hc", "ms", "mc", "ss", "sc"]
    return ", ".join(f"floor(({c} * {s}e0) * 1e6 + 0.5e0) / 1e6 as {n}" for c, s, n in zip(cols, scales, TIME_NAMES))


_LOC_SQL = "locs as (select location, row_number() over (order by location) - 1 as loc_id from (select distinct location from crops))"
_REL = """rel as (select *, width::double / img_width as rw, height::double / img_height as rh,
  x1::double / img_width + width::double / img_width / 2 as cx, y1::double / img_height + height::double / img_height / 2 as cy,
  (width::double * height) / (img_width::double * img_height) as ratio from crops)"""

CHECKS = {
    "context_table": (
        flagship,
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}, {MEMBERS_SQL}, {COUNTS_SQL}, {SAMPLE_SQL}
        select ann_id, category_id, img_id, img_name, f.img_path, img_set, file_name, location, datetime,
               strftime(datetime, '%H:%M:%S') as time, species, x1::bigint as x1, y1::bigint as y1, x2::bigint as x2,
               y2::bigint as y2, width::bigint as width, height::bigint as height, area::bigint as area,
               img_width::bigint as img_width, img_height::bigint as img_height, 0::bigint as list_part,
               coalesce(l.paths, '') as prev_same_next_img_boxes, l.n as boxes_per_prev_same_next_img,
               boxes_per_img_id, is_in_train_1perc, is_in_train_10perc
        from flagged f join lists l on l.img_path = f.img_path join counts using (img_id)""",
    ),
    "burst_neighbours": (
        lambda s, d: neighbour_ids(s, d, bursts.GAP_SECONDS),
        f"{fx.CROPS_SQL}, {neighbours_sql(5)} select img_id, prev_img, next_img from near",
    ),
    "burst_neighbours_60s": (
        lambda s, d: neighbour_ids(s, d, LONG_GAP),
        f"{fx.CROPS_SQL}, {neighbours_sql(60)} select img_id, prev_img, next_img from near",
    ),
    "nearest_time_rank": (
        lambda s, d: neighbours(s, d, LONG_GAP).select("img_id", near(F.col("prev_gap"), "prev_gap"), near(F.col("next_gap"), "next_gap")),
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}
        select img_id, floor((prev_gap) * 1e6 + 0.5e0) / 1e6 as prev_gap, floor((next_gap) * 1e6 + 0.5e0) / 1e6 as next_gap from near""",
    ),
    "burst_members": (
        lambda s, d: bursts.burst_members(neighbours(s, d, LONG_GAP), fx.crops(s, d)),
        f"{fx.CROPS_SQL}, {neighbours_sql(60)}, {MEMBERS_SQL} select img_id, relation, img_path from members",
    ),
    "burst_positive_paths": (
        lambda s, d: positive_paths(s, d).select("img_path", whole("list_part"), joined("prev_same_next_img_boxes").alias("paths")),
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}, {MEMBERS_SQL}
        select img_path, 0::bigint as list_part, coalesce(paths, '') as paths from lists""",
    ),
    "attach_burst": (
        lambda s, d: positive_paths(s, d).select("img_path", "img_id", joined("prev_same_next_img_boxes").alias("paths"), whole("boxes_per_prev_same_next_img")),
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}, {MEMBERS_SQL}
        select c.img_path, img_id, coalesce(paths, '') as paths, n as boxes_per_prev_same_next_img
        from crops c join lists l on l.img_path = c.img_path""",
    ),
    "burst_list_size": (
        lambda s, d: sizes(s, d, LONG_GAP).select("img_id", whole("burst_size")),
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}, {MEMBERS_SQL}
        select img_id, count(*) - 1 as burst_size from members group by img_id""",
    ),
    "merge_path_sets": (
        merged_paths,
        f"""{fx.CROPS_SQL}, {neighbours_sql(60)}, {MEMBERS_SQL}
        select img_id, 0::bigint as list_part, string_agg(img_path, ',' order by img_path) as paths from members group by img_id""",
    ),
    "attach_box_count": (
        lambda s, d: with_counts(s, d).select("img_path", whole("boxes_per_img_id")),
        f"{fx.CROPS_SQL}, {COUNTS_SQL} select img_path, boxes_per_img_id from crops join counts using (img_id)",
    ),
    "boxes_per_image": (
        lambda s, d: bursts.boxes_per_image(fx.crops(s, d)).select("img_id", whole("boxes_per_img_id")),
        f"{fx.CROPS_SQL}, {COUNTS_SQL} select img_id, boxes_per_img_id from counts",
    ),
    "distinct_sequence_rows": (
        lambda s, d: bursts.distinct_sequence_rows(fx.crops(s, d)),
        f"{fx.CROPS_SQL} select distinct img_id, location, datetime, img_name, img_path from crops",
    ),
    "sort_sequence": (
        lambda s, d: bursts.sort_sequence(bursts.distinct_sequence_rows(fx.crops(s, d))),
        f"""{fx.CROPS_SQL} select distinct img_id, location, datetime, img_name, img_path from crops
        order by location, datetime, img_path""",
    ),
    "num_classes": (
        lambda s, d: encoding.num_classes(fx.crops(s, d)),
        f"{fx.CROPS_SQL} select count(distinct category_id) as num_classes from crops",
    ),
    "label_encode": (
        lambda s, d: encoding.label_encode(fx.crops(s, d), "species", "y").select("img_path", whole("y")),
        f"""{fx.CROPS_SQL}, codes as (select species, row_number() over (order by species) - 1 as y
        from (select distinct species from crops)) select img_path, y from crops join codes using (species)""",
    ),
    "joint_label_encode": (
        joint_codes,
        f"""{fx.CROPS_SQL}, used as (select * from crops where img_set in ('train_images', 'trans_test_images', 'cis_test_images')),
        codes as (select species, row_number() over (order by species) - 1 as y from (select distinct species from used))
        select img_path, y from used join codes using (species)""",
    ),
    "location_encode": (
        lambda s, d: encoding.location_encode(fx.crops(s, d)).select("img_path", whole("loc_id")),
        f"{fx.CROPS_SQL}, {_LOC_SQL} select img_path, loc_id from crops join locs using (location)",
    ),
    "row_ids": (
        lambda s, d: encoding.row_ids(fx.crops(s, d).select("img_path"), ["img_path"]).select("img_path", whole("im_id")),
        f"{fx.CROPS_SQL} select img_path, row_number() over (order by img_path) - 1 as im_id from crops",
    ),
    "sample_positions": (
        sample_positions,
        f"""{fx.CROPS_SQL}, {SAMPLE_SQL}, placed as (
          select img_path, is_in_train_10perc, row_number() over (order by md5(img_path), img_path) - 1 as position
          from flagged where img_set = 'train_images')
        select img_path, position from placed where is_in_train_10perc""",
    ),
    "year_scale": (
        lambda s, d: features.year_scale(orders(s, d), "o_orderdate").select("o_orderkey", near(F.col("year_scaled"), "year_scaled")),
        """with ends as (select min(year(o_orderdate)) as lo, max(year(o_orderdate)) as hi from orders)
        select o_orderkey, floor(((year(o_orderdate) - lo) / (hi - lo)::double) * 1e6 + 0.5e0) / 1e6 as year_scaled from orders, ends""",
    ),
    "leap_day_index": (
        lambda s, d: orders(s, d).select("o_orderkey", leap_day_index(F.col("o_orderdate")).cast("bigint").alias("day_index")),
        """select o_orderkey, dayofyear(make_date(2020, month(o_orderdate), day(o_orderdate))) - 1 as day_index from orders""",
    ),
    "cyclic_encode": (
        cyclic,
        """select event_id, floor(((sin(pi() * (2 * (value / 100e0) - 1)) + 1) / 2) * 1e6 + 0.5e0) / 1e6 as sin_part,
        floor(((cos(pi() * (2 * (value / 100e0) - 1)) + 1) / 2) * 1e6 + 0.5e0) / 1e6 as cos_part from events""",
    ),
    "time_normalize": (
        shares,
        """select event_id, floor(((dayofyear(make_date(2020, month(ts), day(ts))) - 1) / 366e0) * 1e9 + 0.5e0) / 1e9 as day_share,
        floor((hour(ts) / 23e0) * 1e9 + 0.5e0) / 1e9 as hour_share, floor((minute(ts) / 59e0) * 1e9 + 0.5e0) / 1e9 as minute_share,
        floor((floor(second(ts)) / 59e0) * 1e9 + 0.5e0) / 1e9 as second_share from events""",
    ),
    "hour_of_day": (
        lambda s, d: fx.table(s, d, "events").select("event_id", features.hour_of_day(F.col("ts")).cast("bigint").alias("hour")),
        "select event_id, hour(ts) as hour from events",
    ),
    "parse_capture_time": (
        text_times,
        f"{fx.CURATION_SQL} select id, datetime, strftime(datetime, '%H:%M:%S') as time from images",
    ),
    "bbox_normalize": (
        lambda s, d: features.bbox_normalize(fx.crops(s, d)).select(
            "img_path", *[near(F.col(c), c, 9) for c in ("rel_width", "rel_height", "center_x", "center_y", "area_ratio")]
        ),
        f"""{fx.CROPS_SQL}, {_REL} select img_path, floor((rw) * 1e9 + 0.5e0) / 1e9 as rel_width, floor((rh) * 1e9 + 0.5e0) / 1e9 as rel_height,
        floor((cx) * 1e9 + 0.5e0) / 1e9 as center_x, floor((cy) * 1e9 + 0.5e0) / 1e9 as center_y, floor((ratio) * 1e9 + 0.5e0) / 1e9 as area_ratio from rel""",
    ),
    "multi_box_flag": (
        lambda s, d: with_counts(s, d).select("img_path", features.multi_box_flag(F.col("boxes_per_img_id")).alias("multi")),
        f"""{fx.CROPS_SQL}, {COUNTS_SQL} select img_path, case when boxes_per_img_id > 1 then 1e0 else 0e0 end as multi
        from crops join counts using (img_id)""",
    ),
    "location_one_hot": (
        one_hot,
        f"""{fx.CROPS_SQL}, {_LOC_SQL}
        select img_path, loc_id, array_to_string(list_transform(range((select count(*) from locs)),
               lambda i: case when i = loc_id then 1 else 0 end), ',') as one_hot
        from crops join locs using (location)""",
    ),
    "context_time": (
        lambda s, d: featured(s, d).select("img_path", *vector_columns("con_time", TIME_NAMES)),
        f"{fx.CROPS_SQL}, {_SHARES} select img_path, {_time_select([1] * 9)} from vec",
    ),
    "context_time_scaled": (
        lambda s, d: featured(s, d).select("img_path", *vector_columns("con_time_scaled", TIME_NAMES)),
        f"{fx.CROPS_SQL}, {_SHARES} select img_path, {_time_select(features.TIME_SCALES)} from vec",
    ),
    "context_bbox": (
        lambda s, d: featured(s, d).select("img_path", *vector_columns("con_bbox", ["cx", "cy", "w", "h", "multi"], 9)),
        f"""{fx.CROPS_SQL}, {COUNTS_SQL}, {_REL}
        select img_path, floor((cx) * 1e9 + 0.5e0) / 1e9 as cx, floor((cy) * 1e9 + 0.5e0) / 1e9 as cy, floor((rw) * 1e9 + 0.5e0) / 1e9 as w, floor((rh) * 1e9 + 0.5e0) / 1e9 as h,
               case when boxes_per_img_id > 1 then 1e0 else 0e0 end as multi from rel join counts using (img_id)""",
    ),
    "context_standard": (
        lambda s, d: features.context_standard(featured(s, d), dense=True).select(
            "img_path", *vector_columns("con_standard", TIME_NAMES),
            F.size("con_standard").cast("bigint").alias("width"),
            (F.array_position(F.slice("con_standard", 10, 1_000_000), 1.0) - 1).alias("loc_id"),
        ),
        f"""{fx.CROPS_SQL}, {_SHARES}, {_LOC_SQL}
        select img_path, {_time_select([1] * 9)}, 9 + (select count(*) from locs) as width, loc_id
        from vec join crops using (img_path) join locs using (location)""",
    ),
    "train_species": (
        lambda s, d: sampling.train_species(fx.crops(s, d)),
        f"{fx.CROPS_SQL} select distinct species from crops where img_set in {TRAIN}",
    ),
    "stratified_sample": (
        lambda s, d: sampling.stratified_sample(fx.crops(s, d)).select("img_path", "is_in_train_1perc", "is_in_train_10perc"),
        f"{fx.CROPS_SQL}, {SAMPLE_SQL} select img_path, is_in_train_1perc, is_in_train_10perc from flagged",
    ),
    "uniform_sample": (
        lambda s, d: sampling.uniform_sample(fx.crops(s, d), "img_path", 0.1, 2001).select("img_path"),
        f"""{fx.CROPS_SQL} select img_path from (select img_path, row_number() over (order by md5(concat_ws('|', '2001', img_path)), img_path) as r
        from crops) where r <= floor((select count(*) from crops) * 0.1e0)""",
    ),
}
