"""Burst neighbours: the nearest earlier and later image of the same location within a short gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.functions.capture_time import epoch_micros
from trapline.session import cut

GAP_SECONDS = 5.0
BLOCK_SECONDS = 3600
LIST_PART = 1_000  # paths in one part of a list, about; longer lists have more parts


def distinct_sequence_rows(crops: DataFrame) -> DataFrame:
    return crops.select("img_id", "location", "datetime", "img_name", "img_path").dropDuplicates()


def sort_sequence(sequence: DataFrame) -> DataFrame:
    """Presentation order only; the neighbour search does not need it."""
    return sequence.orderBy("location", "datetime", "img_path")


def burst_images(crops: DataFrame) -> DataFrame:
    """One row per image. An image has one location and one capture time."""
    return crops.select("img_id", "location", "datetime").distinct()


def burst_neighbours(images: DataFrame, gap_seconds: float = GAP_SECONDS) -> DataFrame:
    """`prev_img`, `next_img` and their time differences for every (img_id, location, datetime).

    The nearest strictly earlier image sits at the previous distinct capture time of its location, so
    no pairs are formed: images shrink to one row per (location, time) holding the smallest id, and a
    window looks one row back and one ahead. Time is cut into blocks, with the rows near a block's
    edge copied into the block next to it, so a busy location is spread over many tasks.

    Images that carry `boxes_per_img_id` (`attach_box_count`) also get that of both neighbours, `n_prev` and `n_next`.
    """
    counted = "boxes_per_img_id" in images.columns
    first = F.struct("img_id", *["boxes_per_img_id"] * counted)
    gap = round(gap_seconds * 1_000_000)
    block = max(BLOCK_SECONDS * 1_000_000, 4 * gap)
    placed = F.col("location").isNotNull() & F.col("datetime").isNotNull()
    moments = (
        images.where(placed)
        .groupBy("location", "datetime")
        .agg(F.min(F.when(F.col("img_id").isNotNull(), first)).alias("first"))
        .withColumn("t", epoch_micros(F.col("datetime")))
    )
    block_of = lambda t: F.floor(t / F.lit(block))
    shifts = F.array(*[F.lit(s).cast("bigint") for s in (-gap, 0, gap)])
    by_time = W.partitionBy("location", "block").orderBy("t")

    def near(step, name: str):
        diff = F.abs(step("t").over(by_time) - F.col("t"))
        ok = diff <= F.lit(gap)
        found = F.when(ok, step("first").over(by_time))
        count = {f"n_{name}": found["boxes_per_img_id"]} if counted else {}
        return {f"{name}_img": found["img_id"], f"{name}_gap": F.when(ok, diff / F.lit(1_000_000)), **count}

    columns = ["prev_img", "next_img", "prev_gap", "next_gap", *["boxes_per_img_id", "n_prev", "n_next"] * counted]
    linked = (
        moments.withColumn("block", F.explode(F.array_distinct(F.transform(shifts, lambda s: block_of(F.col("t") + s)))))
        .withColumns({**near(F.lag, "prev"), **near(F.lead, "next")})
        .where(F.col("block") == block_of(F.col("t")))
        .select("location", "datetime", *[c for c in columns if c != "boxes_per_img_id"])
    )
    found = images.where(placed).join(linked, ["location", "datetime"])
    unplaced = images.where(~placed)  # kept out of the join: null keys would all meet in one task
    return found.unionByName(unplaced, allowMissingColumns=True).select("img_id", "location", "datetime", *columns)


def boxes_per_image(crops: DataFrame) -> DataFrame:
    return crops.groupBy("img_id").agg(F.countDistinct("img_path").alias("boxes_per_img_id"))


def burst_links(neighbours: DataFrame) -> DataFrame:
    """(img_id, relation, member_img): the image itself, and its neighbours where there are any."""
    sides = [("same", "img_id"), ("prev", "prev_img"), ("next", "next_img")]
    pairs = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(c).alias("member_img")) for r, c in sides])
    return neighbours.select("img_id", F.inline(pairs)).where(F.col("member_img").isNotNull())


def with_burst_sizes(neighbours: DataFrame, counts: DataFrame) -> DataFrame:
    """Crop counts of the image itself and of both neighbours, at image grain: no list is built.

    Neighbours that come with their counts (see `burst_neighbours`) are not looked up in `counts` again.
    """
    if {"boxes_per_img_id", "n_prev", "n_next"} <= set(neighbours.columns):
        return _sizes_of_counted(neighbours)
    sized = burst_links(neighbours).join(
        counts.select(F.col("img_id").alias("member_img"), F.col("boxes_per_img_id").alias("n")), "member_img"
    )

    def side(relation: str, column: str):
        return F.max(F.when(F.col("relation") == relation, F.col(column)))

    return (
        sized.groupBy("img_id")
        .agg(
            side("prev", "member_img").alias("prev_img"), side("next", "member_img").alias("next_img"),
            side("same", "n").alias("boxes_per_img_id"),
            F.coalesce(side("prev", "n"), F.lit(0)).alias("n_prev"),
            F.coalesce(side("next", "n"), F.lit(0)).alias("n_next"),
        )
        .withColumn("burst_size", F.col("boxes_per_img_id") - 1 + F.col("n_prev") + F.col("n_next"))
    )


def _sizes_of_counted(neighbours: DataFrame) -> DataFrame:
    known = {f"{side}_img": F.when(F.col(f"n_{side}").isNotNull(), F.col(f"{side}_img")) for side in ("prev", "next")}
    return (
        neighbours.where(F.coalesce("boxes_per_img_id", "n_prev", "n_next").isNotNull())
        .groupBy("img_id")
        .agg(
            *[F.max(image).alias(name) for name, image in known.items()],
            F.max("boxes_per_img_id").alias("boxes_per_img_id"),
            F.coalesce(F.max("n_prev"), F.lit(0)).alias("n_prev"),
            F.coalesce(F.max("n_next"), F.lit(0)).alias("n_next"),
        )
        .withColumn("burst_size", F.col("boxes_per_img_id") - 1 + F.col("n_prev") + F.col("n_next"))
    )


def counted_images(crops: DataFrame, counts: DataFrame) -> DataFrame:
    """`burst_images` with the number of crops of each; written out, as the neighbour search reads it several times."""
    return cut(attach_box_count(burst_images(crops), counts))


def burst_members(neighbours: DataFrame, crops: DataFrame) -> DataFrame:
    """The whole burst of every image as rows (img_id, relation, img_path), whatever its size.

    A crop's candidates are the members of its image without itself, so nothing is repeated per crop.
    """
    paths = crops.select(F.col("img_id").alias("member_img"), "img_path").distinct()
    return burst_links(neighbours).join(paths, "member_img").select("img_id", "relation", "img_path")


def path_part(path: Column, size: Column, part: int = LIST_PART) -> Column:
    """Which part of a list of `size` paths a path is in, by its hash; part 0 alone for lists of one part."""
    return F.pmod(F.xxhash64(path), F.ceil(size / part)).cast("int")


def burst_lists(sizes: DataFrame, crops: DataFrame, part: int = LIST_PART) -> DataFrame:
    """(img_id, list_part, burst_paths): the paths of every image's own crops and of both neighbours, sorted, in parts.

    Most images have one part. A burst of any size is whole in its parts, and no row or task holds all of it.
    """
    members = burst_members(sizes.select("img_id", "prev_img", "next_img"), crops)
    sized = members.join(sizes.select("img_id", (F.col("burst_size") + 1).alias("_size")), "img_id")
    parted = sized.withColumn("list_part", path_part(F.col("img_path"), F.col("_size"), part))
    lists = parted.groupBy("img_id", "list_part").agg(F.array_sort(F.collect_set("img_path")).alias("burst_paths"))
    several = sizes.where(F.col("burst_size") + 1 > part).select("img_id", F.lit(0).alias("list_part"), F.array().cast("array<string>").alias("burst_paths"))
    # The hash may leave part 0 empty; every image has it.
    return lists.unionByName(several.join(lists.select("img_id", "list_part"), ["img_id", "list_part"], "left_anti"))


def attach_box_count(crops: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the number of crops of the image to every crop."""
    return crops.join(counts.select("img_id", "boxes_per_img_id"), "img_id", "left")


def attach_burst(crops: DataFrame, sizes: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds counts and the list of positive paths (without the crop itself) to every crop, a row per list part."""
    per_image = sizes.select("img_id", "boxes_per_img_id", "burst_size").join(lists, "img_id", "left")
    own = F.array_remove("burst_paths", F.col("img_path"))
    return (
        crops.join(per_image, "img_id", "left")
        .withColumn("prev_same_next_img_boxes", own)
        .withColumnRenamed("burst_size", "boxes_per_prev_same_next_img")
        .drop("burst_paths")
    )


def merge_path_sets(a, b):
    """Union of two path lists, or of the same part of both, sorted."""
    return F.array_sort(F.array_union(a, b))
