"""Partner draws that need no distances: the row itself, its burst, its class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.hashing import digest, index_draw, unit_draw
from trapline.operators.ordinals import hex_bucket, with_ordinal, with_running_sum_by_range

RUN_SEED = 2001


def positive_self(rows: DataFrame, key: str = "img_path") -> DataFrame:
    return rows.select(key, F.col(key).alias("partner"))


def _numbered(rows: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    hashed = rows.withColumn("_h", digest(F.col(key)))
    return with_ordinal(hashed, group, hex_bucket(F.col("_h")), ["_h", key], name).drop("_h")


def positive_burst(crops: DataFrame, sizes: DataFrame, seed: int = RUN_SEED, round_: int = 0) -> DataFrame:
    """Uniform over the crop itself and its burst, by count and position: no list is read.

    `sizes` is one row per image, from `bursts.with_burst_sizes`.

    Image, previous and next image form one range of positions; the drawn position is looked up.
    """
    placed = _numbered(crops.select("img_id", "img_path"), ["img_id"], "img_path", "pos")
    total = F.col("boxes_per_img_id") + F.col("n_prev") + F.col("n_next")
    drawn = crops.select("img_id", "img_path").join(sizes, "img_id").withColumn(
        "i", index_draw(total, seed, round_, F.col("img_path"))
    )
    in_same = F.col("i") < F.col("boxes_per_img_id")
    in_prev = F.col("i") < F.col("boxes_per_img_id") + F.col("n_prev")
    targets = drawn.select(
        "img_path",
        F.when(in_same, F.col("img_id")).when(in_prev, F.col("prev_img")).otherwise(F.col("next_img")).alias("img_id"),
        F.when(in_same, F.col("i"))
        .when(in_prev, F.col("i") - F.col("boxes_per_img_id"))
        .otherwise(F.col("i") - F.col("boxes_per_img_id") - F.col("n_prev"))
        .alias("pos"),
    )
    return targets.join(placed.withColumnRenamed("img_path", "partner"), ["img_id", "pos"]).select(
        "img_path", "partner"
    )


def positive_class(
    rows: DataFrame, key: str = "img_path", label: str = "category_id", noise: float = 0.0,
    same_location: bool = False, location: str = "location", seed: int = RUN_SEED, round_: int = 0,
    exclude_self: bool = False,
) -> DataFrame:
    """A partner of the same class, or with probability `noise` of any other class.

    Rows of one scope (the table, or a location) are laid out class after class. A class is then a range
    of positions and "any other class" is the rest, so one hashed position and one equi-join do the draw.
    The row itself is a candidate unless `exclude_self`. With no candidate the partner is null, as it is for rows
    without a class (or, with `same_location`, without a location), which are no candidates either.
    """
    scope = [location] if same_location else []
    whole = F.col(label).isNotNull()
    if same_location:
        whole = whole & F.col(location).isNotNull()
    base = rows.select(key, label, *scope).where(whole)
    placed = _numbered(base, [*scope, label], key, "pos")
    per_class = base.groupBy(*scope, label).agg(F.count("*").alias("n"))
    starts = class_layout(per_class, scope, label)
    seen = (placed if exclude_self else base).join(starts, [*scope, label])
    alike = F.col("n") - F.lit(int(exclude_self))
    other = unit_draw(seed, round_, "noise", F.col(key)) < F.lit(float(noise))
    pick = index_draw(
        F.when(F.col("other"), F.col("scope_n") - F.col("n")).otherwise(alike), seed, round_, "pick", F.col(key)
    )
    in_class = F.col("i") + (F.col("i") >= F.col("pos")).cast("int") if exclude_self else F.col("i")
    position = F.when(
        F.col("other"), F.when(F.col("i") < F.col("start"), F.col("i")).otherwise(F.col("i") + F.col("n"))
    ).otherwise(F.col("start") + in_class)
    empty = F.when(F.col("other"), F.col("scope_n") == F.col("n")).otherwise(alike == 0)
    drawn = seen.withColumn("other", other).withColumn("i", pick).select(
        key, *scope, F.when(~empty, position).alias("at")
    )
    index = placed.join(starts, [*scope, label]).select(
        *scope, (F.col("start") + F.col("pos")).alias("at"), F.col(key).alias("partner")
    )
    found = drawn.where(F.col("at").isNotNull()).join(index, [*scope, "at"]).select(key, "partner")
    nobody = F.lit(None).cast(rows.schema[key].dataType).alias("partner")
    none = drawn.where(F.col("at").isNull()).select(key, nobody)
    return found.unionByName(none).unionByName(rows.where(~whole).select(key, nobody))


def class_layout(per_class: DataFrame, scope: list[str], label: str) -> DataFrame:
    """Start position of every class inside its scope and the size of the scope: one row per class."""
    placed = with_running_sum_by_range(per_class, scope, [label], {"start": F.col("n")}, inclusive=False)
    sizes = per_class.groupBy(*scope).agg(F.sum("n").alias("scope_n"))
    joined = placed.join(sizes, scope) if scope else placed.withColumn("scope_n", sizes.scalar())
    return joined.select(*scope, label, "n", "start", "scope_n")


def resolve_positive(draws: DataFrame, index: DataFrame, position: str = "im_id", key: str = "img_path") -> DataFrame:
    """Chosen partner position -> partner key."""
    names = index.select(F.col(position).alias("partner_id"), F.col(key).alias("partner"))
    return draws.join(names, "partner_id", "left")


def positive_class_agreement(
    draws: DataFrame, rows: DataFrame, key: str = "img_path", label: str = "category_id"
) -> DataFrame:
    """Share of drawn partners with the row's own class, and of rows that drew themselves, over all draws.

    A draw without a partner is counted, as neither; so is one of a row without a class as not of its class.
    """
    own = rows.select(key, F.col(label).alias("own_label"))
    theirs = rows.select(F.col(key).alias("partner"), F.col(label).alias("partner_label"))
    def share(same):
        return F.avg(F.coalesce(same, F.lit(False)).cast("double"))

    return draws.join(own, key).join(theirs, "partner", "left").agg(
        share(F.col("own_label") == F.col("partner_label")).alias("class_agreement"),
        share(F.col(key) == F.col("partner")).alias("self_share"),
        F.count("*").alias("n_draws"),
    )
