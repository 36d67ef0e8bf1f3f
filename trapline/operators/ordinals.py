"""Positions and running sums inside groups, with no task that ever holds a crowded group.

A group of up to PLAIN_ROWS rows is one window, so a table of small groups costs one shuffle. A larger one is cut into
buckets by an order-preserving column (a prefix of a hash, or a range of keys): windows run inside (group, bucket), and
what came before the bucket is a running sum over bucket totals, which exist for large groups only. The result does
not depend on the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.session import cut

PLAIN_ROWS = 100_000
COUNTERS = 1 << 16  # groups are counted together, in so many counters, until one has more than PLAIN_ROWS rows

Bucket = Column | Callable[[Column], Column]


def hex_bucket(digest: Column) -> Callable[[Column], Column]:
    """The first digits of a hash, as many as leave a bucket of a group of n rows at most PLAIN_ROWS or so."""

    def of(n: Column) -> Column:
        digits = F.ceil(F.log(F.greatest(n / PLAIN_ROWS, F.lit(1.0))) / math.log(16)) + 1
        return F.substring(digest, F.lit(1), digits.cast("int"))

    return of


def with_running_sum(
    df: DataFrame,
    group: list[str],
    bucket: Bucket,
    order: list[str],
    sums: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Adds, for each entry of `sums`, its running sum in `order` inside `group`.

    Group columns must not be null; (group, order) must be unique for a stable result. `bucket` is a column, or made
    from the number of rows of the group.
    """
    bucket_of = bucket if callable(bucket) and not isinstance(bucket, Column) else lambda n: bucket
    if group:
        crowded = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > PLAIN_ROWS)
        sized = df.join(crowded, group, "left")
        keyed = sized.withColumn("_bucket", F.when(F.col("_n").isNotNull(), bucket_of(F.col("_n")))).drop("_n")
        large = keyed.where(F.col("_bucket").isNotNull())
    else:
        keyed = df.withColumn("_bucket", bucket_of(df.agg(F.count("*")).scalar()))
        large = keyed
    by = [*group, "_bucket"]
    last = W.currentRow if inclusive else -1
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    local = keyed.withColumns(
        {f"_in_{name}": F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in sums.items()}
    )
    totals = large.groupBy(*by).agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()])
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *by, *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_from_{name}") for name in sums]
    )
    joined = local.join(starts, by, "left")
    added = {name: F.col(f"_in_{name}") + F.coalesce(f"_from_{name}", F.lit(0)) for name in sums}
    helpers = ["_bucket", *[f"_in_{n}" for n in sums], *[f"_from_{n}" for n in sums]]
    return joined.withColumns(added).drop(*helpers)


def with_ordinal(df: DataFrame, group: list[str], bucket: Bucket, order: list[str], name: str) -> DataFrame:
    """0-based position of every row inside its group."""
    return with_running_sum(df, group, bucket, order, {name: F.lit(1).cast("bigint")}, inclusive=False)


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """The table in ranges of `by`, their number in `_range`; written out, as a recomputation could draw other bounds."""
    return cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))


def with_running_sum_by_range(
    df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """The same for any sortable key, when no column makes even buckets: a crowded group spans many ranges.

    Looks for crowded groups at once; only their rows are dealt out by ranges.
    """
    if not group:
        return with_running_sum(ranged(df, *order), [], F.col("_range"), order, sums, inclusive).drop("_range")
    crowded = crowded_groups(df, group)
    if crowded is None:
        return _in_windows(df, group, order, sums, inclusive)
    large = ranged(df.join(crowded, group, "left_semi"), *group, *order)
    parted = with_running_sum(large, group, F.col("_range"), order, sums, inclusive).drop("_range")
    return _in_windows(df.join(crowded, group, "left_anti"), group, order, sums, inclusive).unionByName(parted)


def crowded_groups(df: DataFrame, group: list[str]) -> DataFrame | None:
    """The groups of more than PLAIN_ROWS rows, or None if there are none.

    A crowded group fills its counter alone, so where no counter is full no group is counted by itself, and a task
    hands on a number per counter instead of one per group. Otherwise the groups of the full counters are counted.
    """
    counted = df.withColumn("_counter", F.pmod(F.xxhash64(*group), F.lit(COUNTERS)))

    def crowds(rows: DataFrame, by: list[str]) -> DataFrame:
        return cut(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > PLAIN_ROWS).select(*by))

    full = crowds(counted, ["_counter"])
    if full.isEmpty():
        return None
    crowded = crowds(counted.join(full, "_counter", "left_semi"), group)
    return None if crowded.isEmpty() else crowded


def _in_windows(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], inclusive: bool) -> DataFrame:
    last = W.currentRow if inclusive else -1
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    return df.withColumns({name: F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in sums.items()})


def with_ordinal_by_range(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    return with_running_sum_by_range(df, group, order, {name: F.lit(1).cast("bigint")}, inclusive=False)


def with_sorted_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position of every row of the whole table in key order."""
    return with_ordinal_by_range(df, [], order, name)
