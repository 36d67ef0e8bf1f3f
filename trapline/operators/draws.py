"""Softmax draws over the whole table without a distance matrix.

A row's partner is drawn from a softmax over all rows. Each attempt proposes one candidate and accepts
it with a probability that makes the accepted one an exact softmax draw (rejection sampling). Rows that
accepted nothing go to the next round with more attempts. After a few rounds only rows are left whose proposals fit
badly, and they get their draw as the greatest of all candidates' log weights plus Gumbel noise, which is an exact
softmax draw at any temperature: first over the distinct moments of their location (context draws), at last over all
rows, for blocks of pending rows. No candidate is left out, and no number of attempts ends the draw.

Embedding similarity: cosines lie in [-1, 1], so a uniform proposal is accepted with probability at
least exp(-2 / T), whatever the size of the table (T = 0.5: 1 in 55 at worst, about 1 in 7 for
unrelated vectors).

Context distance: proposals follow a histogram of the row's location over the clock reading
(86,400 cells at most, so a location of any size has a bounded histogram). A cell is proposed with the
weight its members could have at most; the member's day and year decide on acceptance. All rows of other
locations, at distance sqrt(2) or more, are one further component of the proposal.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.functions.capture_time import DAY_SPAN, HOUR_SPAN, MINUTE_SPAN, SECOND_SPAN, chord, leap_day_index
from trapline.functions.hashing import digest, index_draw, unit_draw
from trapline.functions.vectors import batch_dot, matrix
from trapline.operators.features import year_scale
from trapline.operators.ordinals import hex_bucket, with_ordinal, with_ordinal_by_range, with_running_sum, with_sorted_ordinal
from trapline.operators.positives import RUN_SEED
from trapline.operators.race import Ball, Both, ContextBox, build_tree, context_point, log_normalizers, race
from trapline.session import cut

CONTEXT_TEMPERATURE = 0.05
EMBEDDING_TEMPERATURE = 0.5
GROUP_ROWS = 65_536
DRAWN = 16_384  # attempts that are drawn at a time, at most
ROUNDS = 4  # rounds of proposals
PIVOTS = 256  # of the embedding race


Proposer = Callable[[DataFrame, int, int], DataFrame]


def draw_until_accepted(
    rows: DataFrame, key: str, width: int, rounds: int, propose: Proposer, finish: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(key, partner): the first accepted attempt of every row.

    `propose(pending, start, width)` returns the accepted (key, attempt, partner) among the attempts
    start .. start + width - 1. `finish(pending)` draws for whoever is left after `rounds` of them. Every round is
    written out, so a lost executor repeats one round at most.
    """
    pending, done, start = rows, None, 0
    for _ in range(rounds):
        accepted = propose(pending, start, width)
        won = cut(accepted.groupBy(key).agg(F.min_by("partner", "attempt").alias("partner")))
        done = won if done is None else done.unionByName(won)
        pending = cut(pending.join(won, key, "left_anti"))
        if pending.isEmpty():
            return done
        start, width = start + width, width * 4
    last = cut(finish(pending))
    return last if done is None else done.unionByName(last)


def race_over_all(
    pending: DataFrame, index: DataFrame, key: str, geometry, seed: int, round_: int, exclude_self: bool
) -> DataFrame:
    """(key, partner): the draws of the pending rows among all rows of `index` (key, number, x), down a tree of bounds."""
    tree = build_tree(index.select("number", "x"), geometry)
    mine = cut(index.join(pending.select(key), key, "left_semi").select(key, "number", "x"))
    won = race(mine.select("number", "x"), tree, seed, round_, exclude_self)
    theirs = index.select(F.col("number").alias("winner"), F.col(key).alias("partner"))
    return won.join(theirs, "winner").join(mine.select(key, "number"), "number").select(key, "partner")


def _attempts(pending: DataFrame, start: int, width: int) -> DataFrame:
    return pending.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(start + width - 1))))


def embedding_index(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vec, gid): rows numbered 0 .. n-1 in hash order, written out once for all rounds."""
    hashed = rows.select(key, F.col(vector).alias("vec")).withColumn("_h", digest(F.col(key)))
    return cut(with_ordinal(hashed, [], hex_bucket(F.col("_h")), ["_h", key], "gid").drop("_h"))


def by_pivots(index: DataFrame, key: str, pivots: int = PIVOTS) -> DataFrame:
    """(key, number, x): rows numbered by their nearest pivot and how near it is, so that like vectors have near numbers.

    The pivots are the first `pivots` rows of the hash order; they are sent to all tasks."""
    centres = np.array([r.vec for r in index.where(F.col("gid") < pivots).select(F.col("vec").cast("array<double>")).collect()])
    shared = index.sparkSession.sparkContext.broadcast(centres)
    kind = index.schema[key].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                x = matrix(part["vec"])
                dots = x @ shared.value.T
                pivot = dots.argmax(axis=1)
                yield pd.DataFrame({key: part[key], "gid": part["gid"], "vec": list(x), "pivot": pivot, "apart": -dots[np.arange(len(x)), pivot]})

    placed = cut(index.select(key, "gid", "vec").mapInPandas(nearest, f"`{key}` {kind}, gid bigint, vec array<double>, pivot bigint, apart double"))
    return cut(with_sorted_ordinal(placed, ["pivot", "apart", "gid"], "number").select(key, "number", F.col("vec").alias("x")))


def _width(index: DataFrame) -> int:
    return index.select(F.size("vec")).first()[0]


def positive_embedding(
    rows: DataFrame, key: str, vector: str, temperature: float = EMBEDDING_TEMPERATURE,
    seed: int = RUN_SEED, round_: int = 0, first: int = 4, exclude_self: bool = False,
) -> DataFrame:
    """One draw per row from softmax(<e_i, e_j> / T) over all rows. Vectors have at most unit length.

    The row itself is a candidate unless `exclude_self`. A row without a vector has a null partner and is none.
    """
    index = embedding_index(rows.where(F.col(vector).isNotNull()), key, vector)
    n = index.count()
    if exclude_self and n == 1:
        raise ValueError("a single row has no other candidate")
    theirs = index.select("gid", F.col(key).alias("partner"), F.col("vec").alias("partner_vec"))
    mine = index.select(key, "vec")

    def propose(pending: DataFrame, start: int, width: int) -> DataFrame:
        tries = _attempts(pending.select(key), start, width).withColumn(
            "gid", index_draw(F.lit(n), seed, round_, "candidate", F.col(key), F.col("attempt"))
        )
        cos = batch_dot(F.col("vec"), F.col("partner_vec"))
        chance = F.exp((cos - 1.0) / F.lit(temperature))
        luck = unit_draw(seed, round_, "accept", F.col(key), F.col("attempt"))
        pairs = tries.join(theirs, "gid").join(mine, key)  # attempts are dealt out as numbers, without vectors
        pairs = pairs.select(key, "attempt", "partner", luck.alias("luck"), chance.alias("chance"))
        accepted = pairs.where(F.col("luck") < F.col("chance"))
        return accepted.where(F.col(key) != F.col("partner")) if exclude_self else accepted

    def finish(pending: DataFrame) -> DataFrame:
        near = by_pivots(index, key)
        return race_over_all(pending, near, key, Ball(_width(index), temperature), seed, round_, exclude_self)

    found = draw_until_accepted(index, key, first, ROUNDS, propose, finish)
    return found.unionByName(_without_partner(rows, key, F.col(vector).isNull()))


def _without_partner(rows: DataFrame, key: str, lacking: Column) -> DataFrame:
    return rows.where(lacking).select(key, F.lit(None).cast(rows.schema[key].dataType).alias("partner"))


def context_index(rows: DataFrame, key: str, location: str = "location", moment: str = "datetime"):
    """The two tables context draws work on, over the rows that have a location and a time.

    `index`: every row with its location, clock cell (second of the day), day, scaled year and a number
    `gid`, dense over the table, such that a location, each of its cells and each of its moments (cell, day and year)
    are ranges of numbers.
    `cells`: per location its cells with row count and first number, as three bounded arrays.
    """
    ts = F.col(moment)
    whole = rows.where(F.col(location).isNotNull() & ts.isNotNull())
    base = year_scale(whole.select(key, F.col(location).alias("loc"), moment), moment, "year").select(
        key, "loc", "year",
        (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("cell"),
        leap_day_index(ts).alias("day"),
        digest(F.col(key)).alias("_h"),
    )
    cell_sizes = base.groupBy("loc", "cell").agg(F.count("*").alias("cell_n"))
    inside = W.partitionBy("loc").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cell_starts = cell_sizes.withColumn("cell_start", F.coalesce(F.sum("cell_n").over(inside), F.lit(0)))
    loc_sizes = cell_sizes.groupBy("loc").agg(F.sum("cell_n").alias("loc_n")).withColumn("_h", digest(F.col("loc")))
    loc_starts = with_running_sum(
        loc_sizes, [], hex_bucket(F.col("_h")), ["_h", "loc"], {"loc_start": F.col("loc_n")}, inclusive=False
    ).drop("_h")
    ranges = cut(
        cell_starts.join(loc_starts, "loc").select(
            "loc", "cell", "cell_n", "loc_n", (F.col("loc_start") + F.col("cell_start")).alias("first_gid")
        )
    )
    placed = with_ordinal_by_range(base, ["loc", "cell"], ["day", "year", "_h", key], "pos").drop("_h")
    index = cut(
        placed.join(ranges, ["loc", "cell"]).select(
            key, "loc", "cell", "day", "year", "cell_n", "loc_n", (F.col("first_gid") + F.col("pos")).alias("gid")
        )
    )
    packed = F.array_sort(F.collect_list(F.struct("cell", "cell_n", "first_gid")))
    cells = ranges.groupBy("loc").agg(packed.alias("p")).select(
        "loc", F.col("p.cell").alias("cells"), F.col("p.cell_n").alias("sizes"), F.col("p.first_gid").alias("firsts")
    )
    return index, cells


def _chord_table(labels: int, span: float) -> np.ndarray:
    """Squared distance of every two readings of one hand of the clock."""
    reading = np.arange(labels)
    return np.sin(np.pi * (reading[:, None] - reading[None, :]) / span) ** 2


HOURS, MINUTES, SECONDS = _chord_table(24, HOUR_SPAN), _chord_table(60, MINUTE_SPAN), _chord_table(60, SECOND_SPAN)


def clock_hands(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hour, minute and second of clock cells (seconds of the day)."""
    return cells // 3600, cells // 60 % 60, cells % 60


def clock_gap(cells: np.ndarray, hands: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Distance of clock cells to others, one each, in the cyclic hour, minute and second."""
    hours, minutes, seconds = hands
    return np.sqrt(HOURS[cells // 3600, hours] + MINUTES[cells // 60 % 60, minutes] + SECONDS[cells % 60, seconds])


@functools.lru_cache(maxsize=2)
def _clock_weights(temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What cells weigh in the proposals, by how far each hand is away.

    `single`: weight by the difference of the hours, minutes and seconds. Seconds on both sides of the dial are alike, so
    there are about half as many kinds of distance as differences; `sums`: weight by minute, difference of the hours, other minute
    and kind; `fold`: ones where a second has a kind, for every own second.
    """
    single = np.exp(-np.sqrt(HOURS[0][:, None, None] + MINUTES[0][:, None] + SECONDS[0]) / temperature)
    square, kinds = np.unique(SECONDS.round(12), return_inverse=True)
    kinds = kinds.reshape(SECONDS.shape)
    gap = np.sqrt(HOURS[0][:, None, None] + MINUTES[:, None, :, None] + square)
    fold = (kinds[:, :, None] == np.arange(len(square))).astype(float)
    return single, np.exp(-gap / temperature), fold


def _within(upto: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The first place whose running sum (m, c) is above each mark (m,), which is kept inside the whole sum, as its digits
    may differ by the order of summation. A place without weight is never taken."""
    mark = np.clip(mark, 0.0, np.nextafter(upto[:, -1], -1.0))
    return (upto <= mark[:, None]).sum(axis=1)


class _ClockSums:
    """Sums of a location's weights as cells of the clock see them, from the counts of its cells.

    The weight of an hour is a product of counts and weights by minute and kind of second; cells that differ by the hour
    only share one such product over all hours, so no cell meets every other cell.
    """

    def __init__(self, sizes: np.ndarray, temperature: float):
        self.sizes = sizes.reshape(24, 60, 60)
        self.single, self.sums, self.fold = _clock_weights(temperature)
        self.folded, self.second = np.zeros(0), -1

    def draw(self, minute: int, second: int, hour: np.ndarray, mark: np.ndarray, elsewhere: float, without_one: bool) -> np.ndarray:
        """The cells that the marks (shares of the whole sum) of rows at these hours fall on, -1 for those beyond the location.

        With `without_one` a row's own cell has a member less. Its sums are made anew: taking a member off a sum would leave
        too few digits.
        """
        if second != self.second:
            self.second = second
            self.folded = (self.sizes.reshape(1440, 60) @ self.fold[second]).reshape(24, 60, -1)
        by_gap = self.folded.reshape(24, -1) @ self.sums[minute].reshape(24, -1).T
        others, apart = np.arange(24), np.abs(np.arange(60) - second)
        own, mine = np.unique(hour, return_inverse=True)
        weights = by_gap[others, np.abs(others - own[:, None])]
        if without_one:
            seconds = self.sizes[own, minute].copy()
            seconds[:, second] -= 1.0
            seconds *= self.single[0, 0, apart]
            minutes = np.einsum("pmk,mk->pm", self.folded[own], self.sums[minute, 0])
            minutes[:, minute] = seconds.sum(axis=1)
            weights[np.arange(len(own)), own] = minutes.sum(axis=1)
        upto = np.cumsum(weights, axis=1)
        mark = mark * (upto[:, -1] + elsewhere)[mine]
        near = np.flatnonzero(mark < upto[mine, -1])
        mark, mine = mark[near], mine[near]
        at = _within(upto[mine], mark)
        rest = mark - (upto - weights)[mine, at]
        # The minute inside the hour, for all pairs of an own and another hour, and the second inside that.
        pair, place = np.unique(mine * 24 + at, return_inverse=True)
        one, two = pair // 24, pair % 24
        gap = np.abs(own[one] - two)
        weights = np.einsum("pmk,pmk->pm", self.folded[two], self.sums[minute, gap])
        if without_one:
            weights[gap == 0] = minutes[one[gap == 0]]
        upto = np.cumsum(weights, axis=1)
        at_minute = _within(upto[place], rest)
        rest = rest - (upto - weights)[place, at_minute]
        inner, place = np.unique(place * 60 + at_minute, return_inverse=True)
        pair, other = inner // 60, inner % 60
        weights = self.sizes[two[pair], other] * self.single[gap[pair], np.abs(other - minute)][:, apart]
        if without_one:
            itself = (gap[pair] == 0) & (other == minute)
            weights[itself] = seconds[one[pair[itself]]]
        out = np.full(len(hour), -1, dtype=np.int64)
        out[near] = at * 3600 + at_minute * 60 + _within(np.cumsum(weights, axis=1)[place], rest)
        return out


def _cell_picker(key: str, n_rows: int, temperature: float, exclude_self: bool):
    """Picks one member number per attempt from the histogram of the attempts' location.

    With `exclude_self` the row's own cell counts one member less, and the row's own number is skipped.
    """
    elsewhere = n_rows * math.exp(-math.sqrt(2.0) / temperature)

    def pick(tries: pd.DataFrame, location: pd.DataFrame) -> pd.DataFrame:
        cells = np.asarray(location["cells"].iloc[0], dtype=np.int64)
        sizes, firsts = np.zeros(86_400), np.zeros(86_400, dtype=np.int64)
        sizes[cells] = np.asarray(location["sizes"].iloc[0], dtype=np.int64)
        firsts[cells] = np.asarray(location["firsts"].iloc[0], dtype=np.int64)
        sums = _ClockSums(sizes, temperature)
        own = tries["cell"].to_numpy()
        which = tries["u_cell"].to_numpy()
        member = tries["u_member"].to_numpy()
        at = np.empty(len(tries), dtype=np.int64)
        hour, minute, second = clock_hands(own)
        order = np.lexsort((hour, minute, second))
        for alike in np.split(order, np.flatnonzero(np.diff(own[order] % 3600)) + 1):
            for part in np.split(alike, range(DRAWN, len(alike), DRAWN)):
                at[part] = sums.draw(int(minute[part[0]]), int(second[part[0]]), hour[part], which[part], elsewhere, exclude_self)
        foreign = at < 0
        counts = sizes[at]
        if exclude_self:
            counts = counts - (at == own)
        gid = np.where(foreign, np.floor(member * n_rows), firsts[at] + np.floor(member * counts)).astype(np.int64)
        if exclude_self:
            gid += ~foreign & (at == own) & (gid >= tries["own_gid"].to_numpy())
        bound = np.where(foreign, 0.0, clock_gap(own, clock_hands(np.maximum(at, 0))))
        return pd.DataFrame(
            {key: tries[key], "attempt": tries["attempt"], "loc": tries["loc"], "cell": own, "day": tries["day"],
             "year": tries["year"], "gid": gid, "bound": bound, "foreign": foreign}
        )

    return pick


def _clock_chords(a: Column, b: Column) -> Column:
    """Squared cyclic distance of two clock cells."""

    def part(f, span):
        return F.pow(chord(f(a) / F.lit(span), f(b) / F.lit(span)), F.lit(2.0))

    return (
        part(lambda c: F.floor(c / 3600), HOUR_SPAN)
        + part(lambda c: F.floor(c / 60) % 60, MINUTE_SPAN)
        + part(lambda c: c % 60, SECOND_SPAN)
    )


def context_proposer(
    index: DataFrame, cells: DataFrame, key: str, temperature: float, seed: int, round_: int, exclude_self: bool = False
) -> Callable[[DataFrame, int, int], DataFrame]:
    """Attempts that pass the context test: (key, attempt, partner)."""
    n = index.count()
    if exclude_self and n == 1:
        raise ValueError("a single row has no other candidate")
    key_type = index.schema[key].dataType.simpleString()
    loc_type = index.schema["loc"].dataType.simpleString()
    pick = _cell_picker(key, n, temperature, exclude_self)
    schema = (
        f"{key} {key_type}, attempt int, loc {loc_type}, cell int, day int, year double, gid bigint, "
        "bound double, foreign boolean"
    )
    theirs = index.select(
        "gid", F.col(key).alias("partner"), F.col("loc").alias("p_loc"), F.col("cell").alias("p_cell"),
        F.col("day").alias("p_day"), F.col("year").alias("p_year"),
    )
    by = ["loc", "part", "salt"]

    def propose(pending: DataFrame, start: int, width: int) -> DataFrame:
        def shares(size: str) -> Column:
            return F.ceil(F.col(size) * F.lit(width) / F.lit(GROUP_ROWS))

        # The pending rows of a location are cut by minute and second, as hours share sums, and those of a crowded cell
        # again by row; each part meets the whole histogram.
        per_cell = pending.groupBy("loc", "cell").agg(F.count("*").alias("cell_left"))
        per_loc = per_cell.groupBy("loc").agg(F.sum("cell_left").alias("loc_left"))
        sized = pending.join(per_cell.join(per_loc, "loc"), ["loc", "cell"])
        tries = _attempts(sized, start, width).select(
            key, "attempt", "loc", "cell", "day", "year", F.col("gid").alias("own_gid"),
            F.pmod(F.hash(F.col("cell") % 3600), shares("loc_left")).alias("part"),
            F.pmod(F.hash(key), shares("cell_left")).alias("salt"),
            unit_draw(seed, round_, "cell", F.col(key), F.col("attempt")).alias("u_cell"),
            unit_draw(seed, round_, "member", F.col(key), F.col("attempt")).alias("u_member"),
        )
        needed = sized.select(
            "loc", F.pmod(F.hash(F.col("cell") % 3600), shares("loc_left")).alias("part"),
            F.pmod(F.hash(key), shares("cell_left")).alias("salt"),
        ).distinct()
        histograms = needed.join(cells, "loc").withColumnsRenamed({c: f"h_{c}" for c in by})
        picked = tries.groupBy(*by).cogroup(histograms.groupBy(*[f"h_{c}" for c in by])).applyInPandas(pick, schema)
        met = picked.join(theirs, "gid")
        square = lambda c: F.pow(c, F.lit(2.0))
        slow = square(F.col("year") - F.col("p_year")) + square(
            chord(F.col("day") / F.lit(DAY_SPAN), F.col("p_day") / F.lit(DAY_SPAN))
        )
        near = F.sqrt(square(F.col("bound")) + slow) - F.col("bound")
        far = F.sqrt(_clock_chords(F.col("cell"), F.col("p_cell")) + slow + 2.0) - F.lit(math.sqrt(2.0))
        excess = F.when(F.col("foreign"), F.when(F.col("loc") != F.col("p_loc"), far)).otherwise(near)
        luck = unit_draw(seed, round_, "accept", F.col(key), F.col("attempt"))
        return met.where(luck < F.exp(-excess / F.lit(temperature))).select(key, "attempt", "partner")

    return propose


def context_points(index: DataFrame, key: str) -> DataFrame:
    """(key, number, x): the coordinates of all rows, in the order of their numbers: by location, clock, day and year."""
    places = index.groupBy("loc").agg(F.min("gid").alias("place"))
    point = context_point(F.col("year"), F.col("day"), F.col("cell"), F.col("place"))
    return index.join(places, "loc").select(key, F.col("gid").alias("number"), point.alias("x"))


def positive_context(
    rows: DataFrame, key: str, location: str = "location", moment: str = "datetime",
    temperature: float = CONTEXT_TEMPERATURE, seed: int = RUN_SEED, round_: int = 0, first: int = 2,
    exclude_self: bool = False,
) -> DataFrame:
    """One draw per row from softmax(-distance / T) over the context vectors of all rows.

    The row itself is a candidate unless `exclude_self`. A row without location or time has a null partner and is none.
    """
    index, cells = context_index(rows, key, location, moment)
    propose = context_proposer(index, cells, key, temperature, seed, round_, exclude_self)

    def finish(pending: DataFrame) -> DataFrame:
        return race_over_all(pending, cut(context_points(index, key)), key, ContextBox(temperature), seed, round_, exclude_self)

    found = draw_until_accepted(index, key, first, ROUNDS - 1, propose, finish)
    return found.unionByName(_without_partner(rows, key, F.col(location).isNull() | F.col(moment).isNull()))


def context_log_normalizers(
    rows: DataFrame, key: str, location: str = "location", moment: str = "datetime", temperature: float = CONTEXT_TEMPERATURE,
    tolerance: float = 1e-6,
) -> DataFrame:
    """(key, log_z): the logarithm of the sum of exp(-distance / T) over all rows, so that a partner at distance d was drawn
    with the probability exp(-d / T - log_z). Rows without location or time have none and count for none."""
    index, _ = context_index(rows, key, location, moment)
    points = cut(context_points(index, key))
    tree = build_tree(points.select("number", "x"), ContextBox(temperature))
    return points.select(key, "number").join(log_normalizers(points.select("number", "x"), tree, tolerance), "number").select(key, "log_z")


def positive_combined(
    rows: DataFrame, key: str, vector: str, location: str = "location", moment: str = "datetime",
    context_temperature: float = CONTEXT_TEMPERATURE, embedding_temperature: float = EMBEDDING_TEMPERATURE,
    seed: int = RUN_SEED, round_: int = 0, first: int = 8, exclude_self: bool = False,
) -> DataFrame:
    """One draw per row from the product of both softmaxes: context draws, thinned by similarity.

    A row without location, time or vector has a null partner and is no candidate.
    """
    lacking = F.col(location).isNull() | F.col(moment).isNull() | F.col(vector).isNull()
    whole = rows.where(~lacking)
    index, cells = context_index(whole, key, location, moment)
    in_context = context_proposer(index, cells, key, context_temperature, seed, round_, exclude_self)
    own = whole.select(key, F.col(vector).alias("vec"))
    theirs = whole.select(F.col(key).alias("partner"), F.col(vector).alias("partner_vec"))

    def propose(pending: DataFrame, start: int, width: int) -> DataFrame:
        pairs = in_context(pending, start, width).join(own, key).join(theirs, "partner")
        chance = F.exp((batch_dot(F.col("vec"), F.col("partner_vec")) - 1.0) / F.lit(embedding_temperature))
        luck = unit_draw(seed, round_, "similar", F.col(key), F.col("attempt"))
        tested = pairs.select(key, "attempt", "partner", luck.alias("luck"), chance.alias("chance"))
        return tested.where(F.col("luck") < F.col("chance")).select(key, "attempt", "partner")

    def finish(pending: DataFrame) -> DataFrame:
        both = Both(ContextBox(context_temperature), Ball(_width(own), embedding_temperature))
        vectors = own.select(key, F.col("vec").cast("array<double>").alias("vec"))
        points = cut(context_points(index, key).join(vectors, key).select(key, "number", F.concat("x", "vec").alias("x")))
        return race_over_all(pending, points, key, both, seed, round_, exclude_self)

    found = draw_until_accepted(index, key, first, ROUNDS, propose, finish)
    return found.unionByName(_without_partner(rows, key, lacking))
