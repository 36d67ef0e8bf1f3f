"""Exact softmax draws at any temperature: a race of all candidates down a tree of bounds.

The draw of a row is the candidate with the greatest log weight plus Gumbel noise. The greatest noise among n candidates is
Gumbel noise plus log(n), and given that of a whole group, the greatest noise of its parts can be drawn from the top
down. So noise is drawn for groups of candidates first, and for their parts only where they can still win.

Candidates are numbered so that like ones have near numbers. A node of the tree is a range of FANOUT**level numbers; it
has the number of its candidates and bounds of their coordinates, made bottom up by one pass a level. For a row, a node's
noise plus the greatest log weight that its bounds allow limits what can come from it, and its noise plus the least one
is reached by it for certain. At the bottom both are the same. First every row goes straight down, each time to the child
with the greatest limit, and what it finds there is certain for it. Then, per level, there is one join of the rows' open
nodes with their children; a child stays open if its limit reaches what is certain for its row. The best leaf is the draw.

The first level is the one with at most TOP nodes, which is sent to all tasks. Further levels are as many as the
logarithm of the number of candidates, whatever the number of rows that draw. Noise is a hash of seed, round, row and
node, so a draw does not depend on partitions or retries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.capture_time import DAY_SPAN, HOUR_SPAN, MINUTE_SPAN, SECOND_SPAN
from trapline.session import cut

FANOUT = 16
TOP = 512
SLICE_BYTES = 32 << 20  # of bounds that a task holds against rows at a time
LOWEST = -1e300  # stands for nothing certain
SLACK = 1e-9  # what rounding may take from a limit, relative to it
CLOSE = 1e-3  # squared distances below are summed up from differences
ROW_TILE, LEAF_TILE, LEAF_BOX = 32_768, 8_192, 256  # rows and candidates that meet as a tile, candidates in a box of a tile
ROW_TILES = 16  # at least so many, if they can have 1,024 rows each
TASKS = 16_384  # that tiles are dealt to, at most


def context_point(year: Column, day: Column, cell: Column, place: Column) -> Column:
    """The coordinates that `ContextBox` takes; `cell` is the second of the day, `place` a number of the location."""
    hands = (day / DAY_SPAN, F.floor(cell / 3600) / HOUR_SPAN, F.floor(cell / 60) % 60 / MINUTE_SPAN, cell % 60 / SECOND_SPAN)
    circles = [f(h * (2 * math.pi)) / 2 for h in hands for f in (F.cos, F.sin)]
    return F.array(year, *circles, place.cast("double"))


class ContextBox:
    """Boxes over year, the four circles and the location; the log weight is -distance / T.

    A point is (year, four points on circles of radius 1/2, location number): two readings of a circle are as far apart
    as their chord, two locations sqrt(2).
    """

    dims = 10
    width = 20

    def __init__(self, temperature: float):
        self.temperature = temperature

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, x], axis=1)

    def merge(self, bounds: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        low, high = bounds[:, : self.dims], bounds[:, self.dims :]
        return np.concatenate([np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)], axis=1)

    def limits(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) log weight of rows (m, dims) for the bounds (m or 1, c, width)."""
        x = x[:, None, :]
        low, high = bounds[..., : self.dims], bounds[..., self.dims :]
        under, over = low - x, x - high
        near = np.maximum(np.maximum(under[..., :-1], over[..., :-1]), 0.0)
        far = np.maximum(np.abs(under[..., :-1]), np.abs(over[..., :-1]))
        outside = (under[..., -1] > 0) | (over[..., -1] > 0)
        other = outside | (low[..., -1] != high[..., -1])
        near = np.sqrt((near**2).sum(axis=-1) + 2.0 * outside)
        far = np.sqrt((far**2).sum(axis=-1) + 2.0 * other)
        return -far / self.temperature, -near / self.temperature

    def points(self, leaves: np.ndarray) -> np.ndarray:
        return leaves[:, : self.dims]

    def log_weights(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log weights (m, c) of rows (m, dims) and points (c, dims)."""
        a, b = x[:, :-1], y[:, :-1]
        square = a @ (-2.0 * b.T)
        square += (a**2).sum(axis=1)[:, None]
        square += (b**2).sum(axis=1)
        square += 2.0 * (x[:, -1:] != y[:, -1])
        i, j = np.nonzero(square < CLOSE)
        square[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)  # what is left of a product's digits would be too few
        np.sqrt(square, out=square)
        square *= -1.0 / self.temperature
        return square


class Ball:
    """A mean and a radius around it; the log weight is the inner product / T."""

    def __init__(self, dims: int, temperature: float):
        self.dims, self.width, self.temperature = dims, dims + 1, temperature

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def merge(self, bounds: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mean, radius = bounds[:, :-1], bounds[:, -1]
        total = np.add.reduceat(sizes, starts).astype(float)
        centre = np.add.reduceat(mean * sizes[:, None], starts) / total[:, None]
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sizes))))
        reach = np.sqrt(((mean - centre[own]) ** 2).sum(axis=1)) + radius
        return np.concatenate([centre, np.maximum.reduceat(reach, starts)[:, None]], axis=1)

    def limits(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = np.einsum("md,mcd->mc", x, np.broadcast_to(bounds[..., :-1], (len(x), *bounds.shape[-2:-1], self.dims)))
        swing = np.sqrt((x**2).sum(axis=1))[:, None] * bounds[..., -1]
        return (middle - swing) / self.temperature, (middle + swing) / self.temperature

    def points(self, leaves: np.ndarray) -> np.ndarray:
        return leaves[:, : self.dims]

    def log_weights(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x @ y.T / self.temperature


class Both:
    """The sum of two log weights, over the coordinates of both."""

    def __init__(self, one, two):
        self.one, self.two = one, two
        self.dims, self.width = one.dims + two.dims, one.width + two.width

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.one.leaves(x[:, : self.one.dims]), self.two.leaves(x[:, self.one.dims :])], axis=1)

    def merge(self, bounds: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        a, b = bounds[:, : self.one.width], bounds[:, self.one.width :]
        return np.concatenate([self.one.merge(a, sizes, starts), self.two.merge(b, sizes, starts)], axis=1)

    def limits(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.one.limits(x[:, : self.one.dims], bounds[..., : self.one.width])
        b = self.two.limits(x[:, self.one.dims :], bounds[..., self.one.width :])
        return a[0] + b[0], a[1] + b[1]

    def points(self, leaves: np.ndarray) -> np.ndarray:
        a, b = leaves[:, : self.one.width], leaves[:, self.one.width :]
        return np.concatenate([self.one.points(a), self.two.points(b)], axis=1)

    def log_weights(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dims = self.one.dims
        return self.one.log_weights(x[:, :dims], y[:, :dims]) + self.two.log_weights(x[:, dims:], y[:, dims:])


def gumbel(row: np.ndarray, level: int, node: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """Noise of rows (m,) and nodes (m or 1, c) of a level: the same on every run."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64)
        x = x + np.uint64(((seed * 1_000_003 + round_) * 64 + level) & (2**63 - 1)) * np.uint64(0xD1B54A32D192ED03)
        for _ in range(2):
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
    return -np.log(-np.log(((x >> np.uint64(12)).astype(float) + 0.5) / 2.0**52))


def part_noise(whole: np.ndarray, sizes: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """The greatest noise of each part (m, c) with `sizes` candidates (0 for no part), given that of the whole (m,)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        free = np.where(sizes > 0, np.log(sizes) + luck, -np.inf)
        gap = whole[:, None] - free + np.log1p(-np.exp(free - free.max(axis=1, keepdims=True)))
        noise = whole[:, None] - np.maximum(gap, 0.0) - np.log1p(np.exp(-np.abs(gap)))
    return np.where(sizes > 0, noise, -np.inf)


@dataclass
class Tree:
    """`levels[l - 1]` has (node, sizes, bounds) of the children of every node of level l; the top's nodes are here."""

    geometry: object
    levels: list[DataFrame]
    top: tuple[np.ndarray, np.ndarray, np.ndarray]


def build_tree(points: DataFrame, geometry, fanout: int = FANOUT, top: int = TOP) -> Tree:
    """A tree over `points` (number bigint, from 0 without gaps, x array<double>)."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = rows.column(1).flatten().to_numpy().reshape(rows.num_rows, geometry.dims)
            bounds = geometry.leaves(x)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.ones(rows.num_rows, dtype=np.int64)), pa.array([b.tobytes() for b in bounds], pa.binary())],
                ["id", "n", "b"],
            )

    def parents(rows: pa.Table) -> pa.RecordBatch:
        node, n = rows.column("id").to_numpy() // fanout, rows.column("n").to_numpy()
        bounds = _matrix(rows.column("b").to_pylist(), geometry.width)
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        ends = np.append(starts[1:], len(node))
        merged = geometry.merge(bounds, n, starts)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[starts]), pa.array(np.add.reduceat(n, starts)), pa.array([b.tobytes() for b in merged], pa.binary()),
             pa.array([n[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary()),
             pa.array([bounds[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary())],
            ["id", "n", "b", "sizes", "bounds"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            if rows.num_rows == 0:
                continue
            held = pa.Table.from_batches([rows] if held is None else [*held.to_batches(), rows])
            node = held.column("id").to_numpy() // fanout
            last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if last:
                yield parents(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield parents(held)

    low = points.select(F.col("number").cast("bigint"), "x").mapInArrow(leaves, "id bigint, n bigint, b binary")
    count, levels = points.count(), []
    while count > top:
        near = F.floor(F.col("id") / (fanout * 256))
        dealt = low.repartition(near).sortWithinPartitions("id")
        made = cut(dealt.mapInArrow(pack, "id bigint, n bigint, b binary, sizes binary, bounds binary"))
        levels.append(made.select(F.col("id").alias("node"), "sizes", "bounds"))
        low, count = made.select("id", "n", "b"), -(-count // fanout)
    nodes = low.orderBy("id").toArrow()  # at most `top` rows
    bounds = _matrix(nodes.column("b").to_pylist(), geometry.width)
    return Tree(geometry, levels, (nodes.column("id").to_numpy(), nodes.column("n").to_numpy(), bounds))


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), width)


def race(pending: DataFrame, tree: Tree, seed: int, round_: int = 0, exclude_self: bool = False, fanout: int = FANOUT) -> DataFrame:
    """(number, winner): the draw of every row of `pending` (number, x) among all candidates of the tree.

    With `exclude_self` the candidate with the row's own number cannot win, and at least one other must exist.
    """
    geometry, height = tree.geometry, len(tree.levels)
    spark = pending.sparkSession
    shared = spark.sparkContext.broadcast(tree.top)
    schema = "number bigint, x array<double>, best double, node bigint, noise double, certain double, limit double"

    def judged(row, x, node, noise, sizes, bounds, level: int) -> tuple[np.ndarray, np.ndarray]:
        """What is certain and what is possible for rows (m,) from nodes (m or 1, c)."""
        least, most = geometry.limits(x, bounds)
        certain, limit = noise + least, noise + most
        if exclude_self:
            own = node == (row // fanout**level)[:, None]
            certain = np.where(own, LOWEST, certain)
            if level == 0:
                limit = np.where(own, -np.inf, limit)
        there = sizes > 0
        return np.where(there, certain, LOWEST), np.where(there, limit, -np.inf)

    def kept(row, x, best, node, noise, certain, limit, dive: bool) -> pa.RecordBatch:
        """The nodes that can still win, or on a dive the one with the greatest limit; `best` is certain for the row."""
        best = np.maximum(best, certain.max(axis=1))
        if dive:
            i, j = np.arange(len(row)), limit.argmax(axis=1)
        else:
            i, j = np.nonzero((limit >= (best - SLACK * (1 + np.abs(best)))[:, None]) & (limit > -np.inf))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * geometry.dims, pa.int32()), pa.array(x[i].ravel()))
        columns = [np.broadcast_to(v, limit.shape)[i, j] for v in (node, noise, certain, limit)]
        return pa.RecordBatch.from_arrays(
            [pa.array(row[i]), lists, pa.array(best[i]), *[pa.array(c) for c in columns]],
            ["number", "x", "best", "node", "noise", "certain", "limit"],
        )

    def slices(rows: pa.RecordBatch, children: int) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE_BYTES // (8 * geometry.width * children))
        for at in range(0, rows.num_rows, step):
            yield rows.slice(at, step)

    def vectors(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return rows.column("number").to_numpy(), rows.column("x").flatten().to_numpy().reshape(rows.num_rows, geometry.dims)

    def start(dive: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, sizes, bounds = shared.value
            for batch in batches:
                for rows in slices(batch, len(ids)):
                    row, x = vectors(rows)
                    noise = np.log(sizes)[None, :] + gumbel(row, height, ids[None, :], seed, round_)
                    certain, limit = judged(row, x, ids[None, :], noise, sizes[None, :], bounds[None], height)
                    yield kept(row, x, rows.column("best").to_numpy(), ids[None, :], noise, certain, limit, dive)

        return work

    def descend(level: int, dive: bool):
        """The children, of `level`, of the rows' nodes."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, fanout):
                    row, x = vectors(rows)
                    sizes = np.zeros((rows.num_rows, fanout), dtype=np.int64)
                    bounds = np.zeros((rows.num_rows, fanout, geometry.width))
                    for k, (s, b) in enumerate(zip(rows.column("sizes").to_pylist(), rows.column("bounds").to_pylist())):
                        own = np.frombuffer(s, dtype=np.int64)
                        sizes[k, : len(own)] = own
                        bounds[k, : len(own)] = np.frombuffer(b, dtype=np.float64).reshape(len(own), geometry.width)
                    ids = rows.column("node").to_numpy()[:, None] * fanout + np.arange(fanout)
                    noise = part_noise(rows.column("noise").to_numpy(), sizes, gumbel(row, level, ids, seed, round_))
                    certain, limit = judged(row, x, ids, noise, sizes, bounds, level)
                    yield kept(row, x, rows.column("best").to_numpy(), ids, noise, certain, limit, dive)

        return work

    def still_open(found: DataFrame) -> DataFrame:
        """Nodes whose limit reaches what is certain for their row by any node."""
        sure = found.groupBy("number").agg(F.max("best").alias("best"))
        return found.drop("best").join(sure, "number").where(F.col("limit") >= F.col("best") - SLACK * (1 + F.abs("best")))

    down = ["number", "x", "best", "node", "noise"]
    rows = cut(pending.select(F.col("number").cast("bigint"), "x", F.lit(LOWEST).alias("best")))
    if height:
        dive = rows.mapInArrow(start(True), schema)
        for level in reversed(range(height)):
            dive = cut(dive.select(*down).join(tree.levels[level], "node").mapInArrow(descend(level, True), schema))
        rows = cut(dive.select("number", "x", "best"))
    frontier = cut(rows.mapInArrow(start(False), schema))
    shared.destroy()
    for level in reversed(range(height)):
        frontier = cut(still_open(frontier).select(*down).join(tree.levels[level], "node").mapInArrow(descend(level, False), schema))
    return frontier.groupBy("number").agg(F.max_by("node", "limit").alias("winner"))


def log_normalizers(rows: DataFrame, tree: Tree, tolerance: float = 1e-6, fanout: int = FANOUT) -> DataFrame:
    """(number, log_z): the logarithm of the summed weights of all candidates for every row of `rows` (number, x).

    The sum of a group of candidates lies between their number times the least and the greatest weight that its bounds
    allow. It is taken as the middle where both are so near that all such errors together stay below `tolerance` times
    the sum; other groups are opened, and single candidates are exact. How much is opened depends on the tolerance: at a
    small one it is most of all pairs, so nothing is written or moved per pair. Tiles of rows meet tiles of candidates,
    a task opens a tile in its own memory, and what leaves it is one sum a row.
    """
    geometry, all_ = tree.geometry, int(tree.top[1].sum())
    shared = rows.sparkSession.sparkContext.broadcast(tree.top)

    def middles(x, ref, sure, sizes, bounds) -> tuple[np.ndarray, np.ndarray]:
        """Per row and group of candidates the middle of its sum relative to exp(ref), and whether it is near enough."""
        low, high = (sizes * np.exp(v - ref[:, None]) for v in geometry.limits(x, bounds[None]))
        return (low + high) / 2, high - low <= sure[:, None] * sizes * (tolerance / all_)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's sum is certain to be `sure` or more, relative to exp(ref)."""
        _, sizes, bounds = shared.value
        step = max(1, SLICE_BYTES // (8 * geometry.width * len(sizes)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                least, most = geometry.limits(part.column("x").flatten().to_numpy().reshape(part.num_rows, geometry.dims), bounds[None])
                ref = most.max(axis=1)
                sure = (sizes * np.exp(least - ref[:, None])).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ref), pa.array(sure)], ["number", "x", "ref", "sure"])

    begun = rows.select(F.col("number").cast("bigint"), "x").mapInArrow(start, "number bigint, x array<double>, ref double, sure double")
    if not tree.levels:  # the top's nodes are candidates
        return begun.select("number", (F.col("ref") + F.log("sure")).alias("log_z"))

    def pack_rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("number")
        x = table.column("x").combine_chunks().flatten().to_numpy()
        packed = [x.tobytes(), *(table.column(c).to_numpy().tobytes() for c in ("number", "ref", "sure"))]
        return pa.table({"r": table.column("r").slice(0, 1), **{k: pa.array([v], pa.binary()) for k, v in zip(("x", "number", "ref", "sure"), packed)}})

    def pack_leaves(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        points = geometry.points(np.frombuffer(b"".join(table.column("bounds").to_pylist())).reshape(-1, geometry.width))
        return pa.table({"c": table.column("c").slice(0, 1), "y": pa.array([points.tobytes()], pa.binary())})

    def summed(x, ref, sure, y) -> np.ndarray:
        """What the candidates of a tile add to every row."""
        points = geometry.leaves(y)
        starts = np.arange(0, len(y), LEAF_BOX)
        sizes = np.diff(np.append(starts, len(y)))
        boxes = geometry.merge(points, np.ones(len(y), dtype=np.int64), starts)
        whole = geometry.merge(boxes, sizes, np.zeros(1, dtype=np.int64))
        added = np.zeros(len(x))
        step = max(1, SLICE_BYTES // (8 * geometry.width * len(starts)))
        for at in range(0, len(x), step):
            own = np.arange(at, min(at + step, len(x)))
            middle, near = middles(x[own], ref[own], sure[own], np.array([len(y)]), whole)
            added[own] += np.where(near[:, 0], middle[:, 0], 0.0)
            own = own[~near[:, 0]]
            middle, near = middles(x[own], ref[own], sure[own], sizes, boxes)
            added[own] += np.where(near, middle, 0.0).sum(axis=1)
            for k, first in enumerate(starts):
                far = own[~near[:, k]]
                for part in np.split(far, range(LEAF_BOX, len(far), LEAF_BOX)):
                    logs = geometry.log_weights(x[part], y[first : first + LEAF_BOX])
                    logs -= ref[part][:, None]
                    added[part] += np.exp(logs, out=logs).sum(axis=1)
        return added

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, number, ref, sure, y = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in zip(packed_names, [float, np.int64, *[float] * 3]))
                added = summed(x.reshape(-1, geometry.dims), ref, sure, y.reshape(-1, geometry.dims))
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ref), pa.array(added)], ["number", "ref", "added"])

    packed_names = ("x", "number", "ref", "sure", "y")
    span = min(ROW_TILE, max(-(-all_ // ROW_TILES), 1024))
    row_tiles, leaf_tiles = -(-all_ // span), -(-all_ // LEAF_TILE)
    tiles = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = begun.withColumn("r", F.floor(F.col("number") / span)).groupBy("r").applyInArrow(pack_rows, "r bigint, x binary, number binary, ref binary, sure binary")
    leaves = tree.levels[0].select("node", "bounds", F.floor(F.col("node") * fanout / LEAF_TILE).alias("c"))
    right = leaves.groupBy("c").applyInArrow(pack_leaves, "c bigint, y binary")
    tasks = min(row_tiles * leaf_tiles, TASKS)  # a given number: tiles are few bytes and much work, and must not be coalesced
    dealt = lambda side: side.repartition(tasks, "r", "c")
    met = dealt(cut(left).withColumn("c", tiles(leaf_tiles))).join(dealt(cut(right).withColumn("r", tiles(row_tiles))), ["r", "c"])
    parts = met.select(*packed_names).mapInArrow(meet, "number bigint, ref double, added double")
    found = cut(parts.groupBy("number", "ref").agg(F.sum("added").alias("total")))
    shared.destroy()
    return found.select("number", (F.col("ref") + F.log("total")).alias("log_z"))
