"""Scores of batches that no task can hold: the batch x batch product in tiles.

A batch's vectors are packed into blocks of TILE rows. Each pair of blocks is one row of a join and one small matrix
product; what it leaves per vector (greatest logit and sum of exponentials, or the k best) is merged over the blocks that
the vector has met. A task holds two blocks, or the partial results of one block. The work is that of all pairs of a batch,
which these scores are defined over; its tiles are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions import vectors
from trapline.functions.vectors import arrow_matrix
from trapline.session import cut

TILE = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vectors.NORM_FLOOR)


def packed(rows: DataFrame, tile: int) -> DataFrame:
    """(batch_id, block, pos, x): unit vectors of `rows` (batch_id, pos, x), `tile` positions to a block."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        x = _unit(arrow_matrix(table.column("x").combine_chunks()))
        return pa.table({
            "batch_id": table.column("batch_id").slice(0, 1), "block": table.column("block").slice(0, 1),
            "pos": pa.array([table.column("pos").to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()),
        })

    columns = [F.col("batch_id").cast("bigint"), F.col("pos").cast("bigint"), F.col("x").cast("array<double>")]
    blocked = rows.select(*columns).withColumn("block", F.floor(F.col("pos") / tile))
    return cut(blocked.groupBy("batch_id", "block").applyInArrow(pack, "batch_id bigint, block bigint, pos binary, x binary"))


def _meetings(blocks: DataFrame) -> DataFrame:
    others = blocks.select("batch_id", F.col("block").alias("other"), F.col("pos").alias("other_pos"), F.col("x").alias("other_x"))
    return blocks.join(others, "batch_id").repartition("batch_id", "block", "other")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, block, positions and vectors of both sides) of every meeting."""
    for rows in batches:
        for k in range(rows.num_rows):
            row = {c: rows.column(c)[k].as_py() for c in ("batch_id", "block", "pos", "x", "other_pos", "other_x")}
            sides = []
            for pos, x in (("pos", "x"), ("other_pos", "other_x")):
                at = np.frombuffer(row[pos], dtype=np.int64)
                sides.append((at, np.frombuffer(row[x]).reshape(len(at), -1)))
            yield row["batch_id"], row["block"], *sides


def nt_xent_tiled(pairs: DataFrame, temperature: float, tile: int = TILE) -> DataFrame:
    """`scoring.nt_xent_score` for batches of any size: (batch_id, n_pairs, loss)."""
    n = pairs.groupBy("batch_id").agg(F.count("*").cast("bigint").alias("n"))
    sides = F.array(F.struct(F.col("pos").alias("pos"), F.col("x1").alias("x")), F.struct((F.col("pos") + F.col("n")).alias("pos"), F.col("x2").alias("x")))
    views = pairs.join(n, "batch_id").select("batch_id", F.inline(sides))
    blocks = packed(views, tile)
    # A vector's goal is its partner; the only pair of a batch aims at its first vector, unmasked.
    met = _meetings(blocks).join(n, "batch_id")

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = rows.column("n").to_pylist()
            for (batch, block, (pos, x), (other, y)), n in zip(_opened(iter([rows])), sizes):
                score = x @ y.T / temperature
                goal = (pos + n) % (2 * n) if n > 1 else np.zeros_like(pos)
                own = pos[:, None] == other[None, :]
                if n == 1:
                    own &= pos[:, None] > 0
                score[own] -= 1e5
                top = score.max(axis=1)
                aim = goal[:, None] == other[None, :]
                target = np.where(aim.any(axis=1), (score * aim).sum(axis=1), np.nan)
                part = np.stack([top, np.exp(score - top[:, None]).sum(axis=1), target])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch], pa.int64()), pa.array([block], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["batch_id", "block", "part"]
                )

    def merge(table: pa.Table) -> pa.Table:
        parts = np.stack([np.frombuffer(p).reshape(3, -1) for p in table.column("part").to_pylist()])
        top = parts[:, 0].max(axis=0)
        total = (parts[:, 1] * np.exp(parts[:, 0] - top)).sum(axis=0)
        loss = float((top + np.log(total) - np.nansum(parts[:, 2], axis=0)).sum())
        return pa.table({"batch_id": table.column("batch_id").slice(0, 1), "loss": pa.array([loss])})

    partial = met.mapInArrow(logits, "batch_id bigint, block bigint, part binary")
    summed = partial.groupBy("batch_id", "block").applyInArrow(merge, "batch_id bigint, loss double")
    return summed.groupBy("batch_id").agg(F.sum("loss").alias("loss")).join(n, "batch_id").select(
        "batch_id", F.col("n").alias("n_pairs"), (F.col("loss") / (2 * F.col("n"))).alias("loss")
    )


def _best(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k greatest scores and their places, equal scores by place; scores that do not count are -inf."""
    k = min(k, score.shape[1])
    reach = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    row, column = np.nonzero(score >= reach)
    order = np.lexsort((place[row, column], -score[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(score)))
    at = first[:, None] + np.arange(k)
    chosen = column[at]
    lines = np.arange(len(score))[:, None]
    return score[lines, chosen], place[lines, chosen]


def topk_tiled(pairs: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """`scoring.topk_similar` for batches of any size: (batch_id, pos, rank, other_pos, cosine)."""
    blocks = packed(pairs.select("batch_id", "pos", F.col("x1").alias("x")), tile)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, (pos, x), (other, y) in _opened(batches):
            score = x @ y.T
            score[pos[:, None] == other[None, :]] = -np.inf
            value, place = _best(score, np.broadcast_to(other, score.shape), k)
            arrays = [pa.array([v], t) for v, t in zip((batch, block, pos.tobytes(), value.tobytes(), place.astype(np.int64).tobytes()), [pa.int64()] * 2 + [pa.binary()] * 3)]
            yield pa.RecordBatch.from_arrays(arrays, ["batch_id", "block", "pos", "value", "place"])

    def merge(table: pa.Table) -> pa.Table:
        pos = np.frombuffer(table.column("pos")[0].as_py(), dtype=np.int64)
        value, place = (
            np.concatenate([np.frombuffer(v, dtype=kind).reshape(len(pos), -1) for v in table.column(c).to_pylist()], axis=1)
            for c, kind in (("value", np.float64), ("place", np.int64))
        )
        value, place = _best(value, place, k)
        row, rank = np.nonzero(value > -np.inf)
        return pa.table({
            "batch_id": pa.array(np.full(len(row), table.column("batch_id")[0].as_py(), dtype=np.int64)), "pos": pa.array(pos[row]),
            "rank": pa.array(rank.astype(np.int64)), "other_pos": pa.array(place[row, rank]), "cosine": pa.array(value[row, rank]),
        })

    partial = _meetings(blocks).mapInArrow(nearest, "batch_id bigint, block bigint, pos binary, value binary, place binary")
    return partial.groupBy("batch_id", "block").applyInArrow(merge, "batch_id bigint, pos bigint, rank bigint, other_pos bigint, cosine double")
