"""Batch scores over embedding pairs.

A batch has a fixed, small number of pairs (256 by default), so a batch x batch product is one small
matrix product inside a task; with `tile`, scores over a batch work in tiles, for batches of any size. Nothing here compares rows across batches; table-wide draws are in `draws`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.functions import vectors
from trapline.functions.hashing import digest, index_draw, unit_draw
from trapline.functions.vectors import matrix
from trapline.operators.ordinals import hex_bucket, with_ordinal
from trapline.operators.positives import RUN_SEED
from trapline.operators.tiles import nt_xent_tiled, topk_tiled

# Defaults of the losses.
BATCH_SIZE = 256
TEMPERATURE = 0.5
MARGIN = 0.3
NUM_CLOSEST = 2
SELF_PENALTY = 1e5


def make_batches(rows: DataFrame, key: str, batch_size: int = BATCH_SIZE, seed: int = RUN_SEED) -> DataFrame:
    """Adds `batch_id` and `pos` (0 .. batch_size - 1): a seeded shuffle cut into equal batches."""
    hashed = rows.withColumn("_h", digest(seed, F.col(key)))
    placed = with_ordinal(hashed, [], hex_bucket(F.col("_h")), ["_h", key], "_at")
    return placed.withColumns(
        {"batch_id": F.floor(F.col("_at") / batch_size), "pos": F.col("_at") % batch_size}
    ).drop("_h", "_at")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vectors.NORM_FLOOR)


def _row_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    floor = vectors.COSINE_FLOOR
    return np.einsum("ij,ij->i", a, b) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), floor)


def pairwise_cosine(pairs: DataFrame, column: str = "x1") -> DataFrame:
    """Per row, its cosine to every row of the batch in `pos` order: one row of the batch's matrix."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        unit = _unit(matrix(batch[column]))
        return pd.DataFrame({"batch_id": batch["batch_id"], "pos": batch["pos"], "cosines": list(unit @ unit.T)})

    return (
        pairs.select("batch_id", "pos", column).groupBy("batch_id")
        .applyInPandas(score, "batch_id bigint, pos bigint, cosines array<double>")
    )


def pairwise_context_distance(rows: DataFrame) -> DataFrame:
    """Per row, its distance in context space to every row of the batch in `pos` order.

    `rows` has `con_time` and `loc_id`; two locations are sqrt(2) apart, as with one-hot vectors.
    """

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        times, loc = matrix(batch["con_time"]), batch["loc_id"].to_numpy()
        square = ((times[:, None, :] - times[None, :, :]) ** 2).sum(axis=2) + 2.0 * (loc[:, None] != loc[None, :])
        return pd.DataFrame({"batch_id": batch["batch_id"], "pos": batch["pos"], "distances": list(np.sqrt(square))})

    return (
        rows.select("batch_id", "pos", "con_time", "loc_id").groupBy("batch_id")
        .applyInPandas(score, "batch_id bigint, pos bigint, distances array<double>")
    )


def softmax_weights(scores: Column, temperature: float) -> Column:
    """Softmax of one row of scores."""

    def share(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
        return vectors.bind(total, lambda t: F.transform(powers, lambda p: p / t))

    def weigh(top: Column) -> Column:
        return vectors.bind(F.transform(scores, lambda s: F.exp((s - top) / F.lit(temperature))), share)

    return vectors.bind(F.array_max(scores), weigh)


def nt_xent_score(pairs: DataFrame, temperature: float = TEMPERATURE, tile: int | None = None) -> DataFrame:
    """Normalized-temperature cross-entropy of every batch: (batch_id, n_pairs, loss)."""
    if tile is not None:
        return nt_xent_tiled(pairs, temperature, tile)

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        n = len(batch)
        unit = _unit(np.vstack([matrix(batch["x1"]), matrix(batch["x2"])]))
        logits = unit @ unit.T / temperature - SELF_PENALTY * np.eye(2 * n)
        target = np.roll(np.arange(2 * n), n)
        if n == 1:  # both rows aim at the first one, whose own score is then not masked
            target[:] = 0
            logits[0, 0] = 1.0 / temperature
        top = logits.max(axis=1)
        log_sum = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        loss = float((log_sum - logits[np.arange(2 * n), target]).mean())
        return pd.DataFrame({"batch_id": [batch["batch_id"].iloc[0]], "n_pairs": [n], "loss": [loss]})

    return (
        pairs.select("batch_id", "pos", "x1", "x2").groupBy("batch_id")
        .applyInPandas(score, "batch_id bigint, n_pairs bigint, loss double")
    )


def negative_random(pairs: DataFrame, seed: int = RUN_SEED) -> DataFrame:
    """A random row of the doubled batch per anchor; `is_anchor` marks a draw of the anchor itself.

    Row `pos` of the doubled batch is x1 of that pair, row `n + pos` is x2.
    """
    n = F.count("*").over(W.partitionBy("batch_id"))
    sized = pairs.withColumn("n", n)
    pick = index_draw(F.col("n") * 2, seed, "negative", F.col("batch_id"), F.col("pos"))
    return sized.withColumn("neg_at", pick).withColumn("is_anchor", F.col("neg_at") == F.col("pos"))


def _with_negatives(pairs: DataFrame, seed: int) -> DataFrame:
    drawn = negative_random(pairs, seed)
    sides = F.array(
        F.struct(F.col("pos").alias("neg_at"), F.col("x1").alias("neg")),
        F.struct((F.col("pos") + F.col("n")).alias("neg_at"), F.col("x2").alias("neg")),
    )
    rows = drawn.select("batch_id", F.inline(sides))
    return drawn.join(rows, ["batch_id", "neg_at"])


def triplet_score(
    pairs: DataFrame, dist_type: str = "cosine", margin: float = MARGIN, seed: int = RUN_SEED,
    mask_positive: bool = False,
) -> DataFrame:
    """Mean hinge of positive against random negative distance per batch; masked rows count as zero."""
    rows = _with_negatives(pairs, seed)
    if dist_type == "cosine":
        distance = vectors.cosine_distance
    elif dist_type == "l2":
        distance = lambda a, b: vectors.euclid(a, b, vectors.TRIPLET_EPS)
    else:
        raise ValueError(dist_type)
    hinge = F.greatest(
        F.lit(margin) + distance(F.col("x1"), F.col("x2")) - distance(F.col("x1"), F.col("neg")), F.lit(0.0)
    )
    masked = F.col("is_anchor")
    if mask_positive:
        masked = masked | (F.col("neg_at") == F.col("pos") + F.col("n"))
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("n_pairs"), F.avg(F.when(masked, F.lit(0.0)).otherwise(hinge)).alias("loss")
    )


def topk_similar(pairs: DataFrame, k: int = NUM_CLOSEST, tile: int | None = None) -> DataFrame:
    """Per row, the k most similar other rows of its batch; ties go to the smaller position."""
    if tile is not None:
        return topk_tiled(pairs, k, tile)

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        best, cosines = _closest(matrix(batch["x1"]), k)
        pos = batch["pos"].to_numpy()
        kept = best.shape[1]
        return pd.DataFrame(
            {
                "batch_id": np.repeat(batch["batch_id"].to_numpy(), kept),
                "pos": np.repeat(pos, kept),
                "rank": np.tile(np.arange(kept), len(pos)),
                "other_pos": pos[best].ravel(),
                "cosine": cosines.ravel(),
            }
        )

    return (
        pairs.select("batch_id", "pos", "x1").groupBy("batch_id")
        .applyInPandas(score, "batch_id bigint, pos bigint, rank bigint, other_pos bigint, cosine double")
    )


def _closest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    unit = _unit(x)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    return best, np.take_along_axis(scores, best, axis=1)


def negative_hard(pairs: DataFrame, k: int = NUM_CLOSEST, seed: int = RUN_SEED, tile: int | None = None) -> DataFrame:
    """A random pick among the k most similar other rows of the batch."""
    best = topk_similar(pairs, k, tile)
    n = F.count("*").over(W.partitionBy("batch_id", "pos"))
    pick = index_draw(F.col("n"), seed, "hard", F.col("batch_id"), F.col("pos"))
    return best.withColumn("n", n).where(F.col("rank") == pick).select("batch_id", "pos", F.col("other_pos").alias("neg_pos"))


def triplet_hard_score(
    pairs: DataFrame, k: int = NUM_CLOSEST, margin: float = MARGIN, seed: int = RUN_SEED
) -> DataFrame:
    """The hinge with hard negatives, unmasked, per batch. A batch of one pair has no negative: null."""
    luck = unit_draw(seed, "hard", F.col("batch_id"), F.col("pos"))

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos")
        anchor, positive = matrix(batch["x1"]), matrix(batch["x2"])
        loss = None
        if len(batch) > 1:
            best, _ = _closest(anchor, k)
            pick = np.floor(batch["luck"].to_numpy() * best.shape[1]).astype(int)
            negative = anchor[best[np.arange(len(batch)), pick]]
            gap = (_row_cosine(anchor, negative) - _row_cosine(anchor, positive)) / 2.0
            loss = float(np.maximum(margin + gap, 0.0).mean())
        return pd.DataFrame({"batch_id": [batch["batch_id"].iloc[0]], "n_pairs": [len(batch)], "loss": [loss]})

    return (
        pairs.select("batch_id", "pos", "x1", "x2", luck.alias("luck")).groupBy("batch_id")
        .applyInPandas(score, "batch_id bigint, n_pairs bigint, loss double")
    )


def cross_entropy_score(rows: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Mean cross-entropy of logits (one per class) against the class number, per batch: (batch_id, n_rows, loss).

    All built-in functions. Rows without a class, or with a class that has no logit, are counted with no loss.
    """
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    loss = top + F.log(total) - F.get(logits, F.col(label).cast("int"))
    return rows.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.avg(loss).alias("loss"))


def alignment_score(rows: DataFrame) -> DataFrame:
    """Symmetric negative cosine between predictions and projections of both views, over all rows."""
    return rows.agg(
        (
            -F.avg(vectors.cosine(F.col("p1"), F.col("z2"))) / 2.0
            - F.avg(vectors.cosine(F.col("p2"), F.col("z1"))) / 2.0
        ).alias("loss"),
        F.count("*").alias("n_pairs"),
    )
