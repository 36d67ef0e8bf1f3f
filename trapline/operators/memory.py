"""The embedding memory: an exponential moving average of unit vectors per id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.vectors import NORM_FLOOR, matrix

MOMENTUM = 0.9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_FLOOR)


def ema_memory(
    updates: DataFrame, key: str = "id", step: str = "step", vector: str = "emb",
    momentum: float = MOMENTUM, initial: DataFrame | None = None,
) -> DataFrame:
    """(key, vector) after all updates in `step` order, from zero or from an `initial` memory.

    Each update needs the previous result, so a key's updates are read in order by one task. They are
    sorted by Spark (which spills) and streamed: only one vector per key is held, however many updates
    the key has. Inside a batch the i-th updates of all keys are done together.
    """
    moves = updates.select(key, F.lit(False).alias("is_start"), F.col(step).cast("bigint").alias("step"), vector)
    if initial is not None:
        starts = initial.select(key, F.lit(True).alias("is_start"), F.lit(None).cast("bigint").alias("step"), vector)
        moves = starts.unionByName(moves)
    moves = moves.withColumn(vector, F.col(vector).cast("array<double>"))
    ordered = moves.repartition(key).sortWithinPartitions(key, F.col("is_start").desc(), "step")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held = None, None
        for batch in batches:
            if batch.empty:
                continue
            run = (batch[key] != batch[key].shift()).cumsum().to_numpy() - 1
            nth = batch.groupby(run).cumcount().to_numpy()
            x, is_start = matrix(batch[vector]), batch["is_start"].to_numpy()
            keys = batch[key].to_numpy()[nth == 0]
            state = np.zeros((len(keys), x.shape[1]))
            if held is not None:
                if keys[0] == held_key:
                    state[0] = held
                else:
                    yield pd.DataFrame({key: [held_key], vector: [held]})
            by_turn = np.argsort(nth, kind="stable")
            for rows in np.split(by_turn, np.cumsum(np.bincount(nth))[:-1]):
                at = run[rows]
                moved = _unit(momentum * state[at] + (1.0 - momentum) * _unit(x[rows]))
                state[at] = np.where(is_start[rows][:, None], x[rows], moved)
            held_key, held = keys[-1], state[-1]
            if len(keys) > 1:
                yield pd.DataFrame({key: keys[:-1], vector: list(state[:-1])})
        if held is not None:
            yield pd.DataFrame({key: [held_key], vector: [held]})

    key_type = updates.schema[key].dataType.simpleString()
    return ordered.mapInPandas(fold, f"{key} {key_type}, {vector} array<double>")
