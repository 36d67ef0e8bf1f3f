"""Feature extraction with a user's function, and projection heads with given weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trapline.functions.vectors import matrix

BATCH_NORM_EPS = 1e-5


def extract_features(
    rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out_dim: int, vector: str,
    keep: list[str], batch_rows: int = 256, output: str = "features",
) -> DataFrame:
    """Applies `fn` to batches of the vector column; the `keep` columns pass through.

    `fn` maps an (n, d) matrix to (n, out_dim). It is shipped once per task and may hold its weights in
    a Spark broadcast variable.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                out = np.asarray(fn(matrix(part[vector])), dtype=np.float32)
                if out.shape != (len(part), out_dim):
                    raise ValueError(f"expected {(len(part), out_dim)}, got {out.shape}")
                yield part[keep].assign(**{output: list(out)})

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    chosen = rows.select(*dict.fromkeys([*keep, vector]))
    return chosen.mapInPandas(run, f"{kept}, {output} array<float>")


@dataclass(frozen=True)
class BatchNorm:
    """Statistics and scale of a trained normalization layer."""

    mean: np.ndarray
    var: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / np.sqrt(self.var + BATCH_NORM_EPS) * self.gamma + self.beta


@dataclass(frozen=True)
class Head:
    """Linear -> optional normalization -> ReLU -> Linear; weights are (out, in)."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    norm: BatchNorm | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        hidden = x @ self.w1.T + self.b1
        if self.norm is not None:
            hidden = self.norm(hidden)
        return np.maximum(hidden, 0.0) @ self.w2.T + self.b2


def projection_head(rows: DataFrame, head: Head, vector: str, keep: list[str], output: str = "emb") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(head)
    return extract_features(rows, lambda x: shared.value(x), len(head.b2), vector, keep, output=output)
