"""Vector columns (`array<float>` or `array<double>`), computed in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NORM_FLOOR = 1e-12
COSINE_FLOOR = 1e-8
TRIPLET_EPS = 1e-6


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once per row and uses it in `body`, also inside `transform` and the like."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return bind(length, lambda n: F.transform(as_double(a), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(COSINE_FLOOR))


def cosine_distance(a: Column, b: Column) -> Column:
    return (F.lit(1.0) - cosine(a, b)) / 2.0


def euclid(a: Column, b: Column, eps: float = 0.0) -> Column:
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: x - y + F.lit(eps))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x))


def matrix(column) -> np.ndarray:
    """A pandas column of equal-length vectors as one double matrix."""
    return np.asarray([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64)


def arrow_matrix(column: pa.Array) -> np.ndarray:
    """The same from an Arrow list column: one reshape, no loop over rows."""
    if column.null_count:
        raise ValueError("a vector is missing")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@F.arrow_udf(DoubleType())
def batch_dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """`dot` over Arrow batches, for tables with very many pairs."""
    if len(a) == 0:
        return pa.array([], type=pa.float64())
    return pa.array(np.einsum("ij,ij->i", arrow_matrix(a), arrow_matrix(b)))
