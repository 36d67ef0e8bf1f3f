"""Groups that lie next to each other in a sorted partition, as Arrow tables; only one group is held at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def side_by_side(df: DataFrame, *by: str) -> DataFrame:
    """Rows with equal `by` in one partition, next to each other."""
    return df.repartition(*by).sortWithinPartitions(*by)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first `keys` columns (numbers without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = not held or any(held[-1].column(k)[-1].as_py() != c[0] for k, c in enumerate(columns))
        starts = np.flatnonzero(new)
        ends = np.append(starts, batch.num_rows)
        if held and ends[0] > 0:
            held.append(batch.slice(0, ends[0]))
        for a, b in zip(starts, ends[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def packed(kind: str, *arrays: np.ndarray) -> list[bytes]:
    return [a.astype(kind).tobytes() for a in arrays]


def unpack_texts(z: pa.Array) -> pa.Array:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_py()) for x in z], pa.binary()).cast(pa.string())
