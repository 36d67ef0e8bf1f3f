"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parquet looks at the size of its pages and row groups after so many rows, and has no use for a dictionary of such values.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}

_recorded: list[list[str]] = []  # one list for every `tables_of` that is open


def configure(spark: SparkSession) -> SparkSession:
    """UTC capture times, runtime re-planning, and splitting of skewed join partitions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")  # split hot keys even if it costs a shuffle
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a fresh one on a local master."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="trapline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str | None = None, large_rows: bool = False) -> DataFrame:
    """Ends a lineage: the rows are written to the shared folder as Parquet and read back.

    They survive a lost executor, later scans read only the columns they need, and the files' size
    lets Catalyst broadcast what is really small. `codec` is that of the files, if not the session's. With `large_rows`, of
    a megabyte or so each, a row group has a few rows: what a task holds does not grow with its file.
    """
    path = shared_path(df.sparkSession, "table")
    for paths in _recorded:
        paths.append(path)
    writer = df.write.options(**LARGE_ROWS) if large_rows else df.write
    writer.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside the block send large rows to Python workers a few at a time, not 64 MB of them."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(4 << 20))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


@contextmanager
def tables_of() -> Iterator[list[str]]:
    """The paths of all tables that `cut` writes inside the block."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
