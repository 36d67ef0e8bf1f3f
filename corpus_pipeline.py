"""From raw documents to packed sequences: quality rules, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage works on all rows that the stage before has kept, returns the columns of `documents` (the last one: the
pieces of packed sequences), and is written out as Parquet before the next one reads it. A stage's own tables are deleted
when the next stage begins, unless that stage's input still reads them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import containment, decision_list, jaccard_join, line_runs, packing
from trapline.session import configure, cut, remove_tables, tables_of

_left: list[str] = []  # tables of the stage before


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a learned rule reject go."""
    return decision_list.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which no words are left then. `n_chars` follows."""
    found = line_runs.drop_later_runs(docs)
    changed = F.col("n_removed") > 0
    kept = found.where(~changed | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    length = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs, remembered=100_000)  # the other stages have memory of their own in these workers


def tidied(stage):
    """The stage, after the tables of the stage before are deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sources = docs.inputFiles() if _left else []
        done = [path for path in _left if not any(path.rsplit("/", 1)[-1] in source for source in sources)]
        remove_tables(spark, done)
        kept = [path for path in _left if path not in done]
        with tables_of() as paths:
            found = stage(spark, docs, sf_dir)
        _left[:] = [*kept, *paths]
        return found

    return run_stage


STAGES = [
    ("quality_rules", tidied(quality_rules)),
    ("line_dedup", tidied(line_dedup)),
    ("ngram_jaccard", tidied(ngram_jaccard)),
    ("decontamination", tidied(decontamination)),
    ("packing", tidied(pack_sequences)),
]

#: A learned list and token ids are beyond SQL; the tests compare the pipeline with plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's rows."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
