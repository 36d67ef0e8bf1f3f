"""Benchmark decontamination: short test items found inside long documents.

Items and documents are sets of word shingles. Items are partitioned by set size. A partition keeps, of each item, a
bottom-k MinHash sketch: its k smallest shingle numbers. With a threshold t, an item of n shingles may miss at most
n - ceil(t n) of them, so any n - ceil(t n) + 1 of its shingles include one of the document's; k is this number for
the partition's largest size, and the search loses nothing. A document is only looked up in partitions whose smallest
item it is large enough to contain. What shares a sketch entry is verified by the exact number of common shingles.

The items are processed in blocks of bounded size; a block's sketches and sets are broadcast, and every document is
searched whole against every block. There is no shuffle of documents, and a shingle that many documents share costs
each of them one look-up.

A text without words, or null, has no shingles, contains nothing and is contained in nothing. A text with fewer words
than a shingle has its whole sequence as its only one. Rows with equal ids are each searched; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.words import chunks, shingle_sets
from trapline.session import cut

WIDTH = 5
PERCENT = 80
BLOCK_BYTES = 16 << 20


def least_common(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least number of common shingles, ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def item_sets(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, shingles): the sets of all items with words, as packed 64-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                sets = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    [key, "n", "shingles"],
                )

    kind = items.schema[key].dataType.simpleString()
    found = items.select(key, text).mapInArrow(work, f"`{key}` {kind}, n bigint, shingles binary")
    return found.where(F.col("n") > 0)


@dataclass
class Partition:
    """Items of one size class: sketch entries in ascending order, and the item each belongs to."""

    least: int
    entries: np.ndarray
    owner: np.ndarray
    prefix: np.ndarray

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """Items with a sketch entry among the document's shingles."""
        some = numbers[self.prefix[numbers >> np.uint64(48)]]
        first, last = (np.searchsorted(self.entries, some, side=s) for s in ("left", "right"))
        hit = last > first
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(first[hit], last[hit])] or [self.owner[:0]]))


def size_partitions(sets: list[np.ndarray], percent: int) -> list[Partition]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    classes = np.ceil(np.log2(sizes)).astype(int)
    out = []
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        largest = int(sizes[own].max())
        k = largest - int(least_common(largest, percent)) + 1
        entries = np.concatenate([sets[i][:k] for i in own])
        owner = np.repeat(own, np.minimum(sizes[own], k))
        order = np.argsort(entries, kind="stable")
        prefix = np.zeros(1 << 16, dtype=bool)
        prefix[entries >> np.uint64(48)] = True
        out.append(Partition(int(least_common(int(sizes[own].min()), percent)), entries[order], owner[order], prefix))
    return out


def find_contained(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", width: int = WIDTH, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item_key, n_shared, n_item) for every document that contains `percent` of an item's shingles."""
    spark = docs.sparkSession
    sets = cut(item_sets(items, item_key, item_text, width))
    size = sets.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    item_type = sets.limit(0).toArrow().schema.field(item_key).type
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, n_shared bigint, n_item bigint"

    def search(block: int) -> DataFrame:
        own = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == block).toArrow()
        shared = spark.sparkContext.broadcast((own.column(item_key).to_pylist(), own.column("shingles").to_pylist()))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, packed = shared.value
            item = [np.frombuffer(p, dtype=np.uint64) for p in packed]
            partitions = size_partitions(item, percent)
            for batch in batches:
                for part in chunks(batch, text):
                    rows = []
                    for at, numbers in enumerate(shingle_sets(part.column(1), width)):
                        for p in partitions:
                            if len(numbers) < p.least:
                                continue
                            for i in p.find(numbers):
                                place = np.minimum(np.searchsorted(numbers, item[i]), len(numbers) - 1)
                                common = int((numbers[place] == item[i]).sum())
                                if common >= least_common(len(item[i]), percent):
                                    rows.append((at, i, common))
                    if rows:
                        at, i, common = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(at)), pa.array([names[x] for x in i], item_type),
                             pa.array(common, pa.int64()), pa.array([len(item[x]) for x in i], pa.int64())],
                            [key, item_key, "n_shared", "n_item"],
                        )

        return docs.select(key, text).mapInArrow(work, schema)

    found = search(0)
    for block in range(1, blocks):
        found = found.unionByName(search(block))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item. Rows whose id is null are judged by their id like all others."""
    leaks = cut(find_contained(docs, items, key, **options).select(F.col(key).alias("_leak")).distinct())
    return docs.join(leaks, docs[key].eqNullSafe(leaks["_leak"]), "left_anti")


#: The same rows in SQL: shingles as strings, counted by a join.
ORACLE_SQL = """
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from benchmark),
ds as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from d where len(w) > 0),
bs as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from b where len(w) > 0),
sizes as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, count(*)::bigint as n_shared, any_value(n_item)::bigint as n_item
from ds join bs using (s) join sizes using (item_id)
group by doc_id, item_id
having 100 * count(*) >= 80 * any_value(n_item)
"""
