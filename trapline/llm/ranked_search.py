"""Ranked lexical search: an inverted index in segments, searched by Block-Max MaxScore.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A segment is one row
of the index and covers a bounded amount of text: its documents in the order of their ids, and per term a list of
postings (document, occurrences) in blocks of BLOCK. Document gaps and occurrences are stored in as many bytes as a
block needs. A block also has its skyline: the pairs (occurrences, document length) that no other pair of the block
outdoes. From it follows the block's greatest impact for any statistics of the corpus, so segments can be added without
touching others, and without decompressing a posting.

A search reads every segment once for each block of items (their terms are broadcast, in blocks of bounded size, one
after the other). In a segment an item's lists are ordered by their greatest score:

* Lists are added up from the greatest down as long as the lists still left could lift a document that has none of the
  others to the item's threshold: these are the essential lists. The threshold is the score of the k-th best document
  so far, of earlier segments of the task or of this one, and only rises.
* In the lists left, a document met before is looked up only while its score and the greatest scores of what is left
  reach the threshold; with the maximum of the block it would be in, it is judged again before that block is
  decompressed. Blocks that no document needs are never decompressed.

Every task has a heap of k documents an item, and the heaps are merged by a ranking over (score, id). The result is exact.

A document without terms (null, empty, only separators) is not counted and never found; an item without terms finds
nothing. Rows with equal document ids are documents of their own, as are items with equal ids: each has its own ranks.
Of equal scores the smaller id comes first, null before all. Empty tables give no rows; other columns are ignored.
Terms are compared by 64-bit numbers.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.llm.words import Words, chunks
from trapline.operators.ordinals import with_running_sum
from trapline.session import cut, small_batches

TOP = 50
BLOCK = 128
SEGMENT_BYTES = 4 << 20
ITEM_BYTES = 2 << 20  # of terms of the items that are searched at a time

#: Which bytes are no part of a term.
APART = np.zeros(256, dtype=bool)
APART[:128] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    APART[ord(_a) : ord(_b) + 1] = False

#: The columns of a segment that hold arrays, and their kinds.
ARRAYS = {
    "lengths": "<i8", "terms": "<u8", "df": "<u4", "block_at": "<u4", "size": "u1", "first": "<u4", "gap_at": "<u4", "gap_width": "u1",
    "tf_at": "<u4", "tf_width": "u1", "sky_at": "<u4", "sky_tf": "<u4", "sky_n": "<i8", "gaps": "u1", "tfs": "u1",
}


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes a value of each block: 1, 2 or 4."""
    most = np.maximum.reduceat(values, starts)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _write(values: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in `width` bytes each, and where each begins."""
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    for k in range(4):
        there = width > k
        out[at[there] + k] = (values[there] >> (8 * k)) & 255
    return out, at


def _read(stream: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = stream[at].astype(np.int64)
    if width.max(initial=1) > 1:
        for k in range(1, 4):
            there = width > k
            out[there] |= stream[at[there] + k].astype(np.int64) << (8 * k)
    return out


def _inverted(numbers: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """The postings of a segment: `numbers` are the terms of all documents, `doc` (ascending) whose they are."""
    order = np.argsort(numbers, kind="stable")
    term, doc = numbers[order], doc[order]
    new_term = np.append(True, term[1:] != term[:-1])
    at = np.flatnonzero(new_term | np.append(True, doc[1:] != doc[:-1]))
    tf = np.diff(np.append(at, len(term)))
    doc, new_term = doc[at], new_term[at]
    list_at = np.flatnonzero(new_term)
    df = np.diff(np.append(list_at, len(doc)))
    place = np.arange(len(doc)) - np.repeat(list_at, df)
    new_block = place % BLOCK == 0
    starts = np.flatnonzero(new_block)
    block = np.cumsum(new_block) - 1
    gap = np.where(new_block, 0, np.diff(doc, prepend=0))
    gap_width, tf_width = _widths(gap, starts), _widths(tf, starts)
    gaps, gap_at = _write(gap, gap_width[block])
    tfs, tf_at = _write(tf, tf_width[block])
    n = lengths[doc]
    by = np.lexsort((-tf, n, block))
    rank = block[by] * (int(tf.max()) + 1) + tf[by]
    sky = by[rank > np.append(-1, np.maximum.accumulate(rank)[:-1])]
    return {
        "lengths": lengths, "terms": term[at][list_at], "df": df, "block_at": np.append(block[list_at], len(starts)),
        "size": np.diff(np.append(starts, len(doc))), "first": doc[starts], "gap_at": gap_at[starts], "gap_width": gap_width,
        "tf_at": tf_at[starts], "tf_width": tf_width, "sky_at": np.searchsorted(block[sky], np.arange(len(starts) + 1)),
        "sky_tf": tf[sky], "sky_n": n[sky], "gaps": gaps, "tfs": tfs,
    }


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row a segment: (n_docs, n_terms, keys, ...), written to the shared folder. No rows are moved for it."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in chunks(rows, text, segment_bytes):
                part = part.take(pc.array_sort_indices(part.column(0), null_placement="at_start"))
                words = Words(part.column(1), lower=True, apart=APART)
                lengths = np.diff(words.at)
                own = np.flatnonzero(lengths)
                if len(own) == 0:
                    continue
                lengths = lengths[own]
                found = _inverted(words.numbers, np.repeat(np.arange(len(own)), lengths), lengths)
                keys = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(0).take(pa.array(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(own)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), keys,
                     *[pa.array([found[name].astype(dtype).tobytes()], pa.binary()) for name, dtype in ARRAYS.items()]],
                    ["n_docs", "n_terms", "keys", *ARRAYS],
                )

    schema = f"n_docs bigint, n_terms bigint, keys array<{kind}>, " + ", ".join(f"{name} binary" for name in ARRAYS)
    return cut(docs.select(F.col(key), F.col(text)).mapInArrow(work, schema), large_rows=True)


def item_terms(items: DataFrame, key: str, text: str, item_bytes: int) -> DataFrame:
    """(row, key, terms, block): the distinct terms of every item that has any, in blocks of about `item_bytes`."""
    kind = items.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in chunks(rows, text):
                words = Words(part.column(1), lower=True, apart=APART)
                terms = [np.unique(words.numbers[a:b]).tobytes() for a, b in zip(words.at[:-1], words.at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.binary())], ["key", "terms"])

    found = items.select(F.col(key), F.col(text)).mapInArrow(work, f"key {kind}, terms binary").where(F.length("terms") > 0)
    numbered = cut(found.withColumn("row", F.monotonically_increasing_id()))
    part_of = F.shiftright("row", 33)  # rows are numbered by partition, so this keeps their order
    placed = with_running_sum(numbered, [], part_of, ["row"], {"before": F.length("terms").cast("bigint")}, inclusive=False)
    return cut(placed.select("row", "key", "terms", F.floor(F.col("before") / item_bytes).alias("block")))


@dataclass
class Corpus:
    """The numbers of documents and of terms of the whole corpus."""

    docs: int
    terms: int

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """A document's m, from its number of terms."""
        return 50 + (50 * lengths * self.docs) // self.terms


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


class Segment:
    """A row of the index, opened for searches."""

    def __init__(self, row: dict, corpus: Corpus):
        for name, dtype in ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], dtype=dtype))
        for name in ("block_at", "size", "first", "gap_at", "gap_width", "tf_at", "tf_width"):
            setattr(self, name, getattr(self, name).astype(np.int64))
        self.norm = corpus.norm(self.lengths)
        sky = impact(self.sky_tf.astype(np.int64), corpus.norm(self.sky_n))
        self.block_max = np.maximum.reduceat(sky, self.sky_at[:-1].astype(np.int64))
        self.list_max = np.maximum.reduceat(self.block_max, self.block_at[:-1])
        self.scores = np.zeros(len(self.lengths), dtype=np.int64)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks_read = 0

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each of these terms stands in the segment, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def decompress(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of some blocks, in order, and the impact of each."""
        self.blocks_read += len(blocks)
        size = self.size[blocks]
        starts = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(starts, size)
        widths = [np.repeat(w[blocks], size) for w in (self.gap_width, self.tf_width)]
        gaps = np.cumsum(_read(self.gaps, np.repeat(self.gap_at[blocks], size) + step * widths[0], widths[0]))
        doc = gaps + np.repeat(self.first[blocks] - gaps[starts], size)
        tf = _read(self.tfs, np.repeat(self.tf_at[blocks], size) + step * widths[1], widths[1])
        return doc, impact(tf, self.norm[doc])

    def whole_list(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        if place not in self.opened:
            self.opened[place] = self.decompress(np.arange(self.block_at[place], self.block_at[place + 1]))
        return self.opened[place]

    def search(self, places: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that can be among the k best, given that others already score `floor` k times."""
        bound = weights * self.list_max[places]
        order = np.argsort(-bound, kind="stable")
        places, weights, bound = places[order].tolist(), weights[order].tolist(), bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0).tolist()
        scores, at = self.scores, 0
        while at < len(places) and rest[at] >= floor:
            doc, value = self.whole_list(places[at])
            scores[doc] += weights[at] * value
            at += 1
            if at & (at - 1) == 0 or at % 8 == 0:  # how often the threshold is looked at changes the work only
                reached = scores[scores > 0]
                if len(reached) >= k:
                    floor = max(floor, int(np.partition(reached, len(reached) - k)[-k]))
        seen = np.flatnonzero(scores)
        doc = seen
        for j in range(at, len(places)):
            doc = doc[scores[doc] + rest[j] >= floor]
            doc = self._look_up(doc, places[j], weights[j], floor - rest[j + 1])
            if len(doc) == 0:
                break
        doc = doc[scores[doc] >= max(floor, 1)]
        found = scores[doc]
        if len(doc) > k:
            enough = np.partition(found, len(found) - k)[-k]
            doc, found = doc[found >= enough], found[found >= enough]
            best = np.lexsort((doc, -found))[:k]
            doc, found = doc[best], found[best]
        scores[seen] = 0
        return doc, found

    def _look_up(self, doc: np.ndarray, place: int, weight: int, needed: int) -> np.ndarray:
        """Adds the scores of one list to those of `doc`; documents that cannot reach `needed` with it are left out."""
        a, b = self.block_at[place], self.block_at[place + 1]
        block = a + np.searchsorted(self.first[a:b], doc, side="right") - 1
        there = block >= a
        most = np.where(there, weight * self.block_max[block], 0)
        can = self.scores[doc] + most >= needed
        doc, block = doc[can], block[can & there]
        if len(block) == 0:
            return doc
        others, value = self.opened[place] if place in self.opened else self.decompress(np.unique(block))
        at = np.minimum(np.searchsorted(others, doc), len(others) - 1)
        hit = others[at] == doc
        self.scores[doc[hit]] += weight * value[at[hit]]
        return doc


def document_counts(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, df): how many documents have each of the `wanted` terms (ascending)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for rows in batches:
            for terms, df in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                terms, df = np.frombuffer(terms, dtype=ARRAYS["terms"]), np.frombuffer(df, dtype=ARRAYS["df"])
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[at] == wanted, df[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

    return index.select("terms", "df").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _search_block(index: DataFrame, items: DataFrame, corpus: Corpus, item_kind: str, k: int) -> DataFrame:
    """(row, item, doc, score): the heaps of all tasks for one block of items, written to the shared folder."""
    spark = index.sparkSession
    own = items.select("row", "key", "terms").toArrow()  # as large as a block of items
    per_item = [np.frombuffer(t, dtype=np.uint64) for t in own.column("terms").to_pylist()]
    terms, term_of = np.unique(np.concatenate(per_item), return_inverse=True)
    item_at = np.cumsum([0, *[len(t) for t in per_item]])
    share = (2.0 * corpus.docs + 2) / (2 * F.col("df") + 1)
    with small_batches(spark):
        weighed = document_counts(index, terms).select("term", F.floor(1000 * F.log(share)).alias("w")).toArrow()
    weight = np.zeros(len(terms), dtype=np.int64)
    weight[np.searchsorted(terms, weighed.column("term").to_numpy().view(np.uint64))] = weighed.column("w").to_numpy()
    shared = spark.sparkContext.broadcast((own.column("row").to_pylist(), own.column("key").to_pylist(), terms, weight, term_of, item_at))
    key_type, item_type = index.schema["keys"].dataType.elementType.simpleString(), own.schema.field("key").type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item_keys, terms, weight, term_of, item_at = shared.value
        heaps: list[list[tuple]] = [[] for _ in names]
        doc_type = None
        for rows in batches:
            doc_type = rows.schema.field("keys").type.value_type
            for at in range(rows.num_rows):
                row = rows.slice(at, 1)
                segment = Segment({c: row.column(c)[0].as_py() for c in ARRAYS}, corpus)
                keys = row.column("keys").flatten()
                place = segment.places(terms)
                useful = (place >= 0) & (weight > 0)
                for i, heap in enumerate(heaps):
                    own = term_of[item_at[i] : item_at[i + 1]]
                    own = own[useful[own]]
                    if len(own) == 0:
                        continue
                    floor = -heap[-1][0] if len(heap) == k else 0
                    found, score = segment.search(place[own], weight[own], floor, k)
                    for s, d in zip(score.tolist(), keys.take(pa.array(found)).to_pylist() if len(found) else []):
                        entry = (-s, d is not None, 0 if d is None else d)
                        if len(heap) < k or entry < heap[-1]:
                            insort(heap, entry)
                            del heap[k:]
        if doc_type is None:
            return
        for at in range(0, len(names), 1000):
            flat = [(i, e) for i in range(at, min(at + 1000, len(names))) for e in heaps[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _ in flat], pa.int64()), pa.array([item_keys[i] for i, _ in flat], item_type),
                 pa.array([e[2] if e[1] else None for _, e in flat], doc_type), pa.array([-e[0] for _, e in flat], pa.int64())],
                ["row", "item", "doc", "score"],
            )

    with small_batches(spark):  # a segment at a time
        found = cut(index.select("keys", *ARRAYS).mapInArrow(work, f"row bigint, item {item_kind}, doc {key_type}, score bigint"))
    shared.destroy()
    return found


def search(
    index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", k: int = TOP,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item_key, rank, key, score): every item's k documents with the highest scores above 0, equal scores by ascending id.

    With N documents that have terms, L terms in all of them, a document of n terms and a term in df documents:
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and the score is the sum over the item's
    distinct terms of w * ((1000000000 tf) div (1000 tf + 20 m)).
    """
    item_kind = items.schema[item_key].dataType.simpleString()
    asked = item_terms(items, item_key, item_text, item_bytes)
    corpus = Corpus(*index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first())
    schema = f"row bigint, item {item_kind}, doc {index.schema['keys'].dataType.elementType.simpleString()}, score bigint"
    found = index.sparkSession.createDataFrame([], schema)
    if corpus.docs:
        for (block,) in asked.select("block").distinct().orderBy("block").collect():
            found = found.unionByName(_search_block(index, asked.where(F.col("block") == block), corpus, item_kind, k))
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc("doc")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")


#: The same rows in SQL: every document that shares a term with an item is scored.
ORACLE_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents),
b as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
c as (select count(*) as nd, sum(len(t))::bigint as nt from d where len(t) > 0),
u as (select r, unnest(t) as term from d),
p as (select r, term, count(*) as tf from u where term in (select term from b) group by r, term),
f as (select term, floor(1000 * ln((2 * c.nd + 2) / (2 * count(*) + 1)))::bigint as w from p, c group by term, c.nd),
s as (
  select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * nd) // nt))))::bigint as score
  from b join p using (term) join f using (term) join d using (r), c group by item_id, doc_id, r),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""
