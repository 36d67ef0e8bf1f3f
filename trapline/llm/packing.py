"""Packing by minimum bin slack: sequences of at most CAPACITY tokens, filled to the last token wherever possible.

A task reads its documents in windows of some million tokens. Whole sequences are cut off documents longer than one;
what remains of each document is packed. A sequence starts with the longest remainder; a subset-sum over the
remaining lengths, one bit per reachable sum, finds the multiset of lengths that comes closest to what is free, and
walking back through the bits gives how many of each length it takes. Where no subset fits exactly, the next
remainder is cut to fill the sequence, and its rest is packed later. The last sequence of a window is cut at powers
of two, which need no padding. Nothing is shuffled: the windows follow the order of the input's partitions, and
sequence numbers are (partition, count) in one long.

A null text is empty: its document has the end id only. Ids that repeat or are null are packed row by row. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trapline.llm.tokens import CHUNK_BYTES, END_ID, REMEMBERED, encoder
from trapline.llm.words import chunks

CAPACITY = 4096
WINDOW_TOKENS = 2_000_000
SEQUENCE_BITS = 40

Piece = tuple[int, int, int]  # document of the window, first of its ids, how many


def closest_subset(lengths: list[int], counts: dict[int, int], free: int) -> list[int]:
    """The multiset of remaining lengths with the greatest sum of at most `free`.

    `lengths` are the distinct lengths, ascending. Long ones are tried first, and as soon as a sum of `free` is
    reachable no more are looked at.
    """
    wanted, mask = 1 << free, (2 << free) - 1
    reach, steps = 1, []
    for length in reversed(lengths[: bisect_right(lengths, free)]):
        left, times = min(counts[length], free // length), 1
        while left and not reach & wanted:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, times = left - times, times * 2
        if reach & wanted:
            break
    total, taken = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            taken += [length] * times
            total -= length * times
    return taken


def pack_window(sizes: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """The sequences of one window, each a list of pieces; every id of every document lies in exactly one."""
    sequences: list[list[Piece]] = []
    waiting: dict[int, list[Piece]] = {}
    lengths: list[int] = []
    counts: dict[int, int] = {}

    def put(piece: Piece) -> None:
        if piece[2] not in waiting:
            waiting[piece[2]], counts[piece[2]] = [], 0
            insort(lengths, piece[2])
        waiting[piece[2]].append(piece)
        counts[piece[2]] += 1

    def take(length: int) -> Piece:
        piece = waiting[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del waiting[length], counts[length], lengths[bisect_left(lengths, length)]
        return piece

    for doc, size in enumerate(sizes):
        whole = size // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(whole)]
        if size % capacity:
            put((doc, whole * capacity, size % capacity))
    while lengths:
        pieces = [take(lengths[-1])]
        free = capacity - pieces[0][2]
        for length in closest_subset(lengths, counts, free):
            pieces.append(take(length))
            free -= length
        if free and lengths:  # every length left is longer than what is free
            doc, start, length = take(lengths[0])
            pieces.append((doc, start, free))
            put((doc, start + free, length - free))
            free = 0
        sequences += [pieces] if not free else powers_of_two(pieces)
    return sequences


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Cuts a sequence that is not full into ones whose sizes are powers of two, the largest first."""
    total = sum(length for *_, length in pieces)
    left, out = list(reversed(pieces)), []
    while total:
        room, sequence = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            doc, start, length = left.pop()
            used = min(length, room)
            sequence.append((doc, start, used))
            room -= used
            if used < length:
                left.append((doc, start + used, length - used))
        out.append(sequence)
    return out


class _Window:
    """Documents of a task until they are enough for one window."""

    def __init__(self, key_type: pa.DataType, with_ids: bool, capacity: int):
        self.key_type, self.with_ids, self.capacity = key_type, with_ids, capacity
        self.sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        self.keys, self.ids, self.tokens = [], [], 0

    def add(self, keys: list, ids: np.ndarray, at: np.ndarray) -> None:
        self.keys += keys
        self.ids += [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        self.tokens += len(ids)

    def pack(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.ids]
        rows = []
        for pieces in pack_window(sizes, self.capacity):
            offset = 0
            for doc, start, length in pieces:
                part = self.ids[doc][start : start + length].astype("<u4").tobytes()
                rows.append((doc, start, length, zlib.crc32(part), sizes[doc], self.sequence, offset, part))
                offset += length
            self.sequence += 1
        doc, *columns, ids = zip(*rows) if rows else [()] * 8
        arrays = [pa.array([self.keys[d] for d in doc], self.key_type), *[pa.array(c, pa.int64()) for c in columns]]
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
        self.keys, self.ids, self.tokens = [], [], 0
        return pa.RecordBatch.from_arrays(arrays, names)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False,
    capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, end_id: int = END_ID, remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` on demand.

    `ids` are little-endian unsigned 32-bit numbers. `vocabulary` is the path of a tokenizer file on the executors;
    without one the installed public vocabulary is used. A worker keeps the ids of about `remembered` words.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint" + (", ids binary" if with_ids else "")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = None
        for batch in batches:
            window = window or _Window(batch.column(0).type, with_ids, capacity)
            for part in chunks(batch, text, CHUNK_BYTES):
                window.add(part.column(0).to_pylist(), *encoder(vocabulary, remembered).encode_documents(part.column(1), end_id))
                if window.tokens >= window_tokens:
                    yield window.pack().rename_columns(names)
        if window and window.keys:
            yield window.pack().rename_columns(names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    return docs.select(key, text).mapInArrow(work, schema)
