"""Words, lines and shingles of an Arrow batch of texts as 64-bit numbers, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D, as in the pattern `[^\\x20\\x09-\\x0D]+`. Equal words have
equal numbers; two different ones share a number with a chance of 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # arrays of eight bytes a byte of text are made, some ten at a time

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than texts). A null text is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def give_back() -> None:
    """Returns freed memory to the system: a worker is kept between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; one longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(at, at[first] + limit, side="right")) - 1, first + 1)
        yield batch.slice(first, last - first)
        first = last
    give_back()


def runs(keep: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes as (first, past the last); a run also ends at each cut."""
    begin, end = keep.copy(), keep.copy()
    begin[1:] &= ~keep[:-1]
    end[:-1] &= ~keep[1:]
    inner = cuts[(cuts > 0) & (cuts < len(keep))]
    begin[inner] = keep[inner]
    end[inner - 1] = keep[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def run_numbers(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for the bytes of each run: its pieces of eight bytes are mixed, with their place, before they are summed.

    A sum of plain multiples would give some different long runs of a few letters the same number whatever the factors.
    """
    if len(first) == 0:
        return np.zeros(0, dtype=np.uint64)
    length = last - first
    pieces = (length + 7) >> 3
    ends = np.cumsum(length)
    piece_at = np.cumsum(pieces) - pieces
    padded = np.zeros(int(pieces.sum()) * 8, dtype=np.uint8)
    step = np.arange(int(ends[-1]))
    padded[step + np.repeat(8 * piece_at - (ends - length), length)] = data[step + np.repeat(first - (ends - length), length)]
    value = padded.view("<u8")
    if len(value) == len(first):  # no run has more than one piece
        return mix(mix(value ^ _BASE) + length.astype(np.uint64))
    place = np.arange(len(value)) - np.repeat(piece_at, pieces)
    return mix(np.add.reduceat(mix(value ^ powers(int(pieces.max()) + 1)[place + 1]), piece_at) + length.astype(np.uint64))


class Words:
    """`numbers` of all words in order, their byte ranges `first`, `last`, and per text where its words begin (`at`)."""

    def __init__(self, texts: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE):
        """`apart` tells of each byte whether it stands between words."""
        data, self.text_at = text_bytes(texts)
        self.data = _LOWER[data] if lower else data
        self.first, self.last = runs(~apart[self.data], self.text_at)
        self.numbers = run_numbers(self.data, self.first, self.last)
        self.at = np.searchsorted(self.first, self.text_at)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of `width` words, text by text, and where each text's begin.

    A text with fewer words, but any, has its whole sequence as one shingle.
    """
    n = np.diff(words.at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(int(count.sum())) - np.repeat(at[:-1], count) + words.at[:-1][text]
    size = np.minimum(n, width)[text]
    total = np.zeros(len(first), dtype=np.uint64)
    weights = powers(width + 1)
    for k in range(width):
        there = k < size
        total[there] += words.numbers[first[there] + k] * weights[k + 1]
    return mix(total + size.astype(np.uint64)), at


def shingle_sets(texts: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    """Per text its distinct shingles, ascending."""
    numbers, at = shingles(Words(texts, lower), width)
    return [np.unique(numbers[a:b]) for a, b in zip(at[:-1], at[1:])]
