"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets a vector of shares (capitals, digits, signs, repeated words and so on) and those of its neighbours;
the field's two states are good and bad. A document's score is the mean over its lines, weighted by length, of the
marginal probability of good from the forward-backward recursion. Labels are of documents, so in training all lines
of a document carry its label. Labels, ids, languages and sources are never part of a line's vector.

Training reads a bounded sample: at most TRAIN_DOCS labelled documents, the first by a hash of their id, cut into
segments of SEGMENT lines, at most TRAIN_SEGMENTS of them. Documents whose crc32(id) mod 4 is 2 are held out.
Scoring reads every text whole, one chunk of documents at a time.

A text without words (null, empty, blank) has no lines to judge; its score is the share of label 1 in the sample, as
is every score if the sample lacks one of the labels (0.5 if it is empty). Rows with a null label teach nothing;
repeated rows are each scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.words import Words, chunks, mix, run_numbers, runs
from trapline.session import cut

TRAIN_DOCS = 3_000
TRAIN_SEGMENTS = 6_000
SEGMENT = 64
ROUNDS = 150
RATE = 0.1
PENALTY = 1e-3
THRESHOLD = 0.7

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>@{}[]=+\\^~_")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:")] = True
_CLASSES = (_CAPITAL, _SMALL, _DIGIT, _SYMBOL, _MARK, _STOP)
OWN = 15


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Lines:
    """Lines with words of some texts: their vectors, lengths in bytes, and where each text's begin."""

    vectors: np.ndarray
    length: np.ndarray
    at: np.ndarray


def line_vectors(texts: pa.Array) -> Lines:
    words = Words(texts)
    data = words.data
    first, last = runs(data != 10, words.text_at)
    word_at = np.searchsorted(words.first, np.append(first, len(data)))
    n = np.diff(word_at)
    keep = n > 0
    first, last, n = first[keep], last[keep], n[keep]
    word_at = np.append(word_at[:-1][keep], word_at[-1])
    at = np.searchsorted(first, words.text_at)
    if len(first) == 0:
        return Lines(np.zeros((0, 3 * OWN + 1)), np.zeros(0), at)
    length = (last - first).astype(float)
    sums = [np.concatenate(([0], np.cumsum(c[data], dtype=np.int64))) for c in _CLASSES]
    share = [(s[last] - s[first]) / length for s in sums]
    line = np.repeat(np.arange(len(first)), n)
    unique = np.unique(mix(words.numbers[word_at[0]:] ^ mix(line.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(line[unique], minlength=len(first)) / n
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    number = mix(run_numbers(data, first, last) ^ mix(text.astype(np.uint64)))
    _, back, times = np.unique(number, return_inverse=True, return_counts=True)
    starts_capital = _CAPITAL[data[words.first]] | (data[words.first] >= 0xC3)
    own = np.column_stack([
        *share,
        1 - distinct,
        (1 - distinct) * (n >= 8),
        times[back] > 1,
        np.log1p(n) / 5,
        n <= 3,
        np.minimum(length / n, 30) / 10,
        np.add.reduceat(starts_capital[word_at[0]:], word_at[:-1] - word_at[0]) / n,
        _STOP[data[last - 1]],
        share[3] + share[4] > 0.03,
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    filled = at[:-1][np.diff(at) > 0]
    before[filled] = 0
    after[np.append(filled[1:], len(own)) - 1] = 0
    return Lines(np.column_stack([own, before, after, np.ones(len(own))]), length, at)


@dataclass
class Field:
    """Weights of a line's vector for good against bad, scores of the four transitions, and the share of good."""

    weights: np.ndarray
    transitions: np.ndarray
    good: float


def _steps(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length: their order, and how many are at least t + 1 lines long for each t."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    alive = np.searchsorted(-n[order], -np.arange(n.max() if len(n) else 0), side="left")
    return order, at[:-1][order], alive


def marginals(score: np.ndarray, transitions: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per line the probabilities of (bad, good), the expected number of each transition, and the log of all sums."""
    half = np.clip(score, -60, 60) / 2
    local = np.exp(np.column_stack([-half, half]) - np.abs(half)[:, None])
    moves = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(local), np.ones_like(local)
    expected, log_sum = np.zeros((2, 2)), float(np.abs(half).sum())
    _, first, alive = _steps(at)
    for t, k in enumerate(alive):
        here = first[:k] + t
        forward[here] = local[here] if t == 0 else forward[here - 1] @ moves * local[here]
        total = forward[here].sum(axis=1, keepdims=True)
        forward[here] /= total
        log_sum += float(np.log(total).sum())
    for t in range(len(alive) - 1, 0, -1):
        here = first[: alive[t]] + t
        ahead = backward[here] * local[here]
        pair = forward[here - 1][:, :, None] * moves[None] * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ moves.T
        backward[here - 1] = back / back.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), expected, log_sum + transitions.max() * float((np.diff(at) - 1).clip(0).sum())


def fit(vectors: np.ndarray, at: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on the whole sample. `good` is per chain."""
    chains = np.diff(at)
    share = float(good.mean()) if len(good) else 0.5
    if len(vectors) == 0 or good.all() or not good.any():
        return Field(np.zeros(3 * OWN + 1), np.zeros((2, 2)), share)
    state = np.repeat(good, chains).astype(int)
    seen = np.zeros((2, 2))
    inner = (chains - 1).clip(0)
    seen[1, 1], seen[0, 0] = inner[good].sum(), inner[~good].sum()
    seen += 0.5  # neighbours of unlike state are possible
    weights, transitions = np.zeros(vectors.shape[1]), np.log(seen / seen.sum(axis=1, keepdims=True)).clip(-4, 0)
    params = np.concatenate([weights, transitions.ravel()])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, transitions = params[:-4], params[-4:].reshape(2, 2)
        both, expected, _ = marginals(vectors @ weights, transitions, at)
        gradient = np.concatenate([vectors.T @ (state - both[:, 1]), (seen - expected).ravel()]) / len(state)
        gradient -= PENALTY * params
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        params = params + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        params[-4:] = params[-4:].clip(-4, 4)
    return Field(params[:-4], params[-4:].reshape(2, 2), share)


def scores(texts: pa.Array, field: Field) -> np.ndarray:
    """One score per text."""
    lines = line_vectors(texts)
    out = np.full(len(texts), field.good)
    if not field.weights.any():
        return out
    both, _, _ = marginals(lines.vectors @ field.weights, field.transitions, lines.at)
    filled = np.flatnonzero(np.diff(lines.at) > 0)
    if len(filled):
        starts = lines.at[:-1][filled]
        out[filled] = np.add.reduceat(both[:, 1] * lines.length, starts) / np.add.reduceat(lines.length, starts)
    return out.clip(0, 1)


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
    train_docs: int = TRAIN_DOCS, train_segments: int = TRAIN_SEGMENTS,
) -> Field:
    """Fits the field on the sample. Only vectors of its lines come to the driver, at most TRAIN_SEGMENTS segments."""
    known = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    chosen = known.groupBy(key).agg(F.max(quality).alias("_good")).orderBy(F.xxhash64(key), key).limit(train_docs)
    sample = docs.select(key, text).join(F.broadcast(chosen), key).select(F.col("_good").cast("int").alias("good"), text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                lines, good = line_vectors(part.column(1)), part.column(0).to_pylist()
                rows = [
                    (good[d], min(SEGMENT, b - s), lines.vectors[s : min(s + SEGMENT, b)].astype("<f4").tobytes())
                    for d, (a, b) in enumerate(zip(lines.at[:-1], lines.at[1:])) for s in range(a, b, SEGMENT)
                ]
                if rows:
                    columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))],
                        ["good", "n", "vectors"],
                    )

    segments = cut(sample.mapInArrow(work, "good int, n int, vectors binary"))
    found = segments.orderBy(F.xxhash64("vectors"), "vectors").limit(train_segments).toArrow()
    at = np.concatenate(([0], np.cumsum(found.column("n").to_numpy())))
    vectors = np.frombuffer(b"".join(found.column("vectors").to_pylist()), dtype="<f4").reshape(-1, 3 * OWN + 1)
    return fit(vectors.astype(float), at, found.column("good").to_numpy() > 0)


def score_documents(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                found = pa.array(scores(part.column(1), field), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), found], [key, "score"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    scored = score_documents(docs, train(docs, labels, key, text, quality), key, text)
    return scored.select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
