"""Line classifier: the recursion against enumeration, and accuracy on documents that were held out."""

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trapline.llm import line_crf
from trapline.llm.registry import CHECKS, table


def enumerate_chain(score, transitions):
    """Marginals, expected transitions and log of the sum over all labellings."""
    n = len(score)
    total, both, moves = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
    for labels in product((0, 1), repeat=n):
        w = sum((s / 2 if y else -s / 2) for s, y in zip(score, labels)) + sum(transitions[a, b] for a, b in zip(labels, labels[1:]))
        w = np.exp(w)
        total += w
        for i, y in enumerate(labels):
            both[i, y] += w
        for a, b in zip(labels, labels[1:]):
            moves[a, b] += w
    return both / total, moves / total, np.log(total)


def test_forward_backward_is_the_sum_over_labellings():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 1, 7, 2, 7]
    at = np.concatenate(([0], np.cumsum(sizes)))
    score, transitions = rng.normal(size=at[-1]) * 3, rng.normal(size=(2, 2))
    both, expected, log_sum = line_crf.marginals(score, transitions, at)
    parts = [enumerate_chain(score[a:b], transitions) for a, b in zip(at, at[1:]) if b > a]
    assert both == pytest.approx(np.concatenate([p[0] for p in parts]))
    assert expected == pytest.approx(sum(p[1] for p in parts))
    assert log_sum == pytest.approx(sum(p[2] for p in parts))


def test_vectors_hold_the_neighbours():
    lines = line_crf.line_vectors(pa.array(["One two\n\nthree ###\nfour", None, "", "last line here!"]))
    assert list(lines.at) == [0, 3, 3, 3, 4] and list(lines.length) == [7, 9, 4, 15]
    own, before, after = (lines.vectors[:, k * line_crf.OWN : (k + 1) * line_crf.OWN] for k in range(3))
    assert (before[1:3] == own[:2]).all() and (after[:2] == own[1:3]).all()
    assert not before[[0, 3]].any() and not after[[2, 3]].any()


def test_very_long_and_empty_texts_have_scores():
    field = line_crf.Field(np.linspace(-1, 1, 3 * line_crf.OWN + 1), np.zeros((2, 2)), 0.8)
    found = line_crf.scores(pa.array([None, "", " \n", "a b\n" * 30_000, "x" * 300_000, "é ü"]), field)
    assert list(found[:3]) == [0.8] * 3 and ((found >= 0) & (found <= 1)).all()


def test_one_kind_of_label_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x"), (2, None)], "doc_id long, text string").withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    rows = line_crf.classify(docs, labels).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {1.0}
    assert {r.score for r in line_crf.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert line_crf.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = CHECKS["op8_quality_classifier"][0](spark, d)
    assert found.count() == table(spark, d, "documents").count()
    rows = found.join(table(spark, d, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
