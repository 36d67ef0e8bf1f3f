"""Scores in tiles against those of whole batches."""

import numpy as np
import pytest

from trapline.operators import scoring, tiles


def batches(spark, sizes, dims=6):
    rng = np.random.default_rng(4)
    rows = []
    for b, n in enumerate(sizes):
        x = rng.normal(size=(n, dims))
        if n > 8:
            x[5] = x[2] = x[7]  # equal vectors tie
        rows += [(b, i, v.tolist(), (v + 0.3 * rng.normal(size=dims)).tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "batch_id bigint, pos int, x1 array<double>, x2 array<double>").repartition(4)


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_as_whole_batches(spark, tile):
    pairs = batches(spark, [40, 1, 2, 13] if tile > 1 else [9, 1, 2])
    want = {r.batch_id: (r.n_pairs, r.loss) for r in scoring.nt_xent_score(pairs).collect()}
    got = {r.batch_id: (r.n_pairs, r.loss) for r in scoring.nt_xent_score(pairs, tile=tile).collect()}
    assert got.keys() == want.keys()
    for b, (n, loss) in want.items():
        assert got[b][0] == n and got[b][1] == pytest.approx(loss)
    for k in (1, 3):
        want = {(r.batch_id, r.pos, r["rank"]): r.other_pos for r in scoring.topk_similar(pairs, k).collect()}
        got = {(r.batch_id, r.pos, r["rank"]): r.other_pos for r in scoring.topk_similar(pairs, k, tile).collect()}
        assert got == want
    assert {tuple(r) for r in scoring.negative_hard(pairs, tile=tile).collect()} == {tuple(r) for r in scoring.negative_hard(pairs).collect()}


def test_the_best_of_tied_rows():
    score = np.array([[1.0, 2.0, 2.0, -np.inf], [3.0, 3.0, 3.0, 3.0]])
    value, place = tiles._best(score, np.array([[9, 8, 7, 6], [4, 1, 3, 2]]), 2)
    assert value.tolist() == [[2.0, 2.0], [3.0, 3.0]] and place.tolist() == [[7, 8], [1, 2]]
