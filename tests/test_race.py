"""The race down a tree of bounds against a race of all candidates with the same noise, and against softmaxes."""

import math
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mining import fits, softmax

from trapline.operators import draws, race
from trapline.session import tables_of


def whole_race(x, geometry, mine, seed, round_, exclude_self, fanout, top):
    """The winners, with the noise of every node drawn and none left out."""
    n, counts = len(x), [len(x)]
    while counts[-1] > top:
        counts.append(-(-counts[-1] // fanout))
    height, row = len(counts) - 1, np.asarray(mine)
    size = lambda level: np.array([min((k + 1) * fanout**level, n) - k * fanout**level for k in range(counts[level])])
    noise = np.log(size(height))[None] + race.gumbel(row, height, np.arange(counts[height])[None], seed, round_)
    for level in reversed(range(height)):
        own = size(level)
        below = np.empty((len(row), counts[level]))
        for parent in range(counts[level + 1]):
            ids = np.arange(parent * fanout, min((parent + 1) * fanout, counts[level]))
            luck = race.gumbel(row, level, np.broadcast_to(ids, (len(row), len(ids))), seed, round_)
            below[:, ids] = race.part_noise(noise[:, parent], np.broadcast_to(own[ids], (len(row), len(ids))), luck)
        noise = below
    _, logs = geometry.limits(x[row], geometry.leaves(x)[None])
    value = noise + logs
    if exclude_self:
        value[np.arange(len(row)), row] = -np.inf
    return value.argmax(axis=1)


def tables(spark, x, mine):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "number bigint, x array<double>")
    wanted = spark.createDataFrame([(int(i),) for i in mine], "number bigint")
    return rows, rows.join(wanted, "number", "left_semi")


def context_cloud(rng, n):
    day, cell, place = rng.integers(0, 366, n), rng.integers(0, 86_400, n), rng.integers(0, 3, n)
    order = np.lexsort((day, cell, place))
    day, cell, place = day[order], cell[order], place[order]
    hands = (day / 366, cell // 3600 / 23, cell // 60 % 60 / 59, cell % 60 / 59)
    circles = [f(2 * np.pi * h) / 2 for h in hands for f in (np.cos, np.sin)]
    return np.stack([np.zeros(n), *circles, place * 1000.0], axis=1)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("kind", ["context", "embedding", "both"])
def test_the_same_winners_as_without_bounds(spark, kind, exclude_self):
    rng = np.random.default_rng(3)
    context, vectors = context_cloud(rng, 700), rng.normal(size=(700, 5))
    vectors[100:200] = vectors[100]  # equal candidates
    geometry = {"context": race.ContextBox(0.01), "embedding": race.Ball(5, 0.05), "both": race.Both(race.ContextBox(0.02), race.Ball(5, 0.1))}[kind]
    x = {"context": context, "embedding": vectors, "both": np.concatenate([context, vectors], axis=1)}[kind]
    mine = np.arange(0, 700, 7)
    rows, pending = tables(spark, x, mine)
    tree = race.build_tree(rows.repartition(5), geometry, fanout=4, top=20)
    assert len(tree.levels) == 3
    found = {r.number: r.winner for r in race.race(pending, tree, 5, 1, exclude_self, fanout=4).collect()}
    want = whole_race(x, geometry, mine, 5, 1, exclude_self, 4, 20)
    assert [found[i] for i in mine.tolist()] == want.tolist()
    assert not exclude_self or all(a != b for a, b in found.items())


def test_bounds_hold_for_all_members():
    rng = np.random.default_rng(5)
    x = np.concatenate([context_cloud(rng, 300), rng.normal(size=(300, 4))], axis=1)
    geometry = race.Both(race.ContextBox(0.1), race.Ball(4, 0.2))
    leaves, starts = geometry.leaves(x), np.arange(0, 300, 30)
    merged = geometry.merge(leaves, np.ones(300, dtype=np.int64), starts)
    least, most = geometry.limits(x[:40], merged[None])
    _, exact = geometry.limits(x[:40], leaves[None])
    for k, s in enumerate(starts):
        part = exact[:, s : s + 30]
        assert (least[:, k] <= part.min(axis=1) + 1e-9).all() and (most[:, k] >= part.max(axis=1) - 1e-9).all()


def test_noise_of_parts_is_gumbel_noise():
    """The greatest part has the noise of the whole, and every part follows its own distribution."""
    sizes = np.broadcast_to(np.array([1, 5, 0, 20]), (40_000, 4))
    rows, ids = np.arange(40_000), np.broadcast_to(np.arange(4), (40_000, 4))
    whole = np.log(26) + race.gumbel(rows, 3, np.zeros((1, 1), dtype=np.int64), 1, 0)[:, 0]
    noise = race.part_noise(whole, sizes, race.gumbel(rows, 2, ids, 1, 0))
    assert np.allclose(noise.max(axis=1), whole)
    won = np.bincount(noise.argmax(axis=1), minlength=4) / 40_000
    assert np.allclose(won, np.array([1, 5, 0, 20]) / 26, atol=0.01)
    for k in (0, 1, 3):
        standard = noise[:, k] - np.log(sizes[0, k])
        assert abs(standard.mean() - np.euler_gamma) < 0.03 and abs(standard.std() - np.pi / np.sqrt(6)) < 0.03


def cold_table(spark, n):
    """Images all over the year and the day, at five places."""
    t, rng = datetime(2020, 1, 1), np.random.default_rng(n)
    seconds = rng.integers(0, 366 * 86_400, n).tolist()
    rows = [(f"k{i}", f"l{i % 5}", t + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "key string, location string, datetime timestamp_ntz")


def test_cold_context_draws_visit_few_candidates(spark, monkeypatch):
    """At T = 0.005 the nodes that a row opens grow far slower than the candidates."""
    opened, kept = [], race.cut

    def counted(df):
        out = kept(df)
        if "certain" in out.columns:
            opened[-1] += out.count()
        return out

    monkeypatch.setattr(race, "cut", counted)
    monkeypatch.setattr(draws, "ROUNDS", 1)  # no proposals: every row takes part in the race
    shares = []
    for n in (1_500, 12_000):
        opened.append(0)
        found = draws.positive_context(cold_table(spark, n), "key", temperature=0.005).collect()
        assert len(found) == n and all(r.partner is not None for r in found)
        shares.append(opened[-1] / n)
    assert shares[1] < 3 * shares[0] and shares[1] < 12_000 / 20, shares


def test_cold_context_draws_follow_the_softmax(spark):
    from test_mining import SHOT, context_logits, repeated, shots

    copies, rows = 150, shots()
    table, counts = repeated(spark, rows, "key", SHOT, copies), Counter()
    for r in range(2):
        found = draws.positive_context(table, "key", temperature=0.005, round_=r).collect()
        counts.update((f.key.split(":")[1], f.partner.split(":")[1]) for f in found)
    fits(counts, softmax(context_logits(rows, 0.005)), [r[0] for r in rows], 2 * copies)


def test_embeddings_around_centres_visit_few_pivots(spark, monkeypatch):
    """Like vectors have near numbers, so a cold race opens few nodes of other centres."""
    monkeypatch.setattr(draws, "ROUNDS", 0)
    rng, n = np.random.default_rng(2), 4_000
    centres = rng.normal(size=(40, 16))
    v = centres[np.arange(n) % 40] + 0.05 * rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key bigint, emb array<double>")
    sizes, kept = [], race.cut

    def counted(df):
        out = kept(df)
        if "certain" in out.columns:
            sizes.append(out.count() / n)
        return out

    monkeypatch.setattr(race, "cut", counted)
    found = draws.positive_embedding(table, "key", "emb", temperature=0.01).collect()
    assert len(found) == n and all(r.key % 40 == r.partner % 40 for r in found)
    assert sum(sizes) < n / 10, sizes
    assert math.isfinite(sum(sizes)) and table.where(F.col("key") < 0).count() == 0


@pytest.mark.parametrize("tolerance", [1e-9, 0.05])
def test_normalizers_are_the_sums_of_all_weights(spark, tolerance):
    rng = np.random.default_rng(6)
    x = np.concatenate([context_cloud(rng, 600), rng.normal(size=(600, 3))], axis=1)
    geometry = race.Both(race.ContextBox(0.05), race.Ball(3, 0.5))
    rows, pending = tables(spark, x, range(0, 600, 9))
    tree = race.build_tree(rows, geometry, fanout=4, top=20)
    found = {r.number: r.log_z for r in race.log_normalizers(pending, tree, tolerance, fanout=4).collect()}
    _, logs = geometry.limits(x, geometry.leaves(x)[None])
    top = logs.max(axis=1)
    want = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    assert set(found) == set(range(0, 600, 9))
    assert max(abs(found[i] - want[i]) for i in found) < max(1.1 * tolerance, 1e-7)


def test_normalizers_write_no_row_per_pair(spark):
    """At a small tolerance most pairs are opened; tables that grow with the pairs would fill the disk."""
    rng = np.random.default_rng(7)
    n = 6000
    geometry = race.ContextBox(0.05)
    rows, _ = tables(spark, context_cloud(rng, n), [0])
    tree = race.build_tree(rows, geometry)
    with tables_of() as paths:
        found = {r.number: r.log_z for r in race.log_normalizers(rows, tree, 1e-9).collect()}
    written = sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).glob("*.parquet"))
    assert len(found) == n and written < 1000 * n
    x = np.array([r.x for r in rows.orderBy("number").collect()])
    some = rng.integers(0, n, 50)
    want = np.log(np.exp(geometry.limits(x[some], geometry.leaves(x)[None])[1]).sum(axis=1))
    assert max(abs(found[i] - w) for i, w in zip(some, want)) < 1e-8
