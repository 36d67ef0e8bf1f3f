"""Draws against the softmax they claim to follow, computed by brute force."""

import math
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.operators import bursts, draws, features, positives


def chi_square(observed: Counter, probability: np.ndarray, keys, total) -> tuple[float, int]:
    stat, cells = 0.0, 0
    for i, a in enumerate(keys):
        rest_seen, rest_want = 0, 0.0
        for j, b in enumerate(keys):
            want, seen = probability[i, j] * total, observed[a, b]
            if want < 5:
                rest_seen, rest_want = rest_seen + seen, rest_want + want
            else:
                stat, cells = stat + (seen - want) ** 2 / want, cells + 1
        if rest_want >= 5:
            stat, cells = stat + (rest_seen - rest_want) ** 2 / rest_want, cells + 1
        else:
            assert rest_seen <= rest_want + 12, (a, rest_seen, rest_want)
    return stat, cells


def fits(observed, probability, keys, total):
    stat, cells = chi_square(observed, probability, keys, total)
    assert sum(observed.values()) == total * len(keys)
    assert stat < cells + 5 * math.sqrt(2 * cells), (stat, cells)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def repeated(spark, rows, key, schema, copies):
    """The same small table many times under different keys: each copy is one more draw of each row."""
    return spark.createDataFrame([(f"{c}:{r[0]}", *r[1:]) for c in range(copies) for r in rows], schema)


def shots():
    t = datetime(2020, 5, 5, 10, 30, 30)
    steps = [0, 0, 1, 2, 61, 3600, 86400, 40 * 86400, 400 * 86400, 23, 59, 1800]
    return [(f"{n}", "xxy"[n % 3], t + timedelta(seconds=s)) for n, s in enumerate(steps)]


def context_logits(rows, temperature):
    lo, hi = min(r[2].year for r in rows), max(r[2].year for r in rows)
    leap = [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]

    def vector(r):
        parts = []
        for x in ((leap[r[2].month - 1] + r[2].day - 1) / 366, r[2].hour / 23, r[2].minute / 59, r[2].second / 59):
            angle = math.pi * (2 * x - 1)
            parts += [(math.sin(angle) + 1) / 2, (math.cos(angle) + 1) / 2]
        return [0.0 if hi == lo else (r[2].year - lo) / (hi - lo), *parts, r[1] == "x", r[1] == "y"]

    v = np.array([vector(r) for r in rows], dtype=float)
    return -np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)) / temperature


SHOT = "key string, location string, datetime timestamp_ntz"


@pytest.mark.parametrize("temperature", [0.05, 1.0])
def test_context_draws_follow_the_softmax(spark, temperature):
    """With T = 1 other locations get much of the weight, so both parts of the proposal are tried."""
    copies, rows = 300, shots()
    table = repeated(spark, rows, "key", SHOT, copies)
    found = draws.positive_context(table, "key", temperature=temperature).collect()
    assert len({r.key for r in found}) == len(found) == copies * len(rows)
    # All copies of a row are alike, so a partner counts as its original.
    counts = Counter((r.key.split(":")[1], r.partner.split(":")[1]) for r in found)
    fits(counts, softmax(context_logits(rows, temperature)), [r[0] for r in rows], copies)


def test_context_draws_do_not_depend_on_partitions_or_groups(spark, monkeypatch):
    table = repeated(spark, shots(), "key", SHOT, 20)
    want = sorted(draws.positive_context(table, "key").collect())
    monkeypatch.setattr(draws, "GROUP_ROWS", 7)
    assert sorted(draws.positive_context(table.repartition(11), "key", first=5).collect()) == want


def test_embedding_draws_follow_the_softmax(spark):
    copies, rng = 300, np.random.default_rng(1)
    v = rng.normal(size=(6, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"{i}", x.tolist()) for i, x in enumerate(v)]
    table = repeated(spark, rows, "key", "key string, emb array<double>", copies)
    found = draws.positive_embedding(table, "key", "emb").collect()
    counts = Counter((r.key.split(":")[1], r.partner.split(":")[1]) for r in found)
    fits(counts, softmax(v @ v.T / 0.5), [r[0] for r in rows], copies)


def test_combined_draws_follow_the_product(spark):
    copies, rng, base = 200, np.random.default_rng(2), shots()
    v = rng.normal(size=(len(base), 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(*r, x.tolist()) for r, x in zip(base, v)]
    table = repeated(spark, rows, "key", f"{SHOT}, emb array<double>", copies)
    found = draws.positive_combined(table, "key", "emb", context_temperature=0.3).collect()
    counts = Counter((r.key.split(":")[1], r.partner.split(":")[1]) for r in found)
    fits(counts, softmax(context_logits(base, 0.3) + v @ v.T / 0.5), [r[0] for r in rows], copies)


def test_a_cold_softmax_still_draws_for_every_row(spark, monkeypatch):
    monkeypatch.setattr(draws, "ROUNDS", 2)
    rows = spark.createDataFrame([(str(i), [math.cos(i), math.sin(i)]) for i in range(300)], "key string, emb array<double>")
    found = draws.positive_embedding(rows, "key", "emb", temperature=1e-9, first=1, exclude_self=True).collect()
    best = [max(math.cos(i - j) for j in range(300) if j != i) for i in range(300)]
    assert len(found) == 300
    assert all(math.cos(int(r.key) - int(r.partner)) > best[int(r.key)] - 1e-7 and r.key != r.partner for r in found)


def test_the_race_over_all_rows_follows_the_softmax(spark, monkeypatch):
    monkeypatch.setattr(draws, "ROUNDS", 0)
    copies, rng = 100, np.random.default_rng(1)
    v = rng.normal(size=(5, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"{i}", x.tolist()) for i, x in enumerate(v)]
    table, counts = repeated(spark, rows, "key", "key string, emb array<double>", copies), Counter()
    for r in range(2):
        found = draws.positive_embedding(table, "key", "emb", round_=r).collect()
        counts.update((f.key.split(":")[1], f.partner.split(":")[1]) for f in found)
    fits(counts, softmax(v @ v.T / 0.5), [r[0] for r in rows], 2 * copies)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_the_race_of_context_draws_follows_the_softmax(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(draws, "ROUNDS", 1)  # no proposals for context draws
    copies, rows, temperature = 60, shots(), 0.4
    table, counts = repeated(spark, rows, "key", SHOT, copies), Counter()
    for r in range(2):
        found = draws.positive_context(table, "key", temperature=temperature, round_=r, exclude_self=exclude_self).collect()
        assert len(found) == copies * len(rows)
        assert not exclude_self or all(f.key != f.partner for f in found)
        counts.update((f.key.split(":")[1], f.partner.split(":")[1]) for f in found)
    weights = np.full((len(rows),) * 2, copies) - np.eye(len(rows)) * exclude_self
    fits(counts, without_self(context_logits(rows, temperature), weights), [r[0] for r in rows], 2 * copies)


def test_a_lonely_day_in_a_crowded_second(spark, monkeypatch):
    widths = []
    attempts = draws._attempts
    monkeypatch.setattr(draws, "_attempts", lambda p, start, width: widths.append(width) or attempts(p, start, width))
    crowd = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("location"), F.lit("2020-07-01 12:00:00").cast("timestamp_ntz").alias("datetime"))
    lonely = spark.createDataFrame([("lonely", "x", datetime(2020, 1, 1, 12))], "key string, location string, datetime timestamp_ntz")
    found = draws.positive_context(crowd.unionByName(lonely), "key")
    assert found.count() == 40_001 and len(widths) <= 4
    assert found.where("key = 'lonely'").first().partner == "lonely"


def test_rows_without_place_time_or_vector_have_no_partner(spark):
    t = datetime(2020, 1, 1)
    rows = [("a", "x", t, [1.0, 0.0]), ("b", None, t, [1.0, 0.0]), ("c", "x", None, [1.0, 0.0]), ("d", "x", t, None), ("e", "x", t, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "key string, location string, datetime timestamp_ntz, emb array<double>")
    context = {r.key: r.partner for r in draws.positive_context(table, "key").collect()}
    assert context.keys() == set("abcde") and context["b"] is None and context["c"] is None
    assert {context[k] for k in "ade"} <= set("ade")
    both = {r.key: r.partner for r in draws.positive_combined(table, "key", "emb").collect()}
    assert [both[k] for k in "bcd"] == [None] * 3 and {both["a"], both["e"]} <= set("ae")
    alike = {r.key: r.partner for r in draws.positive_embedding(table, "key", "emb").collect()}
    assert alike.keys() == set("abcde") and alike["d"] is None and "d" not in alike.values()


def test_rows_without_class_have_no_partner_and_are_counted(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", None, "x"), ("d", 1, "x")], "img_path string, category_id int, location string")
    drawn = positives.positive_class(rows)
    found = {r.img_path: r.partner for r in drawn.collect()}
    assert found["c"] is None and {found[k] for k in "abd"} <= set("abd")
    near = {r.img_path: r.partner for r in positives.positive_class(rows, same_location=True).collect()}
    assert near["b"] is None and near["c"] is None and {near["a"], near["d"]} <= set("ad")
    agreement = positives.positive_class_agreement(drawn, rows).first()
    assert (agreement.n_draws, agreement.class_agreement) == (4, 0.75)


def labelled(spark, n=3000):
    return spark.range(n).select(
        F.concat(F.lit("p"), "id").alias("img_path"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5 + 1).alias("category_id"),
        F.concat(F.lit("l"), F.col("id") % 4).alias("location"),
    )


@pytest.mark.parametrize("same_location", [False, True])
def test_class_draws_keep_class_and_location(spark, same_location):
    rows = labelled(spark)
    found = positives.positive_class(rows, noise=0.25, same_location=same_location)
    truth = {r.img_path: r for r in rows.collect()}
    pairs = found.collect()
    assert len(pairs) == len(truth)
    share = sum(truth[p.img_path].category_id == truth[p.partner].category_id for p in pairs) / len(pairs)
    assert abs(share - 0.75) < 0.04
    if same_location:
        assert all(truth[p.img_path].location == truth[p.partner].location for p in pairs)
    agreement = positives.positive_class_agreement(found, rows).first()
    assert agreement.class_agreement == pytest.approx(share)


def test_class_draws_are_uniform_over_the_class(spark):
    rows, counts = labelled(spark), Counter()
    for r in range(6):
        found = positives.positive_class(rows, round_=r).join(rows, "img_path").where(F.col("category_id") == 0).collect()
        counts.update(p.partner for p in found)
    values = np.array([counts.get(f"p{i}", 0) for i in range(0, 3000, 3)])
    assert values.sum() == 6000 and abs(values.mean() - 6) < 1e-9 and values.var() < 9


def test_no_other_class_gives_null(spark):
    rows = labelled(spark, 9).withColumn("category_id", F.lit(1))
    found = positives.positive_class(rows, noise=1.0).collect()
    assert len(found) == 9 and all(r.partner is None for r in found)


def test_burst_draws_are_uniform_over_self_and_burst(spark):
    t = datetime(2020, 1, 1)
    rows = []
    for g in range(400):  # one location per group: a has two crops, b one, three seconds later
        for img, s, crop in (("a", 0, "1"), ("a", 0, "2"), ("b", 3, "3")):
            rows.append((f"{g}{img}", f"l{g}", t + timedelta(seconds=s), f"{g}:{crop}"))
    crops = spark.createDataFrame(rows, "img_id string, location string, datetime timestamp_ntz, img_path string")
    near = bursts.burst_neighbours(bursts.burst_images(crops))
    sizes = bursts.with_burst_sizes(near, bursts.boxes_per_image(crops))
    found = positives.positive_burst(crops, sizes).collect()
    counts = Counter((r.img_path.split(":")[1], r.partner.split(":")[1]) for r in found)
    assert all(r.img_path.split(":")[0] == r.partner.split(":")[0] for r in found)
    fits(counts, np.full((3, 3), 1 / 3), ["1", "2", "3"], 400)


def test_one_hot_distance_matches_the_sparse_one(spark):
    rows = spark.createDataFrame([(*r, 1, 1, 2, 2, 10, 10, 1) for r in shots()], f"{SHOT}, x1 int, y1 int, width int, height int, img_width int, img_height int, boxes_per_img_id int")
    table = features.context_features(rows)
    dense = {r.key: np.array(r.con_standard) for r in features.context_standard(table, dense=True).collect()}
    want = -context_logits(shots(), 1.0)
    keys = [r[0] for r in shots()]
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            assert np.linalg.norm(dense[a] - dense[b]) == pytest.approx(want[i, j])


def without_self(logits, same):
    """Softmax over copies of small tables, with one copy of the row itself left out."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True)) * same
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("temperature", [0.05, 1.0])
def test_context_draws_without_self(spark, temperature):
    copies, rows = 60, shots()
    table = repeated(spark, rows, "key", SHOT, copies)
    counts = Counter()
    for r in range(3):
        found = draws.positive_context(table, "key", temperature=temperature, round_=r, exclude_self=True).collect()
        assert len(found) == copies * len(rows) and all(f.key != f.partner for f in found)
        counts.update((f.key.split(":")[1], f.partner.split(":")[1]) for f in found)
    n = len(rows)
    weights = np.full((n, n), copies) - np.eye(n)
    fits(counts, without_self(context_logits(rows, temperature), weights), [r[0] for r in rows], 3 * copies)


def test_other_draws_without_self(spark):
    rows = spark.createDataFrame([(str(i), [math.cos(i), math.sin(i)]) for i in range(40)], "key string, emb array<double>")
    found = draws.positive_embedding(rows, "key", "emb", exclude_self=True).collect()
    assert len(found) == 40 and all(r.key != r.partner for r in found)
    crops = labelled(spark, 600).unionByName(spark.createDataFrame([("only", 77, "l0")], "img_path string, category_id int, location string"))
    truth = {r.img_path: r.category_id for r in crops.collect()}
    pairs = positives.positive_class(crops, exclude_self=True).collect()
    assert len(pairs) == 601 and all(p.partner != p.img_path for p in pairs)
    assert all(p.partner is None if p.img_path == "only" else truth[p.partner] == truth[p.img_path] for p in pairs)


@pytest.mark.parametrize("without_self", [False, True])
def test_proposals_do_not_meet_every_cell(monkeypatch, without_self):
    """Picks are those of plain running sums over all cells, but distances are taken of picked cells only."""
    import pandas as pd

    rng = np.random.default_rng(3)
    cells = np.sort(rng.choice(86_400, 3_000, replace=False))
    sizes = rng.integers(1, 4, len(cells))
    firsts = np.cumsum(sizes) - sizes
    own_gid = rng.integers(0, sizes.sum(), 500)
    own = cells[np.repeat(np.arange(len(cells)), sizes)[own_gid]]
    tries = pd.DataFrame({
        "key": np.arange(500), "attempt": 0, "loc": "a", "cell": own, "day": 0, "year": 0.0, "own_gid": own_gid,
        "u_cell": rng.random(500), "u_member": rng.random(500),
    })
    measured, gap = [], draws.clock_gap
    monkeypatch.setattr(draws, "clock_gap", lambda c, hands: measured.append(len(hands[0])) or gap(c, hands))
    n, temperature = int(sizes.sum()) * 50, 0.5
    pick = draws._cell_picker("key", n, temperature, without_self)
    found = pick(tries, pd.DataFrame({"cells": [cells], "sizes": [sizes], "firsts": [firsts]}))
    assert sum(measured) <= len(tries)

    def hand(c):
        return ((c // 3600, 23.0), (c // 60 % 60, 59.0), (c % 60, 59.0))

    elsewhere = n * math.exp(-math.sqrt(2) / temperature)
    for k in range(len(tries)):
        square = sum(np.sin(np.pi * (a - b) / span) ** 2 for (a, span), (b, _) in zip(hand(own[k]), hand(cells)))
        counts = sizes - (cells == own[k]) if without_self else sizes
        upto = np.cumsum(counts * np.exp(-np.sqrt(square) / temperature))
        mark = tries["u_cell"][k] * (upto[-1] + elsewhere)
        assert found["foreign"][k] == (mark >= upto[-1])
        if mark >= upto[-1]:
            assert found["gid"][k] == int(tries["u_member"][k] * n)
        else:
            at = int(np.searchsorted(upto, mark, side="right"))
            gid = firsts[at] + int(tries["u_member"][k] * counts[at])
            gid += without_self and cells[at] == own[k] and gid >= own_gid[k]
            assert found["gid"][k] == gid and abs(found["bound"][k] - math.sqrt(square[at])) < 1e-12
