"""b-bit MinHash near duplicates against brute force."""

import random

import numpy as np
import pytest
from test_pairs import brute_components, families, frame

from trapline.llm import bbit_minhash


@pytest.mark.parametrize("seed,width,percent,block", [(1, 5, 85, 1024), (2, 5, 85, 4), (3, 4, 80, 7), (5, 5, 85, 3)])
def test_components_as_by_hand(spark, seed, width, percent, block):
    texts = families(seed, members=40)
    found = bbit_minhash.near_duplicates(frame(spark, texts).repartition(4), width=width, percent=percent, block=block).collect()
    expected = brute_components(texts, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert {r.doc_id for r in found if r.kept} == {i for i, (_, c) in expected.items() if c == i}


def test_a_chain_of_links_in_one_bucket(spark):
    """Neighbours are alike, the ends are not, so the hub of a bucket does not see every link."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(9000)}" for _ in range(150)]
    chain = []
    for k in range(40):
        base[(7 * k) % 150] = f"new{k}"
        chain.append(" ".join(base))
    draw.shuffle(chain)
    for block in (5, 1024):
        rows = bbit_minhash.near_duplicates(frame(spark, chain), block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(chain, 5, 85)


def test_odd_rows(spark):
    twice = frame(spark, ["a b c d e f", "a b c d e f"]).union(frame(spark, ["a b c d e f", None]))
    rows = bbit_minhash.near_duplicates(twice).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [
        (0, 2, 0, True), (0, 2, 0, True), (1, 0, 1, True), (1, 2, 0, False)
    ]
    assert bbit_minhash.near_duplicates(twice.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, ""), (4, "A b c d e")], "doc_id long, text string")
    rows = bbit_minhash.near_duplicates(nulls).collect()
    assert sorted((r.n_shingles, r.doc_id is None, r.component_id) for r in rows if r.n_shingles) == [(1, False, 4), (1, True, 4)]
    assert [r.component_id for r in rows if not r.n_shingles] == [None]
    odd = frame(spark, ["a b c d e", "x"]).withColumnsRenamed({"cls": "digest", "z": "bands", "root": "signature", "line": "bucket"})
    assert bbit_minhash.near_duplicates(odd).count() == 2


@pytest.mark.parametrize("share", [0.3, 0.85, 0.95])
def test_estimates_are_near_the_similarity(share):
    draw = np.random.default_rng(int(100 * share))
    errors = []
    for _ in range(60):
        n = 400
        common = round(2 * n * share / (1 + share))
        numbers = np.unique(draw.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = numbers[:n], np.r_[numbers[:common], numbers[n : 2 * n - common]]
        packed = bbit_minhash.pack(bbit_minhash.minima([a, np.sort(b)]))
        errors.append(bbit_minhash.similarity(bbit_minhash.agreeing(packed[:1], packed[1:]))[0] - common / (2 * n - common))
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 1.5 * np.sqrt(0.25 / bbit_minhash.K)


def test_the_rejection_bound():
    least = bbit_minhash.least_places(85)
    assert 0.6 < bbit_minhash.similarity(np.array([least]))[0] < 0.75
    assert (1 - 0.85**bbit_minhash.ROWS) ** bbit_minhash.BANDS < 1e-8
