"""Ranked search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """{row of an item: [(rank, doc_id, score)]}"""
    words = [(key, Counter(terms_of(t))) for key, t in docs]
    words = [(key, w) for key, w in words if w]
    n_docs, n_terms = len(words), sum(w.total() for _, w in words)
    df = Counter(t for _, w in words for t in w)
    out = {}
    for at, (_, text) in enumerate(items):
        found = []
        own = set(terms_of(text))
        for key, w in words:
            m, score = 50 + (50 * w.total() * n_docs) // n_terms, 0
            for t in own:
                tf = w[t]
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score:
                found.append((-score, key is not None, key or 0))
        out[at] = [(r + 1, key if there else None, -s) for r, (s, there, key) in enumerate(sorted(found)[:k])]
    return out


def corpus(seed, n=400, vocabulary=300):
    draw = random.Random(seed)
    common = [f"t{i}" for i in range(vocabulary)]
    word = lambda: common[min(int(draw.expovariate(1 / 40)), vocabulary - 1)]
    docs = [" ".join(word() for _ in range(draw.randrange(1, 120))) for _ in range(n)]
    docs += [None, "", " .,; \n", "É é日本 a1B2 x_y-z", "e" * 40_000, "t1 " * 3_000, "Only-Here", docs[0], docs[0]]
    items = [" ".join(word() for _ in range(draw.randrange(1, 40))) for _ in range(25)]
    items += [None, "", "...", "é日本 A1b2 y", "nowhere", items[3], "t0", "only here e" * 1 + "e" * 39_999]
    return list(enumerate(docs)), [(100 + i, t) for i, t in enumerate(items)]


def found(spark, docs, items, k, **options):
    d = spark.createDataFrame([(*r, 1, "s") for r in docs], "doc_id long, text string, score int, rank string").repartition(3)
    q = spark.createDataFrame([(*r, 2, "t") for r in items], "item_id long, text string, row int, block string")
    index = ranked_search.build_index(d, **({"segment_bytes": options.pop("segment_bytes")} if "segment_bytes" in options else {}))
    got = {}
    for r in ranked_search.search(index, q, k=k, **options).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return {key: sorted(v, key=lambda x: x[0]) for key, v in got.items()}


@pytest.mark.parametrize("seed,k,options", [(1, 5, {}), (2, 50, {"segment_bytes": 3_000}), (3, 3, {"item_bytes": 300}), (4, 1, {"segment_bytes": 500, "item_bytes": 1})])
def test_the_same_ranks_as_a_plain_scorer(spark, seed, k, options):
    docs, items = corpus(seed)
    want = {100 + at: rows for at, rows in brute(docs, items, k).items() if rows}
    assert found(spark, docs, items, k, **options) == want


def test_equal_scores_and_odd_ids(spark):
    docs = [(9, "a b"), (2, "a b"), (None, "a b"), (2, "a c"), (5, "x"), (7, "b a")]
    items = [(1, "a"), (1, "b"), (None, "c")]
    rows = brute(docs, items, 3)
    got = found(spark, docs, items, 3)
    assert sorted(map(str, got[1])) == sorted(map(str, rows[0] + rows[1])) and got[None] == rows[2]


def test_empty_tables(spark):
    docs, items = corpus(1, n=5)
    assert found(spark, docs[:0] or [(1, None)], items, 5) == {}
    assert found(spark, docs, [(1, None)], 5) == {}
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(d), q).count() == 0


def segment(seed, n_docs=900):
    """A segment of random postings and the same as plain lists."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, n_docs)
    numbers = [np.sort(rng.zipf(1.3, n) % 5_000).astype(np.uint64) for n in lengths]
    numbers[3][:] = 7
    doc = np.repeat(np.arange(n_docs), lengths)
    found = ranked_search._inverted(np.concatenate(numbers), doc, lengths)
    packed = {c: found[c].astype(kind).tobytes() for c, kind in ranked_search.ARRAYS.items()}
    return ranked_search.Segment(packed, ranked_search.Corpus(n_docs, int(lengths.sum()))), numbers


def test_postings_round_trip_and_block_maxima():
    own, numbers = segment(1)
    for place, term in enumerate(own.terms.tolist()):
        doc, value = own.whole_list(place)
        want = [d for d, t in enumerate(numbers) if (t == term).any()]
        assert doc.tolist() == want
        tf = np.array([(numbers[d] == term).sum() for d in want])
        assert (value == ranked_search.impact(tf, own.norm[want])).all()
        for b in range(own.block_at[place], own.block_at[place + 1]):
            assert own.decompress(np.array([b]))[1].max() == own.block_max[b]
        assert own.list_max[place] == value.max()
        if place > 150:
            break


def test_a_threshold_spares_blocks():
    """With a threshold known, blocks of common terms stay closed, and the result is that of all blocks."""
    own, numbers = segment(2, 3_000)
    df = np.diff(own.block_at)
    common = np.argsort(-df, kind="stable")[:6]
    rare = np.argsort(df, kind="stable")[200:203]
    places = np.concatenate([rare, common])
    weights = np.concatenate([np.full(3, 9_000), np.full(6, 40)])
    doc, score = own.search(places, weights, 0, 10)
    own.opened, read = {}, own.blocks_read
    own.blocks_read = 0
    again, same = own.search(places, weights, int(score.min()), 10)
    assert own.blocks_read < 0.6 * read and set(zip(again, same)) == set(zip(doc, score))
    assert (own.scores == 0).all()


def test_a_task_holds_few_segments(spark, monkeypatch, tmp_path):
    """Segments of one file lie in row groups of their own, and a search is sent a few of them at a time."""
    import pyarrow.parquet as pq

    from trapline import session

    monkeypatch.setitem(session.LARGE_ROWS, "parquet.block.size", "2000")
    docs, _ = corpus(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = ranked_search.build_index(d, segment_bytes=8_000)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    assert sum(f.num_row_groups for f in files) >= index.count() // 2 > 5
    before = spark.conf.get(session.BATCH_BYTES)
    with session.small_batches(spark):
        held = index.select("terms").withColumn("terms", F.repeat(F.lit("x"), 3 << 20)).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "terms string")
        assert held.count() >= index.count() // 2
    assert spark.conf.get(session.BATCH_BYTES) == before
