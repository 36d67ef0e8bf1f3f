"""Token ids against the tokenizer itself, and packing against what a packing must satisfy."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trapline.llm import packing, tokens
from trapline.llm.registry import CHECKS, table

ODD = [
    None, "", "   ", "\n\n", "it's don't WE'LL", "Straße ÀÉÎ ÿ Ÿ İ ǅ ΑΣ Σ", "a\tb\x0bc d　e​f\x85g", "é ́x", "x.y,z .. ,, .",
    "<|endoftext|> a<|startoftext|>b", "1234 5.6 ½ ²", "###$$$ a### (b)", "日本語 кириллица", "A." * 400, "Word, word. WORD", "   \x1c\x1d",
    "z" * 30_000, "the cat " * 3_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_tokenizers(tokenizer):
    encoder = tokens.WordEncoder(tokens.vocabulary_path(), remembered=3)
    for texts in (ODD, ODD[5:9], [], [None], ODD[::-1]):
        ids, at = encoder.encode_documents(pa.array(texts, pa.string()))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [ids_of(tokenizer, t) for t in texts]


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(texts):
    encoder = tokens.encoder()
    expected = [ids_of(encoder.tokenizer, t) for t in texts]
    ids, at = encoder.encode_documents(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == expected


def test_closest_subset_is_the_best_of_all():
    draw = random.Random(4)
    for _ in range(300):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(draw.randint(1, 5))}
        free = draw.randint(0, 60)
        lengths = sorted(counts)
        sums = {sum(a * b for a, b in zip(lengths, some)) for some in product(*[range(counts[x] + 1) for x in lengths])}
        taken = packing.closest_subset(lengths, counts, free)
        assert sum(taken) == max(s for s in sums if s <= free)
        assert all(taken.count(x) <= counts[x] for x in lengths) and set(taken) <= set(lengths)


@given(st.lists(st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_windows_have_no_padding_and_lose_nothing(sizes):
    seen = defaultdict(list)
    for pieces in packing.pack_window(sizes, 16):
        total = sum(n for *_, n in pieces)
        assert total == 16 or total & (total - 1) == 0 and 0 < total < 16
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for doc, size in enumerate(sizes):
        end = 0
        for start, n in sorted(seen[doc]):
            assert start == end and n > 0
            end += n
        assert end == size


def check(rows, expected, capacity=4096):
    """rows against {doc_id: [ids of each row with this id]}."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == expected.keys()
    for key, own in docs.items():
        pieces = sorted(own, key=lambda r: r.start)
        ids = expected[key]
        assert sum(r.length for r in pieces) == len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        end = 0
        for r in pieces:
            assert r.start == end
            end += r.length
            assert zlib.crc32(np.array(ids[r.start : end], dtype="<u4").tobytes()) == r.ids_crc32
    padding = 0
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    assert padding == 0


def test_registered_packing(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = CHECKS["op4_pack"][0](spark, sf_dir).collect()
    check(rows, {k: ids_of(tokenizer, t) for k, t in texts.items()})


def test_odd_texts_and_columns(spark, tokenizer):
    schema = "doc_id long, text string, start string, key string, ids string"
    rows = [(i, t, "s", "k", "i") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, schema)
    packed = packing.pack(docs.repartition(3), with_ids=True, window_tokens=5_000).collect()
    check(packed, {i: ids_of(tokenizer, t) for i, t in enumerate(ODD)})
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed)
    assert packing.pack(docs.limit(0)).collect() == []
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert sum(r.length for r in twice) == 2 * len(ids_of(tokenizer, "a b"))
