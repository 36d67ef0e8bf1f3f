"""Shards: the permutation, and a round trip through the files."""

import zlib

import numpy as np
import pytest

from trapline.llm import shards, tokens
from trapline.llm.registry import CHECKS, table


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation(n):
    p, q = shards.Permutation(n, 7), shards.Permutation(n, 8)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (p.ordinal(slots) == np.arange(n)).all()
    assert n < 100 or (slots != q.slot(np.arange(n))).any()


def expected_stream(texts):
    encoder = tokens.encoder()
    ids, _ = encoder.encode_documents(__import__("pyarrow").array(texts, "string"))
    return ids


def check(index, manifest, docs, length):
    """Ordinals undo the permutation; in order of ordinals the shards hold the stream of the documents."""
    rows = sorted(index.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(manifest["sequences"]))
    read = list(shards.read_slots(manifest, 0, len(rows)))
    assert len(read) == len(rows)
    for r, ids in zip(rows, read):
        assert r.shard == r.slot // manifest["shard_slots"] and r.byte_offset == r.slot % manifest["shard_slots"] * length * 2
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and (ids[r.n_tokens:] == 0).all()
    order = np.argsort([r.ordinal for r in rows])
    stream = np.concatenate([read[k][: rows[k].n_tokens] for k in order]) if rows else np.zeros(0)
    assert (np.sort(stream) == np.sort(expected_stream([t for _, t in docs]))).all()
    by_doc = {}
    for k in order:
        for d in rows[k].doc_ids:
            by_doc.setdefault(d, []).append(rows[k])
    assert set(by_doc) == {d for d, _ in docs}
    return rows, read, stream


def test_round_trip(spark):
    docs = [(i, "word " * (i % 23) + f"number {i}") for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "x y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", __import__("pyspark.sql.functions").sql.functions.lit("z"))
    index, manifest = shards.materialise(df.coalesce(1), length=16, shard_slots=4)
    rows, read, stream = check(index, manifest, docs, 16)
    assert (stream == expected_stream([t for _, t in docs])).all()  # one partition: the very order
    for first in (0, 1, 5, len(rows) - 1):
        again = list(shards.read_slots(manifest, first, 7))
        assert len(again) == min(7, len(rows) - first) and all((a == b).all() for a, b in zip(again, read[first:]))


def test_no_rows(spark):
    index, manifest = shards.materialise(spark.createDataFrame([], "doc_id long, text string"))
    assert index.count() == 0 and manifest["sequences"] == 0 and list(shards.read_slots(manifest, 0, 5)) == []


def test_registered(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    index, manifest = shards.materialise(table(spark, sf_dir, "documents").repartition(5))
    check(index, manifest, docs, shards.LENGTH)
    assert CHECKS["op2_training_shards"][0](spark, sf_dir).count() >= manifest["sequences"] - 5
