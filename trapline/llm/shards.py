"""Training-order materialisation: every sequence of token ids gets a slot of a keyed permutation, and shards hold the
slots in order at a fixed stride.

1. A task reads its documents as one stream of ids, an end id behind each, and cuts it into sequences of `length`;
   the last one is padded. Sequences are written once, their ids compressed.
2. Counts per partition give every sequence an ordinal, without gaps. A Feistel network keyed by the seed permutes a
   power of four that holds all ordinals; a value beyond the last ordinal is put through it again until it is not one
   (cycle-walking), which leaves a permutation of exactly the ordinals: the slots.
3. Ranges of slots are dealt to tasks by their number, sorted, and written as shards of `shard_slots` sequences.
   Sequence s lies in shard s // shard_slots at byte (s % shard_slots) * stride, so a reader starts or resumes
   anywhere with one seek, and reads a shard to its end in training order.

A shard is written under a name of its attempt and renamed when whole, so a task that is repeated after a lost
executor replaces the same file with the same bytes. A null text is empty: its document is the end id alone. Repeated
ids are kept row by row; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.tokens import CHUNK_BYTES, END_ID, encoder
from trapline.llm.words import chunks, mix
from trapline.operators.ordinals import with_running_sum
from trapline.session import cut, shared_path

LENGTH = 2048
SHARD_SLOTS = 1024
PAD_ID = 0
ID_TYPE = "<u2"  # for vocabularies of up to 65,536 ids; "<u4" for others
ROUNDS = 6
SEED = 2001


class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        digest = hashlib.blake2b(str(seed).encode(), digest_size=8 * 8).digest()
        keys = np.frombuffer(digest, dtype="<u8")
        self.keys = [mix(keys[[r % 8]] + np.uint64(r))[0] for r in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix(right ^ key) & self.mask)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ (mix(left ^ key) & self.mask), left
        return left << self.half | right

    def _walk(self, step, x: np.ndarray) -> np.ndarray:
        x = step(np.asarray(x).astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slot(self, ordinal: np.ndarray) -> np.ndarray:
        return self._walk(self._once, ordinal)

    def ordinal(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(self._back, slot)


def sequences(
    docs: DataFrame, key: str, text: str, length: int, vocabulary: str | None, end_id: int, id_type: str, pad_id: int
) -> DataFrame:
    """(part, nr, n_tokens, keys, ids): the sequences of each partition in order; `keys` has the documents in them."""
    import zstandard

    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, number = zstandard.ZstdCompressor(level=3), 0
        part, key_type = TaskContext.get().partitionId(), None
        rest, owners = np.zeros(0, dtype=np.uint32), []  # ids not yet written, and (document, first of its ids there)

        def cut_off(whole: bool) -> pa.RecordBatch:
            nonlocal rest, owners, number
            count = -(-len(rest) // length) if whole else len(rest) // length
            starts = np.array([s for _, s in owners] + [len(rest)], dtype=np.int64)
            rows = []
            for k in range(count):
                a, b = k * length, min((k + 1) * length, len(rest))
                ids = np.full(length, pad_id, dtype=id_type)
                ids[: b - a] = rest[a:b]
                first = int(np.searchsorted(starts, a, side="right")) - 1
                last = int(np.searchsorted(starts, b, side="left"))
                rows.append((part, number, b - a, [owners[o][0] for o in range(first, last)], pack.compress(ids.tobytes())))
                number += 1
            done = min(count * length, len(rest))
            first = max(0, int(np.searchsorted(starts, done, side="right")) - 1)
            owners = [(o, s - done) for o, s in owners[first:]] if done < len(rest) else []
            rest = rest[done:]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(key_type), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "nr", "n_tokens", "keys", "ids"])

        for batch in batches:
            key_type = batch.column(0).type
            for chunk in chunks(batch, text, CHUNK_BYTES):
                ids, at = encoder(vocabulary).encode_documents(chunk.column(1), end_id)
                owners += [(k, int(s) + len(rest)) for k, s in zip(chunk.column(0).to_pylist(), at[:-1])]
                rest = np.concatenate([rest, ids])
                yield cut_off(whole=False)
        if len(rest):
            yield cut_off(whole=True)

    schema = f"part int, nr bigint, n_tokens bigint, keys array<{kind}>, ids binary"
    return cut(docs.select(key, text).mapInArrow(work, schema))


def with_slots(found: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Adds `ordinal` and `slot`; and how many sequences there are."""
    sizes = cut(found.groupBy("part").agg(F.count("*").alias("n")))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bases = with_running_sum(sizes, [], F.floor(F.col("part") / 1000), ["part"], {"base": F.col("n")}, inclusive=False)

    @F.pandas_udf("bigint")
    def slot(ordinal: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).slot(ordinal.to_numpy()))

    placed = found.join(bases.select("part", "base"), "part").withColumn("ordinal", F.col("base") + F.col("nr"))
    return placed.drop("base").withColumn("slot", slot("ordinal")), n


def _write_shards(path: str, length: int, shard_slots: int, id_type: str, key: str):
    stride = length * np.dtype(id_type).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        unpack, attempt = zstandard.ZstdDecompressor(), TaskContext.get().taskAttemptId()
        files, root = fs.FileSystem.from_uri(path)
        shard, out = None, None

        def finish() -> None:
            if out is not None:
                out.close()
                files.move(f"{root}/.{shard}.{attempt}", f"{root}/{shard_name(shard)}")

        for batch in batches:
            slots, crc = batch.column("slot").to_pylist(), []
            for s, z in zip(slots, batch.column("ids").to_pylist()):
                if s // shard_slots != shard:
                    finish()
                    shard = s // shard_slots
                    out = files.open_output_stream(f"{root}/.{shard}.{attempt}")
                ids = unpack.decompress(z)
                crc.append(zlib.crc32(ids))
                out.write(ids)
            numbers = np.array(slots, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("ordinal"), pa.array(numbers // shard_slots), pa.array(numbers % shard_slots * stride),
                 batch.column("n_tokens"), pa.array(crc, pa.int64()), batch.column("keys")],
                ["slot", "ordinal", "shard", "byte_offset", "n_tokens", "ids_crc32", f"{key}s"],
            )
        finish()

    return work


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    shard_slots: int = SHARD_SLOTS, seed: int = SEED, vocabulary: str | None = None, end_id: int = END_ID,
    id_type: str = ID_TYPE, pad_id: int = PAD_ID,
) -> tuple[DataFrame, dict]:
    """Writes the shards to `path` (a folder all executors reach; by default one under the shared folder).

    Returns the index, one row per sequence (slot, ordinal, shard, byte_offset, n_tokens, ids_crc32 of the stored
    bytes, and the list of documents as `{key}s`), and the manifest, which is also written beside the shards.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    placed, n = with_slots(sequences(docs, key, text, length, vocabulary, end_id, id_type, pad_id), seed)
    shards = -(-n // shard_slots)
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    per_task = max(1, -(-shards // tasks))
    ranges = placed.select("slot", "ordinal", "n_tokens", "keys", "ids").repartitionById(
        max(1, -(-shards // per_task)), F.floor(F.col("slot") / (shard_slots * per_task)).cast("int")
    )
    kind = docs.schema[key].dataType.simpleString()
    schema = f"slot bigint, ordinal bigint, shard bigint, byte_offset bigint, n_tokens bigint, ids_crc32 bigint, `{key}s` array<{kind}>"
    index = cut(ranges.sortWithinPartitions("slot").mapInArrow(_write_shards(path, length, shard_slots, id_type, key), schema))
    manifest = {"path": path, "sequences": n, "length": length, "shard_slots": shard_slots, "id_type": id_type, "seed": seed}
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return index, manifest


def read_slots(manifest: dict, first: int, count: int) -> Iterator[np.ndarray]:
    """The ids of `count` slots from `first` on, in training order, from one seek per shard."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(manifest["path"])
    stride = manifest["length"] * np.dtype(manifest["id_type"]).itemsize
    last = min(first + count, manifest["sequences"])
    while first < last:
        shard, place = divmod(first, manifest["shard_slots"])
        here = min(last - first, manifest["shard_slots"] - place)
        with files.open_input_file(f"{root}/{shard_name(shard)}") as source:
            source.seek(place * stride)
            for _ in range(here):
                yield np.frombuffer(source.read(stride), dtype=manifest["id_type"])
        first += here
