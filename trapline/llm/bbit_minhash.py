"""b-bit MinHash: near copies by bands of minima, short signatures, and an exact check.

1. Every text becomes a set of shingle numbers, and K minima of it under K hash functions. Rows with equal sets (by a
   128-bit digest) form a class; a class is joined once, whatever the number of its copies.
2. Bands of R minima are buckets. Two classes of similarity s meet in none of them with a chance of (1 - s**R)**BANDS:
   6e-9 at 0.85, less above.
3. Of each minimum only the low B bits are kept, packed as bit planes. Different minima agree in them with a chance of
   2**-B, so m of K agreeing places estimate the similarity as (m / K - 2**-B) / (1 - 2**-B). A pair whose m lies
   DEVIATIONS standard deviations or more below what the threshold gives is rejected by a count of bits; for a pair at
   the threshold that happens with a chance below 1e-6. All other pairs are confirmed on their full sets.
4. In every bucket all members are first compared with one of them, its hub, so a bucket of copies costs one pair a
   member. Buckets that this leaves in more than one component are compared member by member inside the tasks, in
   blocks of bounded size, each pair in the first bucket it shares; only links leave a task.
Components come from alternating stars. Hot buckets are split into blocks, and no task holds a bucket.

A text without words (null, empty, blank) has an empty set, and is alone. A text with fewer words than a shingle has its
whole sequence as its only one. Rows with equal ids each get a row; an empty table gives no rows; other columns are
ignored. The component of rows with null ids only is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.components import components
from trapline.llm.groups import unpack_texts
from trapline.llm.words import chunks, mix, shingle_sets
from trapline.session import cut

WIDTH = 5
PERCENT = 85
BANDS = 32
ROWS = 5
KEPT_BITS = 4
DEVIATIONS = 5.0
BLOCK = 1024
SLICE = 100_000  # pairs whose signatures a task compares at a time

K = BANDS * ROWS
_FACTORS = np.random.default_rng(71).integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_KEYS = np.random.default_rng(72).integers(0, 1 << 63, K, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of K 32-bit minima for every set; the sets are not empty."""
    numbers = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), K), dtype=np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(numbers * factor, starts) >> np.uint64(32)
    return out


def band_numbers(found: np.ndarray) -> np.ndarray:
    """(sets, BANDS): one number for the minima of each band and the band itself."""
    spread = mix(found.astype(np.uint64) ^ _BAND_KEYS)
    return mix(spread.reshape(len(found), BANDS, ROWS).sum(axis=2, dtype=np.uint64)).view(np.int64)


def pack(found: np.ndarray) -> np.ndarray:
    """(sets, KEPT_BITS * K / 8) bytes: the planes of the low bits of all minima."""
    planes = [np.packbits(((found >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), axis=1) for p in range(KEPT_BITS)]
    return np.concatenate(planes, axis=1)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the K places the kept bits of two packed signatures (one a row) are equal."""
    apart = (a ^ b).reshape(len(a), KEPT_BITS, K // 8)
    return K - np.bitwise_count(np.bitwise_or.reduce(apart, axis=1)).sum(axis=1).astype(np.int64)


def similarity(places: np.ndarray) -> np.ndarray:
    """The similarity that so many agreeing places estimate, corrected for minima that agree by chance."""
    chance = 2.0**-KEPT_BITS
    return (places / K - chance) / (1 - chance)


def least_places(percent: int) -> int:
    """Fewer agreeing places than these reject a pair."""
    chance = 2.0**-KEPT_BITS
    p = chance + (1 - chance) * percent / 100
    return int(np.floor(K * p - DEVIATIONS * np.sqrt(K * p * (1 - p))))


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, digest, bands, signature, z) of every row; z is its text, compressed. Without words all but key and n
    are null."""
    import zstandard

    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            for part in chunks(rows, text):
                sets = shingle_sets(part.column(1), width)
                full = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
                bands, packed = [None] * len(sets), [None] * len(sets)
                if len(full):
                    found = minima([sets[k] for k in full])
                    numbers, signatures = band_numbers(found), pack(found)
                    for k, own, signature in zip(full, numbers, signatures):
                        bands[k], packed[k] = own, signature.tobytes()
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                z = [squeeze.compress(t.encode()) if len(s) else None for t, s in zip(part.column(1).to_pylist(), sets)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(z, pa.binary())],
                    [key, "n", "digest", "bands", "signature", "z"],
                )

    schema = f"`{key}` {kind}, n bigint, digest binary, bands array<bigint>, signature binary, z binary"
    return docs.select(F.col(key), F.col(text)).mapInArrow(work, schema)


def set_classes(marked: DataFrame, key: str) -> DataFrame:
    """(cls, digest, id, n, bands, signature, z): one row for all rows with equal sets, `id` their least."""
    one = F.first(F.struct("n", "bands", "signature", "z")).alias("x")
    grouped = marked.where(F.col("n") > 0).groupBy("digest").agg(F.min(key).alias("id"), one)
    return cut(grouped.select(F.monotonically_increasing_id().alias("cls"), "digest", "id", "x.*"))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and kept bits allow the similarity."""
    least = least_places(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            one, two = (_matrix(rows.column(c)) for c in ("s_a", "s_b"))
            yield rows.select(["a", "b"]).filter(pa.array(agreeing(one, two) >= least, pa.bool_()))

    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "s_a", "s_b").mapInArrow(work, "a bigint, b bigint")


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), dtype=np.uint8).reshape(len(signatures), KEPT_BITS * K // 8)


def confirmed(pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. Of all pairs of a row's texts each text is taken apart once a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                sets = []
                for name in ("a", "b"):
                    _, first, place = np.unique(part.column(name).to_numpy(), return_index=True, return_inverse=True)
                    distinct = shingle_sets(unpack_texts(part.column(f"z_{name}").take(pa.array(first))), width)
                    sets.append([distinct[k] for k in place])
                alike = [_linked(x, y, percent) for x, y in zip(*sets)]
                yield part.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    side = lambda c: classes.select(F.col("cls").alias(c), F.col("z").alias(f"z_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "z_a", "z_b")
    return joined.mapInArrow(work, "a bigint, b bigint")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[place] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _block(size, by, block: int):
    return F.pmod(F.xxhash64(by), F.ceil(size / block)).cast("bigint")


def meetings(met: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """(bucket, one, two, chunk, cls, comp): members of the buckets in more than one component, in blocks that meet.

    A component with more than a block of a bucket's members has blocks of its own, which do not meet each other.
    """
    placed = met.join(comps.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls")
    )
    # A bucket of two was decided by its hub, and so was one whose members but the hub are in one component.
    others = F.when(F.col("cls") != F.col("hub"), F.col("comp"))
    open_ = placed.groupBy("bucket").agg(F.min(others).alias("lo"), F.max(others).alias("hi")).where(F.col("lo") != F.col("hi"))
    members = cut(placed.join(open_.select("bucket"), "bucket").where(F.col("cls") != F.col("hub")))
    zero = F.lit(0).cast("bigint")
    small = members.where(F.col("size") <= block).select("bucket", zero.alias("one"), zero.alias("two"), zero.alias("chunk"), "cls", "comp")
    big = members.where(F.col("size") > block)
    own = big.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    alone = F.col("m") > block
    chunk = F.when(alone, F.xxhash64("comp", _block(F.col("m"), F.col("cls"), block))).otherwise(_block(F.col("size"), F.col("comp"), block))
    chunked = cut(big.join(own, ["bucket", "comp"]).select("bucket", "cls", "comp", chunk.alias("chunk"), alone.alias("alone")))
    nodes = chunked.groupBy("bucket", "chunk").agg(F.max(F.when(F.col("alone"), F.col("comp"))).alias("only"))
    one, two = (nodes.select("bucket", F.col("chunk").alias(c), F.col("only").alias(f"only_{c}")) for c in ("one", "two"))
    meet = one.join(two, "bucket").where(
        (F.col("one") <= F.col("two")) & ~F.coalesce(F.col("only_one") == F.col("only_two"), F.lit(False))
    ).select("bucket", "one", "two")
    sides = meet.withColumn("chunk", F.explode(F.array_distinct(F.array("one", "two"))))
    large = sides.join(chunked, ["bucket", "chunk"]).select("bucket", "one", "two", "chunk", "cls", "comp")
    return small.unionByName(large)


def across(met: DataFrame, comps: DataFrame, classes: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(a, b): links between members of a bucket, other than its hub, that are in two components.

    A pair is judged in the first bucket that it shares: by sizes and kept bits, then, unless links found before connect
    it already, by its sets. Of what is compared only links leave the task.
    """
    least = least_places(percent)

    def near(table: pa.Table, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one group that their sizes and kept bits allow to be alike."""
        comp, n, bucket, one, two, chunk = (table.column(c).to_numpy() for c in ("comp", "n", "bucket", "one", "two", "chunk"))
        packed = _matrix(table.column("signature").combine_chunks())
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        end = np.repeat(np.append(new[1:], len(comp)), np.diff(np.append(new, len(comp))))
        here, step, found = np.arange(len(comp)), 0, []
        while True:
            step += 1
            here = here[here + step < end[here]]
            if len(here) == 0:
                break
            there = here + step
            fits = (comp[here] != comp[there]) & ((chunk[here] == chunk[there]) == (one[here] == two[here]))
            small, large = np.minimum(n[here], n[there]), np.maximum(n[here], n[there])
            i = here[fits & (100 * small >= percent * large)]
            for at in range(0, len(i), SLICE):
                x = i[at : at + SLICE]
                x = x[agreeing(packed[x], packed[x + step]) >= least]
                first = (bands[x] == bands[x + step]).argmax(axis=1)
                x = x[bands[x, first] == bucket[x]]
                found.append((x, x + step))
        if not found:
            return here, here
        i, j = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((j, i))
        return i[order], j[order]

    def links(table: pa.Table) -> pa.RecordBatch:
        i, j = near(table, _starts(table))
        cls, comp, z = table.column("cls").to_numpy(), table.column("comp").to_numpy(), table.column("z").combine_chunks()
        used, place = np.unique(cls[np.concatenate([i, j])], return_inverse=True)
        row_of = np.zeros(len(used), dtype=np.int64)
        row_of[place] = np.concatenate([i, j])
        sets: list[np.ndarray] = []
        for at in range(0, len(used), 500):
            sets += shingle_sets(unpack_texts(z.take(pa.array(row_of[at : at + 500]))), width)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y, one, two in zip(place[: len(i)].tolist(), place[len(i) :].tolist(), comp[i].tolist(), comp[j].tolist()):
            one, two = root(one), root(two)
            if one != two and _linked(sets[x], sets[y], percent):
                parent[max(one, two)] = min(one, two)
                out.append((used[x], used[y]))
        both = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def _starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in by:
            column = table.column(c).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            if rows.num_rows == 0:
                continue
            held = pa.Table.from_batches([rows] if held is None else [*held.to_batches(), rows])
            last = int(_starts(held)[-1])  # the last group may go on in the next batch
            if last:
                yield links(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield links(held)

    by = ["bucket", "one", "two"]
    rows = meetings(met, comps, block).join(classes.select("cls", "n", "bands", "signature", "z"), "cls")
    dealt = rows.select(*by, "chunk", "cls", "comp", "n", "bands", "signature", "z").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(work, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: the smallest id that links reach, the row's own included, and
    whether that is its own. Two rows are linked if 100 * intersection >= percent * union of their sets of shingles."""
    marked = cut(sketches(docs, key, text, width))
    classes = set_classes(marked, key)
    entries = classes.select("cls", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("cls").alias("hub"), F.count("*").alias("size")).where(F.col("size") > 1)
    met = cut(entries.join(buckets, "bucket"))
    star = met.where(F.col("cls") != F.col("hub")).select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    links = cut(confirmed(cut(likely(star, classes, percent)), classes, width, percent))
    comps = components(links, "a", "b")
    more = cut(across(met, comps, classes, width, percent, block))
    if not more.isEmpty():
        comps = components(links.unionByName(more), "a", "b")
    rooted = classes.select("cls", "digest", "id").join(comps.select(F.col("node").alias("cls"), "root"), "cls", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("digest", "component_id")
    empty = F.col("n") == 0
    joined = marked.where(~empty).select(key, "n", "digest").join(named, "digest").select(key, "n", "component_id")
    alone = marked.where(empty).select(key, "n", F.col(key).alias("component_id"))
    return joined.unionByName(alone).select(
        key, F.col("n").alias("n_shingles"), "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept")
    )


#: The same rows in SQL, by all pairs that share a shingle.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as g
  from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n
  having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union select r.doc_id, l.y from reach r join links l on l.x = r.other)
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other)::bigint as component_id, doc_id = min(other) as kept
from reach left join n using (doc_id) group by doc_id
"""
