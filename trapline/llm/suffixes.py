"""Suffix-array dedup: every byte in a string of LENGTH bytes that starts anywhere else, too, is removed.

Sorting all suffixes of a corpus would move each byte two hundred times. Only suffixes that can have a twin are sorted:

1. Every string of LENGTH bytes has an anchor, the place of the least number among the tokens (TOKEN bytes each) in
   it, the first on ties. Equal strings have equal anchors at equal offsets. Strings that share one anchor are
   neighbours; they and the bytes around them are a region. Regions are dealt out by the number of their leading
   token, the one at the anchor. A region that occurs twice as a whole is settled. One whose leading token occurs
   nowhere else is dropped. What is left are the regions at the ends of repeated passages.
2. Splitters from a sample of their leading tokens part these regions into ranges. In a bucket the suffixes of a
   leading token are sorted by multikey quicksort, eight bytes at a time, where groups of one leave early. Regions are
   compared across the boundaries of documents and buckets alike: a leading token is never split, except one with
   more than HOT regions, whose suffixes are grouped by Spark as rows of their own.
3. Per document the starts that were found give the bytes to remove.

Matches never cross documents. A null text is empty. Texts shorter than LENGTH lose nothing. Rows are told apart even
if ids and texts repeat, so the copies of a repeated row of LENGTH bytes or more lose all. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.groups import groups, side_by_side
from trapline.llm.words import _BASE, _BYTE, mix, powers
from trapline.session import cut

LENGTH = 200
TOKEN = 100
HOT = 20_000
SLOT_REGIONS = 300_000
SEGMENT_BYTES = 1 << 20
PLACE_BITS = 24

REGION = np.dtype([("token", "<u4"), ("whole", "<u8"), ("row", "<i8"), ("start", "<u4"), ("left", "u1"), ("span", "u1"), ("many", "u1")])

_inverse = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of the base's powers, modulo 2**64."""
    global _inverse
    if len(_inverse) < n:
        one = np.uint64(pow(int(_BASE), -1, 1 << 64))
        grown = np.full(max(n, 2 * len(_inverse)), one, dtype=np.uint64)
        grown[0] = 1
        _inverse = np.cumprod(grown)
    return _inverse[:n]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, from running minima of blocks."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, at: np.ndarray, length: int = LENGTH, token: int = TOKEN) -> tuple[np.ndarray, ...]:
    """(text, start, left, span, number of the leading token, number of the region) of all regions of some texts.

    A region's strings start at start .. start + span, its anchor is at start + left; places count from the first text.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * powers(len(data)), dtype=np.uint64)))
    inverse = inverse_powers(len(data))
    numbers = mix((sums[token:] - sums[:-token]) * inverse[: len(data) - token + 1])
    place = np.uint64((1 << PLACE_BITS) - 1)
    marked = (numbers & ~place) | np.arange(len(numbers), dtype=np.uint64)
    anchor = (sliding_least(marked, length - token + 1) & place).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    fits = np.flatnonzero(np.diff(at) >= length)
    inside[at[fits]] += 1
    np.add.at(inside, at[fits + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    own = anchor[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    low, high, own = start[first], start[np.append(first[1:], len(start)) - 1], own[first]
    shape = ((own - low) << 8 | (high - low)).astype(np.uint64)
    whole = mix((sums[high + length] - sums[low]) * inverse[low] + mix(shape))
    text = np.searchsorted(at, low, side="right") - 1
    return text, low, own - low, high - low, numbers[own], whole


def texts_with_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, z): every row with a number of its own and its text, compressed; written once."""
    import zstandard

    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["row", key, "z"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), key, text)
    return cut(numbered.mapInArrow(work, f"row bigint, `{key}` {kind}, z binary"))


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where each piece begins, its row, its place in the text), about SEGMENT_BYTES at a time.

    A longer text comes in pieces that overlap by less than one string, so each string is whole in just one piece.
    """
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    held, size = [], 0

    def put_together():
        at = np.concatenate(([0], np.cumsum([len(p) for p, _, _ in held])))
        data = np.frombuffer(b"".join(p for p, _, _ in held), dtype=np.uint8)
        return data, at, np.array([r for _, r, _ in held]), np.array([s for _, _, s in held])

    for batch in batches:
        for row, z in zip(batch.column("row").to_pylist(), batch.column("z").to_pylist()):
            body = unpack.decompress(z)
            for begin in range(0, max(1, len(body) - length + 1), SEGMENT_BYTES):
                piece = body[begin : begin + SEGMENT_BYTES + length - 1]
                held.append((piece, row, begin))
                size += len(piece)
                if size >= SEGMENT_BYTES:
                    yield put_together()
                    held, size = [], 0
    if held:
        yield put_together()


def deal_regions(texts: DataFrame, slots: int, length: int, token: int) -> DataFrame:
    """(slot, regions): all regions, packed, by the number of their leading token; slot -1 has those that a task has
    seen twice as a whole, of which one more goes to its slot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, at, rows, begins in _segments(batches, length):
            text, low, left, span, number, whole = regions(data, at, length, token)
            found = np.zeros(len(low), dtype=REGION)
            found["token"], found["whole"] = number & np.uint64(0xFFFFFFFF), whole
            found["row"], found["start"] = rows[text], low - at[text] + begins[text]
            found["left"], found["span"] = left, span
            slot = ((number >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
            _, first, back, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            found["many"] = twice
            out = [(-1, found[twice].tobytes())] if twice.any() else []
            slot, found = slot[first], found[first]
            order = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(np.diff(slot[order])) + 1
            out += [(int(slot[p[0]]), found[p].tobytes()) for p in (np.split(order, cuts) if len(order) else [])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["slot", "regions"])

    return cut(texts.select("row", "z").mapInArrow(work, "slot bigint, regions binary"))


SETTLED = "row bigint, start bigint, stop bigint"
OPEN = "token bigint, row bigint, start bigint, left int, span int, many boolean, hot boolean"


def meet_regions(dealt: DataFrame, hot: int) -> DataFrame:
    """Regions that occur twice as a whole (`token` is null), and those that share their leading token with others."""

    def work(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        all_ = np.frombuffer(b"".join(table.column("regions").to_pylist()), dtype=REGION)
        all_ = all_[np.lexsort((all_["whole"], all_["token"]))]
        new_token = np.append(True, all_["token"][1:] != all_["token"][:-1])
        new_whole = new_token | np.append(True, all_["whole"][1:] != all_["whole"][:-1])
        first = np.flatnonzero(new_whole)
        which = np.cumsum(new_whole) - 1
        times = np.diff(np.append(first, len(all_)))
        many = (times > 1) | np.logical_or.reduceat(all_["many"] > 0, first)
        token_of = (np.cumsum(new_token) - 1)[first]
        kinds = np.bincount(token_of)
        singles = np.bincount(token_of, weights=~many)
        wanted = (kinds[token_of] > 1) & (singles[token_of] > 0)
        settled, open_ = all_[many[which]], all_[first[wanted]]
        size = len(settled) + len(open_)
        empty = pa.nulls(len(settled), pa.int64())
        both = np.concatenate([settled, open_])
        names = (slot << 32) + open_["token"].astype(np.int64)
        flag = lambda x: pa.array(np.concatenate([np.zeros(len(settled), dtype=bool), x]))
        assert len(both) == size
        return pa.table({
            "token": pa.concat_arrays([empty, pa.array(names, pa.int64())]),
            "row": pa.array(both["row"].astype(np.int64)), "start": pa.array(both["start"].astype(np.int64)),
            "left": pa.array(both["left"].astype(np.int32)), "span": pa.array(both["span"].astype(np.int32)),
            "many": flag(many[wanted]), "hot": flag(kinds[token_of][wanted] > hot),
        })

    return cut(dealt.where(F.col("slot") >= 0).groupBy("slot").applyInArrow(work, OPEN))


def region_bytes(open_: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Adds `body`, the bytes of every region."""
    import zstandard

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, row, body = zstandard.ZstdDecompressor(), None, b""
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "start", "span", "z")]
            bodies = []
            for r, start, span, z in zip(*columns):
                if r != row:
                    row, body = r, unpack.decompress(z)
                bodies.append(body[start : start + span + length])
            kept = batch.select(["bucket", "token", "row", "start", "left", "span", "many", "hot"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bodies, pa.binary())], [*kept.schema.names, "body"])

    rows = open_.join(texts.select("row", "z"), "row").select("bucket", "token", "row", "start", "left", "span", "many", "hot", "z")
    return rows.mapInArrow(work, f"bucket int, {OPEN}, body binary")


def multikey_sort(words: np.ndarray, place: np.ndarray, group: np.ndarray, count: int) -> np.ndarray:
    """Which suffixes equal another one of their group in `count` words of eight bytes.

    `words` has the word that begins at every byte. Each round splits the groups by their next word and drops those
    of one suffix, as multikey quicksort does with a pivot's smaller, equal and greater suffixes.
    """
    twin = np.zeros(len(place), dtype=bool)
    active = np.arange(len(place))
    for depth in range(count):
        if len(active) == 0:
            return twin
        word = words[place[active] + 8 * depth]
        order = np.lexsort((word, group[active]))
        active, word = active[order], word[order]
        own = group[active]
        new = np.append(True, (own[1:] != own[:-1]) | (word[1:] != word[:-1]))
        number = np.cumsum(new) - 1
        group[active] = number
        active = active[np.bincount(number)[number] > 1]
    twin[active] = True
    return twin


def _windows(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """The bytes of some regions in a row, and per string: its place there, region, offset of the anchor."""
    body = table.column("body").combine_chunks()
    sizes = np.array([len(b) for b in body.to_pylist()], dtype=np.int64)
    data = np.frombuffer(b"".join(body.to_pylist()), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes
    count = table.column("span").to_numpy().astype(np.int64) + 1
    region = np.repeat(np.arange(len(count)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return data, base[region] + step, region, table.column("left").to_numpy().astype(np.int64)[region] - step, step


def _as_runs(rows: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows and starts of strings that go, in order, as runs of bytes."""
    new = np.append(True, (rows[1:] != rows[:-1]) | (starts[1:] - starts[:-1] != 1)) if len(rows) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[first], pa.int64()), pa.array(starts[first], pa.int64()), pa.array(starts[last] + length if len(first) else starts, pa.int64())],
        ["row", "start", "stop"],
    )


def sort_buckets(found: DataFrame, length: int) -> DataFrame:
    """(row, start, stop): the bytes of strings with a twin among the regions of their leading token."""

    def judge(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        data, place, region, offset, step = _windows(table, length)
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        words = sum(padded[k : k + len(data)] << np.uint64(56 - 8 * k) for k in range(8))
        _, token = np.unique(table.column("token").to_numpy(), return_inverse=True)
        group = np.unique(token[region] * np.int64(256) + offset, return_inverse=True)[1]
        twin = multikey_sort(words, place, group, length // 8)
        many = table.column("many").to_numpy()
        out = np.flatnonzero(twin & ~many[region])
        return _as_runs(table.column("row").to_numpy()[region[out]], table.column("start").to_numpy()[region[out]] + step[out], length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in groups(batches, 2):
            held.append(table)
            size += table.num_rows
            if size >= HOT // 2:
                yield judge(held)
                held, size = [], 0
        if held:
            yield judge(held)

    ordered = side_by_side(found.where(~F.col("hot")).drop("hot"), "bucket", "token")
    return ordered.select("bucket", "token", "row", "start", "left", "span", "many", "body").mapInArrow(work, SETTLED)


def group_hot(found: DataFrame, length: int) -> DataFrame:
    """The same for leading tokens with too many regions for one task: every string is a row of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                table = pa.Table.from_batches([batch.slice(at, 500)])
                data, place, region, offset, step = _windows(table, length)
                raw = data.tobytes()
                pick = lambda c: table.column(c).to_numpy()[region]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick("token")), pa.array(offset.astype(np.int32)), pa.array([hashlib.blake2b(raw[p : p + length], digest_size=16).digest() for p in place.tolist()], pa.binary()),
                     pa.array(pick("row")), pa.array(pick("start") + step), pa.array(pick("many"))],
                    ["token", "offset", "string", "row", "start", "many"],
                )

    strings = cut(found.where("hot").select("token", "row", "start", "left", "span", "many", "body").mapInArrow(
        work, "token bigint, offset int, string binary, row bigint, start bigint, many boolean"
    ))
    by = ["token", "offset", "string"]
    often = strings.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    twins = strings.where(~F.col("many")).join(often.select(*by), by)
    return twins.select("row", "start", (F.col("start") + length).alias("stop"))


def repeated_bytes(texts: DataFrame, length: int = LENGTH, token: int = TOKEN, hot: int = HOT) -> DataFrame:
    """(row, start, stop): runs of bytes to remove; runs may overlap."""
    size = texts.agg(F.coalesce(F.sum(F.length("z")), F.lit(0))).first()[0]
    slots = max(1, int(size // (16 * SLOT_REGIONS)))
    dealt = deal_regions(texts, slots, length, token)
    met = meet_regions(dealt, hot)
    ends = F.col("start") + F.col("span") + length
    settled = met.where(F.col("token").isNull()).select("row", "start", ends.alias("stop"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = np.frombuffer(raw, dtype=REGION)
                start = found["start"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["row"].astype(np.int64)), pa.array(start), pa.array(start + found["span"] + length)], ["row", "start", "stop"]
                )

    twice = dealt.where(F.col("slot") < 0).select("regions").mapInArrow(local, SETTLED)
    open_ = met.where(F.col("token").isNotNull())
    counted = open_.agg(F.count("*").alias("n"), F.max("hot").alias("hot")).first()
    if not counted.n:
        return settled.unionByName(twice)
    ranges = max(1, counted.n // HOT)
    splitters = open_.agg(F.percentile_approx("token", [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()[0]
    bucket = F.size(F.filter(F.array(*[F.lit(s) for s in sorted(set(splitters))]), lambda s: s < F.col("token")))
    found = region_bytes(open_.withColumn("bucket", bucket), texts, length)
    found = cut(found) if counted.hot else found
    out = settled.unionByName(twice).unionByName(sort_buckets(found, length))
    return out.unionByName(group_hot(found, length)) if counted.hot else out


def remove_repeated_bytes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, token: int = TOKEN, hot: int = HOT
) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept): per row the removed runs as (start, stop) and the bytes that stay."""
    import zstandard

    texts = texts_with_rows(docs, key, text)
    runs = repeated_bytes(texts, length, token, hot)
    per_row = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for z, found in zip(batch.column("z").to_pylist(), batch.column("runs")):
                body, merged = unpack.decompress(z), []
                if found.is_valid:
                    flat = found.values.flatten()
                    start, stop = flat[0].to_numpy(), flat[1].to_numpy()
                    reach = np.maximum.accumulate(stop)
                    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                    merged = list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist()))
                ends = [0, *[x for span in merged for x in span], len(body)]
                n_bytes.append(len(body))
                n_removed.append(sum(b - a for a, b in merged))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                [key, "n_bytes", "n_removed", "spans", "kept"],
            )

    joined = texts.join(per_row, "row", "left").select(key, "z", "runs")
    schema = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    return joined.mapInArrow(work, schema)
