"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups they form.

1. Every text becomes a set of shingle numbers. Documents with equal sets form a class, joined as one.
2. Prefix filter: two sets that are alike share an element among the first n - ceil(t n) + 1 of each, in any order
   that is the same for all. Rare elements come first: those that many texts share, as passages and near copies do,
   are put last. Which those are is estimated, and held to a bounded list; the estimate only affects the work.
   Classes that share a prefix element form a list; lists with equal members are one.
3. A class goes with its text to its largest list. Inside blocks of bounded size a signature tree, descended against
   itself, leaves the pairs that can be alike; they are verified by their sets, and pairs that are connected already
   are skipped. Lists of more blocks go on with a few representatives of what was connected, until one block holds
   them.
4. Lists whose members are now in one component are done. In the others, the pairs across components that can be alike
   are found: lists of few members give their pairs, which meet signatures once, however many lists they share; in
   longer ones signature trees find them, blocks of large lists pairwise (blocks inside one component never meet).
   Distinct pairs are verified by their sets.
Every pair of classes that are alike shares a list, so none is lost. Components are found by alternating stars.

A text without words (null, empty, blank) has an empty set and is alone. A text with fewer words than a shingle has
its whole sequence as its only one. Rows with equal ids each get a row; an empty table gives no rows; other columns
are ignored. The component of rows with null ids only is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.components import components
from trapline.llm.groups import groups, packed, side_by_side, unpack_texts
from trapline.llm.signature_tree import candidates, link_block, linked, possible_pairs, signature
from trapline.llm.words import chunks, shingle_sets
from trapline.session import cut, remove_tables, tables_of

WIDTH = 5
PERCENT = 80
BLOCK = 256
FEW = 32  # pairs of so many members, most of them met in several lists, take fewer bytes than the members' signatures
REPRESENTATIVES = 8
COMMON_LIST = 1_000_000  # the bound of the broadcast list of common elements: 8 MB
COMMON_COUNT = 64
COUNTED = 2_000_000  # elements a task counts at a time
SLOT_ELEMENTS = 500_000


def class_number(numbers: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(numbers.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - (-(-n * percent // 100)) + 1


def classify(docs: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, cls) of every row, and (element, times): counts of elements that repeat among a task's texts."""
    kind = docs.schema[key].dataType.simpleString()

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        element, times = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_counts=True)
        often = times >= 4
        return batch(None, None, None, element[often].view(np.int64), times[often])

    def batch(ids, n, cls, element, times) -> pa.RecordBatch:
        size = len(ids) if ids is not None else len(element)
        columns = [ids, n, cls, element, times]
        types = [key_type, *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, t) if c is None else (c if isinstance(c, pa.Array) else pa.array(c, t)) for c, t in zip(columns, types)],
            [key, "n", "cls", "element", "times"],
        )

    key_type = docs.select(key).limit(0).toArrow().schema.field(0).type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting, size = [], 0
        for rows in batches:
            for part in chunks(rows, text):
                sets = shingle_sets(part.column(1), width)
                cls = [class_number(s) for s in sets]
                yield batch(part.column(0), [len(s) for s in sets], cls, None, None)
                for c, s in zip(cls, sets):
                    if c not in seen:
                        seen.add(c)
                        waiting.append(s)
                        size += len(s)
                if size >= COUNTED:
                    yield counts(waiting)
                    waiting, size, seen = [], 0, set()
        if waiting:
            yield counts(waiting)

    found = cut(docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, n bigint, cls bigint, element bigint, times bigint"))
    return found.where(F.col("cls").isNotNull()).select(key, "n", "cls"), found.where(F.col("element").isNotNull()).select("element", "times")


def common_elements(counted: DataFrame) -> np.ndarray:
    """The most frequent elements, at most COMMON_LIST of them."""
    total = counted.groupBy("element").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON_COUNT)
    top = total.orderBy(F.desc("times"), "element").limit(COMMON_LIST).select("element").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def prefix_lists(docs: DataFrame, key: str, text: str, width: int, percent: int, common: np.ndarray, slots: int) -> DataFrame:
    """(list, cls, size): the classes that share a prefix element; `size` is the number of members of the list."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def dealt(keys: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        slot = ((keys >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cuts = np.flatnonzero(np.diff(slot[order])) + 1
        parts = np.split(order, cuts) if len(order) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(slot[p[0]]) for p in parts], pa.int64()),
             pa.array(packed("<u4", *[keys[p] & np.uint64(0xFFFFFFFF) for p in parts]), pa.binary()),
             pa.array(packed("<i8", *[cls[p] for p in parts]), pa.binary())], ["slot", "keys", "classes"],
        )

    def whole(keys: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        """Common elements are known to be shared, so they need not meet to be counted."""
        return pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array(packed("<u8", keys), pa.binary()), pa.array(packed("<i8", cls), pa.binary())],
            ["slot", "keys", "classes"],
        )

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        rare_out, common_out, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for out, write in ((rare_out, dealt), (common_out, lambda k, c: [whole(k, c)])):
                if out:
                    keys = np.concatenate([k for k, _ in out])
                    yield from write(keys, np.repeat(np.array([c for _, c in out], dtype=np.int64), [len(k) for k, _ in out]))

        for rows in batches:
            for part in chunks(rows, text):
                for numbers in shingle_sets(part.column(1), width):
                    cls = class_number(numbers)
                    if len(numbers) == 0 or cls in seen:
                        continue
                    seen.add(cls)
                    p = prefix_size(len(numbers), percent)
                    is_common = np.zeros(len(numbers), dtype=bool)
                    if len(often):
                        is_common = often[np.minimum(np.searchsorted(often, numbers), len(often) - 1)] == numbers
                    rare = numbers[~is_common][:p]
                    rare_out.append((rare, cls))
                    if len(rare) < p:
                        common_out.append((numbers[is_common][: p - len(rare)], cls))
                    size += p
                    if size >= COUNTED // 2:
                        yield from flush()
                        rare_out, common_out, size = [], [], 0
                if len(seen) > COUNTED // 4:
                    seen = set()
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype="<u4")
        cls = np.frombuffer(b"".join(table.column("classes").to_pylist()), dtype="<i8")
        order = np.lexsort((cls, keys))
        keys, cls = keys[order], cls[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
        keys, cls = keys[new], cls[new]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        lists = {cls[a : a + n].tobytes() for a, n in zip(starts[sizes > 1], sizes[sizes > 1])}
        names = [int.from_bytes(hashlib.blake2b(m, digest_size=8).digest(), "little", signed=True) for m in lists]
        return pa.table({"list": pa.array(names, pa.int64()), "members": pa.array(list(lists), pa.binary())})

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, packed_members in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                cls = np.frombuffer(packed_members, dtype="<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cls), name)), pa.array(cls), pa.array(np.full(len(cls), len(cls)))], ["list", "cls", "size"]
                )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for keys, classes in zip(rows.column("keys").to_pylist(), rows.column("classes").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(keys, dtype="<u8").view("<i8")), pa.array(np.frombuffer(classes, dtype="<i8"))], ["list", "cls"]
                )

    with tables_of() as paths:
        emitted = cut(docs.select(key, text).mapInArrow(prefixes, "slot bigint, keys binary, classes binary"))
    met = emitted.where(F.col("slot") >= 0).groupBy("slot").applyInArrow(meet, "list bigint, members binary")
    light = met.dropDuplicates(["list"]).mapInArrow(members, "list bigint, cls bigint, size bigint")
    heavy = emitted.where(F.col("slot") < 0).mapInArrow(entries, "list bigint, cls bigint").distinct()
    sized = heavy.join(heavy.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > 1), "list")
    found = cut(light.unionByName(sized))
    remove_tables(docs.sparkSession, paths)  # nothing reads it again, and it holds every prefix element
    return found


def largest_lists(lists: DataFrame) -> DataFrame:
    """(cls, list, size): every class with its largest list, and how many classes that is the largest list of."""
    largest = lists.groupBy("cls").agg(F.max(F.struct("size", "list")).alias("x")).select("cls", "x.list")
    return cut(largest.join(largest.groupBy("list").agg(F.count("*").alias("size")), "list").select("cls", "list", "size"))


def class_texts(docs: DataFrame, key: str, text: str, width: int, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, signature, z, list, size) of the wanted classes: the text of one document of each, compressed. `wanted` has
    the list where the class's text is needed first, and its size.

    Texts are moved once: the document of a class is found by class and id, so copies of one text are dealt out too.
    """
    import zstandard

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            for part in chunks(rows, rows.schema.names[1]):
                sets = shingle_sets(part.column(1), width)
                own = pa.array([k for k, s in enumerate(sets) if len(s)], pa.int64())
                sets = [s for s in sets if len(s)]
                z = [squeeze.compress(t.encode()) for t in part.column(1).take(own).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), pa.array([class_number(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array(z, pa.binary())],
                    ["id_number", "cls", "n", "signature", "z"],
                )

    # The number of a null id is that of classes whose rows all lack one.
    first = classes.groupBy("cls").agg(F.xxhash64(F.min(key)).alias("id_number")).join(wanted, "cls")
    texts = docs.select(F.xxhash64(key).alias("id_number"), text)
    found = texts.mapInArrow(work, "id_number bigint, cls bigint, n bigint, signature binary, z binary")
    one = found.join(first, ["cls", "id_number"]).dropDuplicates(["cls", "id_number"])
    return cut(one.select("cls", "n", "signature", "z", "list", "size"))


def _chunk(size: Column, by: Column, block: int) -> Column:
    return F.pmod(F.xxhash64(by), F.ceil(size / block)).cast("bigint")


def connect_in_lists(texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(cls, root): members connected by links inside the blocks of their largest list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            if table.num_rows < 2 and table.column("size")[0].as_py() <= block:
                continue
            sets = shingle_sets(unpack_texts(table.column("z").combine_chunks()), width)
            cls, roots = table.column("cls").to_pylist(), link_block(sets, percent)
            times: dict[int, int] = {}
            rank = [times.__setitem__(r, times.get(r, 0) + 1) or times[r] for r in roots]
            yield pa.RecordBatch.from_arrays(
                [table.column("list").combine_chunks(), table.column("size").combine_chunks(), pa.array(cls, pa.int64()),
                 pa.array([cls[r] for r in roots], pa.int64()), pa.array(rank, pa.int64())],
                ["list", "size", "cls", "root", "rank"],
            )

    schema = "list bigint, size bigint, cls bigint, root bigint, rank bigint"
    at, edges = texts.where(F.col("size") > 1).select("list", "size", "cls", "z"), None
    while True:
        rows = at.withColumn("chunk", _chunk(F.col("size"), F.col("cls"), block))
        done = cut(side_by_side(rows.select("list", "chunk", "size", "cls", "z"), "list", "chunk").mapInArrow(work, schema))
        found = done.where(F.col("cls") != F.col("root")).select("cls", "root")
        edges = found if edges is None else edges.unionByName(found)
        left = done.where((F.col("size") > block) & (F.col("rank") <= REPRESENTATIVES)).select("list", "cls", F.col("size").alias("before"))
        counted = left.groupBy("list").agg(F.count("*").alias("size"), F.max("before").alias("before"))
        again = cut(left.select("list", "cls").join(counted.where(F.col("size") * 2 <= F.col("before")), "list").select("list", "cls", "size"))
        if again.isEmpty():
            return edges
        at = again.join(texts.select("cls", "z"), "cls")


def pairs_of_few(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of (list, cls, comp) that are not in one component and can be alike, each once.

    The pairs go through two joins by class, so a signature is sent once for a class and once for a pair that its size
    admits, and not once for every list.
    """
    sized = members.join(texts.select("cls", "n"), "cls")
    one, two = (sized.select("list", F.col("cls").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    met = one.join(two, "list").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & near)
    pairs = cut(met.select("a", "b", "n_a", "n_b").distinct())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bits = (rows.column(f"signature_{x}").to_pylist() for x in ("a", "b"))
            sizes = (rows.column(f"n_{x}").to_numpy() for x in ("a", "b"))
            yield rows.select(["a", "b"]).filter(pa.array(possible_pairs(*bits, *sizes, percent)))

    bits = texts.select("cls", "signature")
    for x in ("b", "a"):
        pairs = pairs.join(bits.withColumnsRenamed({"cls": x, "signature": f"signature_{x}"}), x)
    return pairs.select("a", "b", "n_a", "n_b", "signature_a", "signature_b").mapInArrow(work, "a bigint, b bigint")


def pairs_across(lists: DataFrame, comps: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b), a < b: pairs of a list that are not in one component and can be alike.

    A pair that shares several long lists is judged in the first of them only, and in the one meeting of its two chunks.
    """
    placed = lists.join(comps.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls")
    )
    split = placed.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
    open_ = cut(placed.join(split.select("list"), "list"))
    zero = F.lit(0).cast("bigint")
    few = min(FEW, block)
    small = open_.where((F.col("size") > few) & (F.col("size") <= block)).select(
        "list", zero.alias("one"), zero.alias("two"), zero.alias("chunk"), "cls", "comp"
    )
    big = open_.where(F.col("size") > block)
    own = big.groupBy("list", "comp").agg(F.count("*").alias("m"))
    # A component larger than a block has chunks of its own; smaller ones share chunks.
    alone = F.col("m") > block
    chunk = F.when(alone, F.xxhash64("comp", _chunk(F.col("m"), F.col("cls"), block))).otherwise(_chunk(F.col("size"), F.col("comp"), block))
    chunked = cut(big.join(own, ["list", "comp"]).select("list", "cls", "comp", chunk.alias("chunk"), alone.alias("alone")))
    nodes = chunked.groupBy("list", "chunk").agg(F.max(F.when(F.col("alone"), F.col("comp"))).alias("only"))
    one, two = (nodes.select("list", F.col("chunk").alias(c), F.col("only").alias(f"only_{c}")) for c in ("one", "two"))
    meet = one.join(two, "list").where(
        (F.col("one") <= F.col("two")) & ~F.coalesce(F.col("only_one") == F.col("only_two"), F.lit(False))
    ).select("list", "one", "two")
    sides = meet.withColumn("chunk", F.explode(F.array_distinct(F.array("one", "two"))))
    large = sides.join(chunked, ["list", "chunk"]).select("list", "one", "two", "chunk", "cls", "comp")
    shared = open_.where(F.col("size") > few).groupBy("cls").agg(F.sort_array(F.collect_list("list")).alias("lists"))  # no longer than a prefix
    rows = small.unionByName(large).join(texts.select("cls", "n", "signature").join(shared, "cls"), "cls")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            cls, comp = (table.column(c).to_numpy() for c in ("cls", "comp"))
            sizes = table.column("n").to_numpy()
            bits = [np.frombuffer(x, dtype=np.uint64) for x in table.column("signature").to_pylist()]
            i, j = candidates(bits, sizes, comp, np.lexsort((sizes, comp)).argsort(), percent)
            chunk, name = table.column("chunk").to_numpy(), table.column("list")[0].as_py()
            same_chunk = table.column("one")[0].as_py() == table.column("two")[0].as_py()
            apart = (comp[i] != comp[j]) & ((chunk[i] == chunk[j]) == same_chunk)
            i, j = i[apart], j[apart]
            lists = table.column("lists").combine_chunks()
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            first = np.array([
                np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True)[0] == name
                for x, y in zip(i.tolist(), j.tolist())
            ], dtype=bool)
            a, b = cls[i[first]], cls[j[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    by = ["list", "one", "two"]
    dealt = side_by_side(rows.select(*by, "chunk", "cls", "comp", "n", "signature", "lists"), *by)
    found = pairs_of_few(open_.where(F.col("size") <= few).select("list", "cls", "comp"), texts, percent)
    return found.unionByName(dealt.mapInArrow(work, "a bigint, b bigint")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are alike. Pairs stay where the second join has dealt them; a class with many pairs is split
    there as other skewed keys are, and a text is taken apart once for a slice of pairs. Only texts of classes that are in
    a pair are joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                sets = []
                for name in ("a", "b"):
                    _, first, place = np.unique(part.column(name).to_numpy(), return_index=True, return_inverse=True)
                    distinct = shingle_sets(unpack_texts(part.column(f"z_{name}").take(pa.array(first))), width)
                    sets.append([distinct[k] for k in place])
                alike = pa.array([linked(one, other, percent) for one, other in zip(*sets)], pa.bool_())
                yield part.select(["a", "b"]).filter(alike)

    pairs = cut(pairs)
    named = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    z = texts.select("cls", "z").join(named, "cls", "left_semi")
    joined = pairs.join(z.withColumnsRenamed({"cls": "b", "z": "z_b"}), "b").join(z.withColumnsRenamed({"cls": "a", "z": "z_a"}), "a")
    return joined.select("a", "b", "z_a", "z_b").mapInArrow(work, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """(key, n_shingles, cls, component_id) of every row: the smallest id that links reach, the row's own included.

    Two rows are linked if 100 * intersection >= percent * union of their sets of `width`-word shingles.
    """
    classes, counted = classify(docs, key, text, width)
    filled = classes.where(F.col("n") > 0)
    total = filled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (100 - percent) // 100
    slots = max(1, int(total // SLOT_ELEMENTS))
    lists = prefix_lists(docs, key, text, width, percent, common_elements(counted), slots)
    texts = class_texts(docs, key, text, width, filled, largest_lists(lists))
    edges = connect_in_lists(texts, width, percent, block)
    comps = components(edges, "cls", "root")
    more = cut(verified(pairs_across(lists, comps, texts, percent, block), texts, width, percent))
    if not more.isEmpty():
        comps = components(edges.unionByName(more.select(F.col("a").alias("cls"), F.col("b").alias("root"))), "cls", "root")
    rooted = filled.join(comps.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min(key).alias("component_id"))
    joined = rooted.join(least, "root").select(key, F.col("n").alias("n_shingles"), "cls", "component_id")
    alone = classes.where(F.col("n") == 0).select(key, F.col("n").alias("n_shingles"), "cls", F.col(key).alias("component_id"))
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose id is the least of its component. Rows with one id, null included, stay or go together."""
    kept = cut(jaccard_components(docs, key, **options).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct())
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi")


#: The components for four-word shingles and 85 percent in SQL, by all pairs that share a shingle.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) as g
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
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other)::bigint as component_id
from reach left join n using (doc_id) group by doc_id
"""
