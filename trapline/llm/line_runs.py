"""Line dedup: a suffix array over sequences of line numbers, built by prefix doubling in Spark.

A document is the sequence of its lines with words; equal lines have equal numbers. Suffixes whose first line occurs
nowhere else share no run with any other and take no part. The rest get ranks by prefix doubling: round h orders
suffixes by their first 2**h lines, from the ranks of the round before at this place and 2**h lines further on. Ranks
come from range partitions and their sizes, so no task holds a group. The rounds end when no two suffixes have equal
ranks; every suffix keeps the ranks it had in the rounds where it was equal to others.

These ranks are the intervals of common prefixes: suffixes that had the same rank in round h stand next to each other
in the array and have 2**h lines or more in common, and only they. So intervals of any length follow from one or two
of them, and the common prefix of neighbours from a walk down the rounds. All places of one interval of MIN_LINES
lines hold a repeated run, which goes on as long as such places follow each other. The first place of an interval in
corpus order (id, then line) stays, and the lines of all others are deleted if they have MIN_WORDS words or more.

A null text is empty, has no lines and stays null. Blank lines are never compared nor deleted. Rows that are equal in
id and text are one document, reported as often as they are there; rows with equal ids and different texts are
different documents. An empty table gives no rows; other columns are kept, whatever their names, but one that has the name
of the number of deleted lines is replaced.

`drop_later_runs` deletes the later copies of whole maximal runs, of one line or of many, whose words reach MIN_WORDS
in total. A maximal run at a place is the longest that also stands at an earlier place, which may overlap it. Its lines
are the union of its least windows, those that reach MIN_WORDS and would not without their last or their first line:
every line of the run is in one of them, none leaves it, and none has more than MIN_WORDS lines, as a line here has a
word. Equal windows are least in the same way, so each is looked up once, in the intervals of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StructField, StructType

from trapline.operators.ordinals import with_running_sum
from trapline.session import cut

MIN_LINES = 2
MIN_WORDS = 10
WORD = "[^\\x20\\x09-\\x0D]+"


def document_number(key: str, text: str) -> Column:
    """Tells documents with equal ids apart."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def line_sequences(docs: DataFrame, key: str, text: str, min_lines: int) -> DataFrame:
    """(doc, id, idx, line, ahead, words): every line with words. `ahead` has the places, among all lines of the
    text, of the `min_lines` lines from here on, and `words` their number of words (null if there are fewer lines)."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(F.xxhash64(x).alias("line"), i.alias("at"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("n")),
    )
    worded = docs.select(
        document_number(key, text).alias("doc"), F.col(key).alias("id"), F.filter(lines, lambda x: x["n"] > 0).alias("lines")
    )
    spread = worded.select("doc", "id", "lines", F.posexplode("lines").alias("idx", "x"))
    some = [F.get("lines", F.col("idx") + k) for k in range(min_lines)]
    return spread.select(
        "doc", "id", "idx", F.col("x.line").alias("line"), F.array(*[x["at"] for x in some]).alias("ahead"),
        sum((x["n"] for x in some), F.lit(0)).alias("words"),
    )


def repeated_lines(sequences: DataFrame) -> DataFrame:
    """The suffixes whose first line occurs more than once, each once."""
    often = sequences.groupBy("line").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("line")
    return sequences.join(often, "line").dropDuplicates(["doc", "idx"])


def _places(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Per distinct (group, order): `alike`, its number of rows, and `before`, the rows of the group in front of it."""
    by = [*group, *order]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("alike")).repartitionByRange(*by)
    kept = cut(sizes.withColumn("_range", F.spark_partition_id()))
    return with_running_sum(kept, group, F.col("_range"), order, {"before": F.col("alike")}, inclusive=False).drop("_range")


def suffix_array(suffixes: DataFrame, lines: int | None = None) -> DataFrame:
    """(doc, idx, rank, firsts): ranks from 0, and for every round h in which the suffix was equal to others in its
    first 2**h lines, the first rank of these suffixes.

    `suffixes` has (doc, idx, line). A rank is the number of suffixes before; as long as suffixes are `alike`, they
    share it, and one whose rank is its own keeps it. Where the compared lines end (with the document, or before a
    line that occurs once) a suffix goes first in its group and is like no other. With `lines` the rounds end with the
    last one that intervals of that many lines need: suffixes that are still alike share a rank.
    """
    first = suffixes.select("doc", "idx", "line")
    none = F.array().cast("array<bigint>")
    placed = first.join(_places(first, [], ["line"]), "line")
    ranks, width = cut(placed.select("doc", "idx", F.col("before").alias("rank"), "alike", none.alias("firsts"))), 1
    while True:
        equal = ranks.where(F.col("alike") > 1)
        if equal.isEmpty():
            return ranks.select("doc", "idx", "rank", "firsts")
        if lines is not None and 2 * width > lines:
            last = F.when(F.col("alike") > 1, F.array_append("firsts", F.col("rank"))).otherwise(F.col("firsts"))
            return ranks.select("doc", "idx", "rank", last.alias("firsts"))
        ahead = ranks.select("doc", (F.col("idx") - width).alias("idx"), F.col("rank").alias("next"))
        pairs = equal.select("doc", "idx", "rank", F.array_append("firsts", F.col("rank")).alias("firsts")).join(
            ahead.where(F.col("idx") >= 0), ["doc", "idx"], "left"
        )
        ends = F.col("next").isNull()
        keyed = pairs.withColumns(
            {"next": F.coalesce("next", F.lit(-1)), "end_doc": F.when(ends, F.col("doc")).otherwise(0),
             "end_idx": F.when(ends, F.col("idx")).otherwise(-1)}
        )
        by = ["next", "end_doc", "end_idx"]
        again = keyed.join(_places(keyed, ["rank"], by), ["rank", *by]).select(
            "doc", "idx", (F.col("rank") + F.col("before")).alias("rank"), "alike", "firsts"
        )
        ranks = cut(again.unionByName(ranks.where(F.col("alike") == 1)))
        width *= 2


def common_prefixes(array: DataFrame) -> DataFrame:
    """(doc, idx, rank, lcp): how many lines each suffix has in common with the one before it in the array.

    Both were equal in round h if the suffix is not the first of its interval there. The longest such round gives the
    bulk, and a walk down the rounds, at the places behind, the rest.
    """
    rounds = array.agg(F.max(F.size("firsts"))).first()[0] or 0
    top = F.size(F.filter("firsts", lambda f: f < F.col("rank")))
    near = array.where(top > 0).select("doc", "idx", "rank", top.alias("top"))
    before = array.select((F.col("rank") + 1).alias("rank"), F.col("doc").alias("b_doc"), F.col("idx").alias("b_idx"))
    near = near.join(before, "rank").withColumn("lcp", F.pow(2, F.col("top") - 1).cast("int"))
    for h in reversed(range(rounds - 1)):
        there = array.where(F.size("firsts") > h)
        one = there.select("doc", F.col("idx").alias("_i"), F.col("firsts")[h].alias("_r"))
        two = there.select(F.col("doc").alias("b_doc"), F.col("idx").alias("_j"), F.col("firsts")[h].alias("_s"))
        further = F.col("top") - 1 > h
        moved = (
            near.where(further).withColumns({"_i": F.col("idx") + F.col("lcp"), "_j": F.col("b_idx") + F.col("lcp")})
            .join(one, ["doc", "_i"], "left").join(two, ["b_doc", "_j"], "left")
            .withColumn("lcp", F.col("lcp") + F.when(F.col("_r") == F.col("_s"), 1 << h).otherwise(0))
            .select(*near.columns)
        )
        near = cut(moved.unionByName(near.where(~further)))
    found = near.select("doc", "idx", "lcp")
    return array.select("doc", "idx", "rank").join(found, ["doc", "idx"], "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def intervals(array: DataFrame, lines: int) -> DataFrame:
    """(doc, idx, one, two): suffixes with the same `one` and `two` have their first `lines` lines in common.

    A length that is no power of two is covered by two that are, one at its beginning and one at its end.
    """
    h = lines.bit_length() - 1
    there = array.where(F.size("firsts") > h).select("doc", "idx", F.col("firsts")[h].alias("one"))
    rest = lines - (1 << h)
    if not rest:
        return there.withColumn("two", F.lit(0).cast("bigint"))
    ends = there.select("doc", (F.col("idx") - rest).alias("idx"), F.col("one").alias("two"))
    return there.join(ends, ["doc", "idx"])


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(doc, id, idx, ahead, words, one, two, n_places, first): every place where a run of `min_lines` lines stands
    that occurs again, with its interval (one, two); `first` marks the interval's first place in corpus order."""
    lines = cut(repeated_lines(line_sequences(docs, key, text, min_lines)))
    found = intervals(suffix_array(lines), min_lines)
    places = cut(found.join(lines.drop("line"), ["doc", "idx"]))
    order = F.struct("id", "doc", "idx")
    firsts = places.groupBy("one", "two").agg(F.min(order).alias("_least"), F.count("*").alias("n_places"))
    again = places.join(firsts.where(F.col("n_places") > 1), ["one", "two"])
    return again.withColumn("first", order.eqNullSafe(F.col("_least"))).drop("_least")


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
    removed: str = "n_removed",
) -> DataFrame:
    """All rows and columns of `docs`, with later copies of repeated runs deleted from the text, and `n_removed`, the
    number of deleted lines. A place counts if its first `min_lines` lines have `min_words` words or more."""
    runs = repeated_runs(docs, key, text, min_lines)
    later = runs.where(~F.col("first") & (F.col("words") >= min_words)).select(F.col("doc").alias("_doc"), "ahead")
    gone = later.groupBy("_doc").agg(F.array_distinct(F.flatten(F.collect_list("ahead"))).alias("_gone"))
    return _delete(docs, key, text, gone, lambda lines, places: set(places), removed)


def least_windows(lines: DataFrame, array: DataFrame, min_words: int) -> DataFrame:
    """(doc, id, idx, start, stop, size, one, two): windows of `size` repeated lines that reach `min_words` words, and
    would not without their last line or without their first; equal (size, one, two) are equal windows. `start` and
    `stop` are the places of the first and the last line among all lines of the text. Windows that do not occur again
    can be left out."""
    key = lines.schema["id"].dataType
    own = lines.select("doc", "id", F.struct("idx", F.col("ahead")[0].alias("at"), F.col("words").alias("n")).alias("x"))
    rounds = array.select("doc", F.struct("idx", "firsts").alias("f"))
    both = own.withColumn("f", F.lit(None).cast(rounds.schema["f"].dataType)).unionByName(
        rounds.select("doc", F.lit(None).cast(key).alias("id"), F.lit(None).cast(own.schema["x"].dataType).alias("x"), "f")
    )
    whole = both.groupBy("doc").agg(
        F.max("id").alias("id"), F.array_sort(F.collect_list("x")).alias("x"), F.array_sort(F.collect_list("f")).alias("f")
    )
    number = [StructField(name, LongType()) for name in ("idx", "start", "stop", "size", "one", "two")]
    return whole.mapInArrow(
        _windows(min_words), StructType([StructField("doc", LongType()), StructField("id", key), *number])
    )


def _windows(min_words: int):
    rounds = min_words.bit_length()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, f = batch.column(batch.schema.get_field_index("x")), batch.column(batch.schema.get_field_index("f"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(x.offsets.to_numpy()))
            idx, at, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in x.flatten().flatten())
            firsts = f.flatten().field("firsts")
            many, values = np.diff(firsts.offsets.to_numpy()), firsts.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(many) - many
            rank = np.full((rounds, len(idx)), -1, dtype=np.int64)
            for h in range(rounds):
                there = np.flatnonzero(many > h)
                rank[h, there] = values[begin[there] + h]
            chain = np.cumsum(np.r_[True, (np.diff(row) != 0) | (np.diff(idx) != 1)][: len(idx)])
            total = np.r_[0, np.cumsum(n)]
            here = np.arange(len(idx))
            # From each line as far as needed, and back from each line as far as needed.
            stop = np.searchsorted(total, total[:-1] + min_words) - 1
            start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            a, b = np.r_[here, start], np.r_[stop, here]
            fits = (a >= 0) & (b < len(idx))
            a, b = a[fits], b[fits]
            fits = chain[a] == chain[b]
            pairs = np.unique(np.stack([a[fits], b[fits]], axis=1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
            size = b - a + 1
            h = np.frexp(size)[1] - 1
            one, two = rank[h, a], rank[h, b + 1 - (1 << h)]
            again = (one >= 0) & (two >= 0)
            a, b, size, one, two = a[again], b[again], size[again], one[again], two[again]
            doc = batch.column(batch.schema.get_field_index("doc")).take(pa.array(row[a]))
            key = batch.column(batch.schema.get_field_index("id")).take(pa.array(row[a]))
            numbers = [pa.array(c, pa.int64()) for c in (idx[a], at[a], at[b], size, one, two)]
            yield pa.RecordBatch.from_arrays([doc, key, *numbers], ["doc", "id", "idx", "start", "stop", "size", "one", "two"])

    return work


def drop_later_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "n_removed"
) -> DataFrame:
    """All rows and columns of `docs`, with the later copies of maximal repeated runs of lines with `min_words` words or
    more (at least one) in total deleted from the text, and the number of deleted lines in `removed`."""
    lines = cut(repeated_lines(line_sequences(docs, key, text, 1)))
    places = cut(least_windows(lines, suffix_array(lines, min_words), min_words))
    group, order = ["size", "one", "two"], F.struct("id", "doc", "idx")
    firsts = places.groupBy(*group).agg(F.min(order).alias("_least"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    later = places.join(firsts, group).where(~order.eqNullSafe(F.col("_least")))
    spans = later.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("start", "stop")).alias("_gone"))
    return _delete(docs, key, text, spans, _in_spans, removed)


def _in_spans(lines: list[str], gone: list[dict]) -> set[int]:
    """The places of lines with words from start to stop."""
    inside = {k for span in gone for k in range(span["start"], span["stop"] + 1)}
    return {k for k in inside if lines[k].strip(" \t\n\v\f\r")}


def _delete(docs: DataFrame, key: str, text: str, gone: DataFrame, places, removed: str) -> DataFrame:
    """`docs` without the lines that `places` makes of a text's lines and the document's `_gone`; their number in
    `removed`, in place of a column of that name. Helper columns have names that no column of `docs` has."""
    docs = docs.drop(removed)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    at, kind = docs.columns.index(text), docs.schema[text].dataType
    number = document_number(columns[docs.columns.index(key)], columns[at])
    sent = plain.withColumn("_doc", number).mapInArrow(
        _compress(at), StructType([*_with_type(plain, columns[at], BinaryType()), StructField("_doc", LongType())])
    )
    # What is deleted grows with the corpus, so this join is by a shuffle at every size, never by a broadcast.
    joined = sent.join(cut(gone).hint("merge"), "_doc", "left").select(*columns, "_gone")
    result = StructType([*_with_type(plain, columns[at], kind), StructField("_removed", IntegerType())])
    return joined.mapInArrow(_without_lines(at, places), result).toDF(*docs.columns, removed)


def _with_type(docs: DataFrame, column: str, kind: DataType) -> list[StructField]:
    return [StructField(f.name, kind if f.name == column else f.dataType, True) for f in docs.schema.fields]


def _compress(at: int):
    """Texts travel compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [None if t is None else pack.compress(t.encode()) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(z, pa.binary()))

    return work


def _without_lines(at: int, places):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, removed = [], []
            for z, gone in zip(batch.column(at).to_pylist(), batch.column("_gone").to_pylist()):
                text = None if z is None else unpack.decompress(z).decode()
                left_out = set()
                if gone:
                    lines = text.split("\n")
                    left_out = places(lines, gone)
                    text = "\n".join(x for k, x in enumerate(lines) if k not in left_out)
                texts.append(text)
                removed.append(len(left_out))
            kept = batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))
            last = kept.schema.get_field_index("_gone")
            yield kept.set_column(last, "_removed", pa.array(removed, pa.int32()))

    return work


def line_report(deduplicated: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of deleted lines, and length and digest of the text that stays."""
    kept = F.coalesce(F.col(text), F.lit(""))
    return deduplicated.select(
        key, F.col("n_removed").cast("bigint").alias("n_removed"), F.length(kept).cast("bigint").alias("n_chars_kept"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


#: The same rows in SQL, for runs of two lines: places are grouped by the text of their two lines.
ORACLE_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as nr
  from documents),
w as (
  select doc_id, line, nr, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
p as (
  select doc_id, nr, line, n, lead(line) over d as line2, lead(nr) over d as nr2, lead(n) over d as n2
  from w window d as (partition by doc_id order by nr)),
r as (
  select *, row_number() over (partition by line, line2 order by doc_id, nr) as place from p where line2 is not null),
gone as (
  select doc_id, nr from r where place > 1 and n + n2 >= 10
  union select doc_id, nr2 from r where place > 1 and n + n2 >= 10),
kept as (
  select l.doc_id, string_agg(line, chr(10) order by l.nr) as t
  from l where not exists (select 1 from gone g where g.doc_id = l.doc_id and g.nr = l.nr) group by l.doc_id),
c as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, coalesce(c.n, 0)::bigint as n_removed, length(coalesce(t, ''))::bigint as n_chars_kept, sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept using (doc_id) left join c using (doc_id)
"""


#: The rows of `drop_later_runs` in SQL: every window of up to ten lines that reaches ten words, by the text of its lines.
RUNS_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as nr
  from documents),
w as (
  select doc_id, line, nr, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
d as (
  select doc_id, list(line order by nr) as ls, list(nr order by nr) as nrs, list(n order by nr) as ns from w group by doc_id),
s as (select *, unnest(range(1, len(ls) + 1)) as a from d),
p as (
  select doc_id, a, k, ls[a:a + k - 1] as run, nrs[a:a + k - 1] as at_nr from s, range(1, 11) as t(k)
  where a + k - 1 <= len(ls) and list_sum(ns[a:a + k - 1]) >= 10),
r as (select doc_id, at_nr, row_number() over (partition by run order by doc_id, a) as place from p),
gone as (select distinct doc_id, unnest(at_nr) as nr from r where place > 1),
kept as (
  select l.doc_id, string_agg(line, chr(10) order by l.nr) as t
  from l where not exists (select 1 from gone g where g.doc_id = l.doc_id and g.nr = l.nr) group by l.doc_id),
c as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, coalesce(c.n, 0)::bigint as n_removed, length(coalesce(t, ''))::bigint as n_chars_kept, sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept using (doc_id) left join c using (doc_id)
"""
