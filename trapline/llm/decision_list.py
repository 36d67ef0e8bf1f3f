"""Quality rules: text statistics and a learned decision list, all in built-in functions.

Statistics are columns of the text. Learning is sequential covering over labelled statistics: a rule starts empty and
grows by the threshold condition that raises its precision most (by FOIL gain), on two thirds of the labelled rows;
it is pruned on the last third, from its last condition backwards, while that raises (p - n) / (p + n) there. Rows it
covers leave, and the next rule is learned, until a rule is not precise enough on either part. Every step is one
grouped count over (feature, bin), where the bins are quantiles of the labelled rows. The list is emitted as an
ordered conditional expression.

A null text has no words: all counts are zero and it fails the base rules. Rows with a null label teach nothing.
Repeated rows are each judged. Empty tables give no rows, and without labels of both kinds the list is empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.session import cut

WINDOW = 5
BINS = 32
LEARN_ROWS = 50_000
MAX_RULES = 16
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 10
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: F.length(w) > 0)


def repeated_words(numbers: Column, width: int = WINDOW) -> Column:
    """How many places lie in a window of `width` numbers that occurs twice or more in the array.

    Windows are compared by a 64-bit number. Only an array with equal windows is sorted.
    """
    last = F.size(numbers) - width
    windows = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[numbers[i + k] for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further counts for learning)."""
    body = docs.select(F.col(key), *carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = body.withColumns({"_words": word_list(F.col("_text")), "_lines": lines})
    numbers = F.transform("_words", lambda w: F.xxhash64(w))
    second = first.select(
        key, *carry, "_text", "_lines", F.size("_words").cast("bigint").alias("n_words"), numbers.alias("_numbers"),
    )
    third = second.withColumn("_windows", repeated_words(F.col("_numbers")))
    without = lambda letters: F.length(F.translate("_text", letters, ""))
    length = F.length("_text")
    fourth = third.select(
        key, *carry, "n_words",
        without(BLANKS).cast("bigint").alias("word_chars"),
        (length - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("_numbers")).cast("bigint").alias("n_distinct_words"),
        (length - without("!?")).cast("bigint").alias("n_marks"),
        (length - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("bigint").alias("n_capitals"),
        (length - without("0123456789")).cast("bigint").alias("n_digits"),
        (F.size(F.array_distinct("_windows")) < F.size("_windows")).alias("_again"), "_windows",
    )
    return fourth.withColumn("n_repeat_words", _covered(F.col("_windows"), F.col("_again"))).drop("_again", "_windows")


def _covered(windows: Column, again: Column, width: int = WINDOW) -> Column:
    """Places covered by the windows whose number occurs twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # equal numbers are neighbours once sorted: a pair of neighbours marks both places
    marked = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.zip_with(
                    F.slice(placed, 1, F.size(placed) - 1), F.slice(placed, 2, F.size(placed) - 1),
                    lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
                )
            )
        )
    )
    steps = F.aggregate(
        marked, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("at")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["at"])).alias("n"), i.alias("at")),
        lambda s: s["n"],
    )
    return F.when(again, steps).otherwise(F.lit(0).cast("bigint"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Shares that the rules may ask about; each is a ratio of counts of one text.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "mark_share": ("n_marks", "word_chars"),
    "capital_share": ("n_capitals", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "words": ("n_words", None),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


def covers(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(covers(rule), number).otherwise(out)
    return out


def _bin_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per feature and bin (bad, good); the counts are as many as bins, whatever the number of rows."""
    def bin_of(name: str, points: list[float]) -> Column:
        value = feature(name)
        return F.size(F.filter(F.array(*[F.lit(c) for c in points]), lambda c: c < value))

    entries = [F.struct(F.lit(name).alias("name"), bin_of(name, points).alias("bin")) for name, points in cuts.items()]
    counted = rows.select("bad", F.inline(F.array(*entries))).groupBy("name", "bin").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")
    )
    out = {name: [(0, 0)] * (len(points) + 1) for name, points in cuts.items()}
    for name, at, p, n in counted.collect():
        out[name][at] = (p, n)
    return out


def _candidates(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]):
    """Every condition with the (bad, good) rows it keeps."""
    for name, bins in counts.items():
        total_p, total_n = sum(p for p, _ in bins), sum(n for _, n in bins)
        p = n = 0
        for threshold, (bin_p, bin_n) in zip(cuts[name], bins):
            p, n = p + bin_p, n + bin_n
            yield Condition(name, False, threshold), p, n
            yield Condition(name, True, threshold), total_p - p, total_n - n


def grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int, min_covered: int) -> Rule:
    """Adds the condition of the greatest FOIL gain until no good row is covered or none helps."""
    rule: Rule = ()
    while len(rule) < max_conditions:
        counts = _bin_counts(rows.where(covers(rule)), cuts)
        some = next(iter(counts.values()))
        p0, n0 = sum(p for p, _ in some), sum(n for _, n in some)
        if p0 == 0 or n0 == 0:
            break
        before = math.log2(p0 / (p0 + n0))
        gains = [
            (p * (math.log2(p / (p + n)) - before), str(c), c)
            for c, p, n in _candidates(counts, cuts) if p >= min_covered and (p, n) != (p0, n0)
        ]
        best = max(gains, default=(0.0, "", None))
        if best[0] <= 1e-9:
            break
        rule += (best[2],)
    return rule


def prune(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on the pruning rows, the shortest on ties; its p, n."""
    heads = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = rows.agg(*[F.count_if(covers(h) & (F.col("bad") == b)) for h in heads for b in (True, False)]).first()
    scored = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k, (p, n) in enumerate(zip(sums[::2], sums[1::2]))]
    _, k, p, n = max(scored)
    return heads[-k], p, n


def learn(
    labelled: DataFrame, bins: int = BINS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
    min_precision: float = MIN_PRECISION, min_covered: int = MIN_COVERED,
) -> list[Rule]:
    """Rules for bad rows, from statistics with a boolean `bad` and a `part` of 0 to 2 (2: pruning)."""
    rows = cut(labelled.where(F.col("bad").isNotNull()))
    quantiles = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(feature(name), quantiles, 10_000) for name in FEATURES]).first()
    cuts = {name: sorted(set(points)) for name, points in zip(FEATURES, found) if points}
    rules: list[Rule] = []
    left = rows
    while cuts and len(rules) < max_rules:
        rule = grow(left.where(F.col("part") < 2), cuts, max_conditions, min_covered)
        if not rule:
            break
        rule, p, n = prune(rule, left.where(F.col("part") == 2))
        if p + n == 0 or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left = left.where(~covers(rule))
    return rules


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality"
) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every row with `base_failed`, `rule` (first learned rule that covers it, or null) and `kept`.

    The statistics are written out once; learning and judging read them.
    """
    statistics = cut(with_statistics(docs, key, text))
    rules = learn(with_labels(statistics, labels, key, quality))
    return judged(statistics, rules), rules


def with_labels(statistics: DataFrame, labels: DataFrame, key: str, quality: str) -> DataFrame:
    """Labelled statistics: `bad`, and `part` of 0 to 2 by a hash of the id."""
    marks = labels.select(F.col(key), (F.col(quality) == 0).alias("bad")).where(F.col("bad").isNotNull())
    return statistics.join(marks, key).withColumn("part", F.pmod(F.xxhash64(key), F.lit(3)))


def judged(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    found = statistics.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", learn_rows: int = LEARN_ROWS
) -> DataFrame:
    """The rows of `docs` that are kept, with all columns. Rules are learned from about `learn_rows` labelled rows at most,
    by a hash of the id; so many ids are sent to all tasks.

    Of all rows only the statistics that the rules ask about are computed, in the pass that filters them: nothing but the
    labelled statistics is written.
    """
    marked = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).select(key).distinct()
    share = F.lit(learn_rows) / F.greatest(F.lit(marked.count()), F.lit(1))
    some = marked.where(F.pmod(F.xxhash64(F.lit("learn"), key), F.lit(1 << 30)) < share * (1 << 30))
    labelled = with_statistics(docs.join(F.broadcast(some), key, "left_semi"), key, text)
    rules = learn(with_labels(labelled, labels, key, quality))
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)]
    carried = docs.select(F.struct(*columns).alias("_doc"), F.col(key), F.col(text))
    asked = sorted({"n_words", "n_repeat_words", *[c for rule in rules for x in rule for c in FEATURES[x.feature] if c]})
    # A filter would be pushed below the statistics, and compute them again for each of its conditions; not past a generator.
    statistics = with_statistics(carried, key, text, carry=["_doc"]).select("_doc", F.explode(F.array(F.struct(*asked))).alias("_s"))
    rows = judged(statistics.select("_doc", "_s.*"), rules).where("kept")
    return rows.select(*[F.col(f"_doc._{i}").alias(c) for i, c in enumerate(docs.columns)])
