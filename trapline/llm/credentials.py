"""Secret scans: strong patterns on their own, weak candidates only beside a complementary part.

Strong kinds are always reported: `assign` (a named value), `access` (an access identifier), `hex` (a long hex run).
Weak kinds are `user` (a named account), `key` (a long run of mixed characters) and `endpoint` (a service address). A
weak candidate is reported only if a part of another role lies in its scope: identifiers (access, user), secrets
(assign, hex, key) and endpoints complement each other.

Places come from the text itself: splitting at a pattern gives the gaps between its matches, and running sums of
lengths give all starts. The scope is an interval join without pairs: starts at most REACH code points apart. Parts
are counted into cells of REACH code points; a cell keeps the least and the greatest start of each role, and a part
looks at its own cell and the two beside it. A document full of parts costs no more per part than any other.

A null text is empty and has no parts; a null id stays null; repeated rows are each reported; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.vectors import bind
from trapline.session import cut

REACH = 200
BLOCK = 256  # matches whose spans are gathered at a time
#: Fixed values, strong kinds in the order they are listed in spans: pattern, group measured, its least length, role.
STRONG_KINDS = {
    "assign": (
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, 6, "secret",
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 20, "identifier"),
    "hex": ("[0-9a-f]{24,}", 0, 24, "secret"),
}
WEAK_KINDS = {
    "user": ("(username|user|login|account|client_id)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)", 2, 3, "identifier"),
    "key": ("[A-Za-z0-9+/]{32,}", 0, 32, "secret"),
    "endpoint": (
        "(https?|ftp|postgres|mysql|mongodb|redis)://[A-Za-z0-9._~:@-]+|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}:[0-9]{2,5}",
        0, 8, "endpoint",
    ),
}
KINDS = {**STRONG_KINDS, **WEAK_KINDS}
ROLES = ["identifier", "secret", "endpoint"]
_SPANS = "array<struct<kind:string,start:int,stop:int>>"


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind as an array of (kind, start, stop); the pattern never matches the empty string."""
    pattern, group, least, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gap"))
    none = F.array().cast(_SPANS)

    def accepted(piece: Column) -> Column:
        fits = F.length(piece["value"]) >= least
        if kind == "key":  # a secret mixes digits, small and capital letters
            for letters in ("[0-9]", "[a-z]", "[A-Z]"):
                fits = fits & piece["value"].rlike(letters)
        return fits

    def width(piece: Column) -> Column:
        return F.length(piece["gap"]) + F.coalesce(F.length(piece["whole"]), F.lit(0))  # the last gap has no match behind it

    def step(state: Column, piece: Column) -> Column:
        start, stop = state["at"] + F.length(piece["gap"]), state["at"] + width(piece)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"))
        return F.struct(
            stop.alias("at"), F.concat(state["found"], F.when(accepted(piece), F.array(span)).otherwise(none)).alias("found")
        )

    def placed(pieces: Column) -> Column:
        """Starts of blocks of pieces first, then the spans of each block: a state that grows is copied for every piece, so
        it must not have all spans of a long text."""
        blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        of = lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))
        widths = F.transform(blocks, lambda b: F.aggregate(of(b), F.lit(0), lambda n, piece: n + width(piece)))
        starts = F.aggregate(
            widths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"],
        )

        def spans(b: Column, at: Column) -> Column:
            begin = F.struct(at.alias("at"), none.alias("found"))
            return F.aggregate(of(b), begin, step, lambda state: state["found"])

        return bind(starts, lambda known: F.flatten(F.transform(blocks, lambda b: spans(b, known[b]))))

    return F.when(text.rlike(pattern), bind(pieces, placed)).otherwise(none)


def find_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, strong, weak): the spans of every row, written out once; `row` tells repeated rows apart."""
    body = docs.select(F.monotonically_increasing_id().alias("row"), key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    both = {
        name: F.concat(*[matches(F.col("_text"), kind) for kind in kinds])
        for name, kinds in (("strong", STRONG_KINDS), ("weak", WEAK_KINDS))
    }
    return cut(body.select("row", key, *[spans.alias(name) for name, spans in both.items()]))


def link_weak(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, stop, roles): the weak parts with parts of other roles in scope, and which roles those are."""
    role = F.create_map(*[F.lit(x) for kind, spec in KINDS.items() for x in (kind, spec[3])])
    rows = (
        found.where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1))
        .select("row", F.inline(F.concat("strong", "weak")))
        .withColumns({"role": role[F.col("kind")], "cell": F.floor(F.col("start") / reach)})
    )
    ends = rows.groupBy("row", "cell", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    looked_at_from = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), (F.col("cell") - side).alias("from")) for side in (-1, 0, 1)]))
    sent = ends.withColumn("x", looked_at_from)

    def edge(role: str, side: int, column: str) -> Column:
        return F.max(F.when((F.col("role") == role) & (F.col("x.side") == side), F.col(column)))

    seen = sent.groupBy("row", F.col("x.from").alias("cell")).agg(
        *[edge(r, side, column).alias(f"{name}_{r}") for r in ROLES
          for name, side, column in (("before", -1, "last"), ("same", 0, "first"), ("after", 1, "first"))]
    )

    def in_scope(r: str) -> Column:
        near = (
            F.col(f"same_{r}").isNotNull()
            | F.coalesce(F.col("start") - F.col(f"before_{r}") <= reach, F.lit(False))
            | F.coalesce(F.col(f"after_{r}") - F.col("start") <= reach, F.lit(False))
        )
        return F.when((F.col("role") != r) & near, F.lit(r))

    weak = rows.where(F.col("kind").isin(*WEAK_KINDS)).join(seen, ["row", "cell"])
    return (
        weak.withColumn("roles", F.array_compact(F.array(*[in_scope(r) for r in ROLES])))
        .where(F.size("roles") > 0).select("row", "kind", "start", "stop", "roles")
    )


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(row, key, strong, weak): per row of `docs` all strong spans, and the weak ones that were linked."""
    found = find_parts(docs, key, text)
    linked = link_weak(found, reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("linked"))
    return found.join(linked, "row", "left").select(
        "row", key, "strong", F.coalesce("linked", F.array().cast(_SPANS)).alias("weak")
    )


def joined_spans(spans: Column) -> Column:
    """`kind:start:stop` by start, then by the order of the kinds, joined by commas."""
    rank = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: counts of the strong kinds, a digest of the strong spans, and all reported spans as a string."""
    def count(kind: str) -> Column:
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in STRONG_KINDS]
    return scanned.select(
        key, *counts, F.sha2(joined_spans(F.col("strong")), 256).alias("base_sha256"),
        joined_spans(F.concat("strong", "weak")).alias("spans"),
    )
