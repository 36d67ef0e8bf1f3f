"""URL filters: given host and path rules first, then association rules mined from labelled pages.

Spark's FP-growth finds the token combinations that many bad pages share. A combination becomes a rule if enough of
all labelled pages that have it are bad. Tokens that stand on the same labelled pages, as the words of a path that is always
the same, are one item: combinations of them would all have the same pages, and there are exponentially many. A page has
an item if it has one of its tokens, so it meets a rule of items if it meets one of the combinations. Rules are found again in URLs by an inverted index: each is filed under its
rarest token only, so a URL meets the few rules filed under its own tokens.

Nulls: a null URL, or one without `://`, has an empty host, an empty path and no tokens, and no rule fits it. Labels
with a null key or value teach nothing. Empty tables give no mined rules or no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.session import cut

#: The rules as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.5
MIN_PAGES = 5

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def after_scheme(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)


def url_host(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, with A-Z in lower case."""
    host = F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path words with digits as one sign, and names of query arguments."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    query = F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&")
    path = F.split(F.regexp_replace(F.lower(url_path(url)), "[0-9]+", "0"), "[/._-]+")
    parts = [
        F.transform(F.split(url_host(url), "[.]"), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(path, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("q:"), F.lower(F.substring_index(x, "=", 1)))),
    ]
    return F.array_sort(F.filter(F.array_distinct(F.concat(*parts)), lambda x: F.length(x) > 2))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filed(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """The inverted index: every rule (an array `items`) under its rarest token, by the counts (token, uses)."""
    per_token = rules.select("items", F.explode("items").alias("token")).join(uses, "token", "left")
    order = F.struct(F.coalesce("uses", F.lit(0)), "token")
    return per_token.groupBy("items").agg(F.min(order).alias("least")).select("items", F.col("least.token").alias("token"))


def holds(tokens: Column, items: Column) -> Column:
    return F.size(F.array_except(items, tokens)) == 0


def token_items(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens on the same rows of `labelled` have one item, the least of them."""
    rows = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("token"))
    same = ["n", "one", "two"]  # the rows of a token, by their number and two 64-bit sums
    placed = rows.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64(F.lit("two"), "row")).alias("two")
    )
    return placed.join(placed.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item")


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """`rows` with `items`: the items of their `tokens`; a token without an item is its own."""
    sets = rows.select("tokens").distinct()
    spread = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token", "left")
    found = spread.groupBy("tokens").agg(F.array_sort(F.collect_set(F.coalesce("item", "token"))).alias("items"))
    return rows.join(found, "tokens", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Rules (items, n_bad, n_pages, confidence) from (tokens, bad).

    `min_support` is the share of bad pages that must have all items; `min_pages` a least number of bad pages,
    `min_confidence` the share of bad ones among all labelled pages with these items.
    """
    bad = cut(labelled.where(F.col("bad") & (F.size("tokens") > 0)).select("tokens"))
    n_bad = bad.count()
    if n_bad == 0:
        return labelled.sparkSession.createDataFrame(
            [], "items array<string>, n_bad bigint, n_pages bigint, confidence double"
        )
    model = FPGrowth(itemsCol="tokens", minSupport=max(min_support, min(1.0, min_pages / n_bad))).fit(bad)
    frequent = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad"))
    frequent = cut(frequent.where(F.col("n_bad") >= min_pages))
    token_sets = labelled.groupBy("tokens").agg(F.count("*").alias("pages"))
    spread = token_sets.select("tokens", "pages", F.explode("tokens").alias("token"))
    uses = spread.groupBy("token").agg(F.sum("pages").alias("uses"))
    counts = (
        spread.join(filed(frequent, uses), "token").where(holds(F.col("tokens"), F.col("items")))
        .groupBy("items").agg(F.sum("pages").alias("n_pages"))
    )
    confidence = F.col("n_bad") / F.col("n_pages")
    return frequent.join(counts, "items").withColumn("confidence", confidence).where(confidence >= min_confidence)


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct `tokens` of the pages that meet a rule: the most confident one, `mined`."""
    token_sets = pages.select("tokens").distinct()
    spread = token_sets.select("tokens", F.explode("tokens").alias("token"))
    uses = spread.groupBy("token").agg(F.count("*").alias("uses"))
    index = filed(rules.select("items"), uses).join(rules.select("items", "confidence"), "items")
    best = F.max_by(F.concat_ws(" ", "items"), F.struct("confidence", F.concat_ws(" ", "items")))
    met = spread.join(index, "token").where(holds(F.col("tokens"), F.col("items")))
    return met.groupBy("tokens").agg(best.alias("mined"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id",
    label_key: str = "doc_id", bad: Column | None = None, min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Per page: key, host, path, rule, verdict, and `mined`, the association rule that was met (or null).

    The verdict is that of the longest given rule; without one, block if a mined rule is met, else allow.
    A page whose key repeats is judged once for each of its rows.
    """
    bad = F.col("quality") == 0 if bad is None else bad
    own = pages.select(key, "url").withColumns(
        {"host": url_host(F.col("url")), "path": url_path(F.col("url")), "tokens": url_tokens(F.col("url"))}
    )
    marks = labels.select(F.col(label_key).alias(key), bad.alias("bad")).where(F.col("bad").isNotNull())
    labelled = cut(own.join(marks, key).select("tokens", "bad"))
    items = cut(token_items(labelled))
    mined = cut(mine_rules(with_items(labelled, items).select(F.col("items").alias("tokens"), "bad"), min_support, min_confidence, min_pages))
    if mined.isEmpty():
        met = own.select("tokens", F.lit("").alias("mined")).limit(0)
    else:
        sets = with_items(own.select("tokens").distinct(), items)
        met = sets.join(match_rules(sets.select(F.col("items").alias("tokens")), mined).withColumnRenamed("tokens", "items"), "items")
        met = met.select("tokens", "mined")
    given = given_rule(F.col("host"), F.col("path"), rules)
    return (
        own.join(met, "tokens", "left").withColumn("given", given)
        .select(
            key, "host", "path", F.col("given.rule").alias("rule"),
            F.coalesce(F.col("given.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            "mined",
        )
    )
