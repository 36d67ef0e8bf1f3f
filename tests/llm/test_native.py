"""Operators in built-in functions: quality rules, secret scans, URL filters."""

import brute
import pytest
from pyspark.sql import functions as F

from trapline.llm import credentials, decision_list, url_rules
from trapline.llm.registry import CHECKS, table

LONG = "alpha beta gamma delta " * 9_000
TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "x\n\nx\n x\nx", "a b c d e f " * 3 + "tail",
    "PassWord = 'abc123def' user: bob\nAKIA" + "A1" * 9, "secret=token:abcdefgh", "token : \"ab\" token=abcdefg",
    "é" * 10 + " password: geheim99 ü " + "0f" * 13 + " " + "aB3/" * 9, "aB3+" * 10, "https://db.host:5432 " + "w " * 150 + "user=amy",
    "user=amy " + "w " * 90 + "https://db.host:5432", "user=amy " * 400 + "ftp://h.example", LONG, "A" * 50_000, "1.2.3.4:8080 login=root",
]
SCHEMA = "doc_id long, text string, kind string, role string, row string, rule string, bad string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", "r", "w", "x", "y") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def test_statistics_as_by_hand(spark, given):
    docs = frame(spark, TEXTS)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", decision_list.base_failed().alias("f")]
    rows = decision_list.with_statistics(docs).select("doc_id", *columns).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {i: brute.statistics(t) for i, t in enumerate(TEXTS)}


def test_registered_rules_have_the_base_columns(spark, sf_dir, given):
    rows = CHECKS["op5_quality_rules"][0](spark, sf_dir).collect()
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r[c] for c in base) for r in rows) == sorted((i, *brute.statistics(t)) for i, t in given)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in rows)


def _labelled(spark, n, planted):
    stats = decision_list.with_statistics(spark.createDataFrame([(i, planted(i)) for i in range(n)], "doc_id long, text string"))
    return stats.withColumn("bad", F.col("doc_id") % 4 == 0).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3)))


def test_learned_list_separates_what_conditions_can(spark):
    clean = [f"w{i} is plain text number {i} of some length and more words here" for i in range(7)]
    rows = _labelled(spark, 400, lambda i: "junk ### *** $$$ more " * 4 if i % 4 == 0 else clean[i % 7])
    rules = decision_list.learn(rows)
    assert rules
    judged = rows.withColumn("rule", decision_list.verdict(rules))
    assert judged.where(F.col("rule").isNotNull() != F.col("bad")).count() == 0


def test_no_rule_from_labels_without_pattern(spark):
    assert decision_list.learn(_labelled(spark, 200, lambda i: "the same text for everyone of ten words at least here")) == []
    assert decision_list.learn(_labelled(spark, 8, lambda i: "x").limit(0)) == []


def test_rules_on_labels_with_nulls_and_repeats(spark):
    docs = frame(spark, TEXTS).union(frame(spark, TEXTS))
    labels = spark.createDataFrame([(0, None, 0), (1, 0, 1), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    judged, _ = decision_list.quality_rules(docs, labels)
    assert judged.count() == 2 * len(TEXTS)
    assert decision_list.quality_rules(docs.limit(0), labels.limit(0))[0].count() == 0


def _secrets(df):
    rows = credentials.secret_digest(credentials.scan_secrets(df)).collect()
    return sorted((r[0], r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in rows)


def test_secrets_as_by_hand(spark):
    assert _secrets(frame(spark, TEXTS)) == sorted((i, *brute.secrets(t)) for i, t in enumerate(TEXTS))


def test_secrets_of_the_table(spark, sf_dir, given):
    rows = CHECKS["op6_secret_scan"][0](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in rows) == sorted((i, *brute.secrets(t)) for i, t in given)


def test_secrets_of_repeated_rows_and_no_rows(spark):
    twice = frame(spark, TEXTS).union(frame(spark, TEXTS))
    assert _secrets(twice) == sorted(2 * _secrets(frame(spark, TEXTS)))
    assert _secrets(twice.limit(0)) == []


URLS = [
    None, "", "no scheme/en/", "http://Example.COM/en/1", "https://www.example.com/en/?x=1", "http://a.www.example.com/en/",
    "ftp://b.net/es/9", "b.net/es/9", "x://net/fr/", "x://notnet/fr/", "http://host.com", "http://host.com?/q", "http://h.com/a://b/c",
    "http://HÖST.net/es/#f", "http://example.com/EN/",
]


def _by_hand(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    cut = min(ends, default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = max(
        (r for r in url_rules.RULES
         if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith(r[1][r[1].index("/"):])),
        key=lambda r: len(r[1]), default=(None, None),
    )
    return host, path, best[1], best[0]


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, labels).collect()}
    expected = {i: _by_hand(u) for i, u in enumerate(URLS)}
    assert got == {i: (h, p, r, v or "allow") for i, (h, p, r, v) in expected.items()}
    assert url_rules.judge_urls(pages.limit(0), labels).count() == 0


def test_given_rules_of_the_table(spark, sf_dir):
    urls = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    for r in CHECKS["op9_url_filter"][0](spark, sf_dir).collect():
        host, path, rule, verdict = _by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))


def test_mined_rules_are_all_combinations_that_pass(spark):
    from itertools import combinations

    hosts = ["pills.org", "news.org", "shop.org", "blog.info"]
    rows = [(i, f"http://{hosts[i % 4]}/{'buy' if i % 3 else 'read'}/{i}?ref=x") for i in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = {i: (i % 4 == 0 and i % 3 > 0) or i % 31 == 0 for i, _ in rows}
    labels = spark.createDataFrame([(i, 0 if b else 1) for i, b in bad.items() if i % 5] + [(None, 0), (7, None)], "doc_id long, quality int")
    tokens = {r[0]: tuple(r[1]) for r in pages.select("page_id", url_rules.url_tokens(F.col("url"))).collect()}
    known = [i for i in bad if i % 5]
    count, hits = {}, {}
    for i in known:
        for k in range(1, len(tokens[i]) + 1):
            for c in combinations(tokens[i], k):
                count[c] = count.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + bad[i]
    n_bad = sum(bad[i] for i in known)
    least = max(5, 0.1 * n_bad)
    expected = {c: (hits[c], n) for c, n in count.items() if hits[c] >= least and hits[c] / n >= 0.6}
    labelled = pages.join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").where("quality is not null").select(
        url_rules.url_tokens(F.col("url")).alias("tokens"), (F.col("quality") == 0).alias("bad")
    )
    mined = url_rules.mine_rules(labelled, 0.1, 0.6, 5).collect()
    assert {tuple(r["items"]): (r.n_bad, r.n_pages) for r in mined} == expected and expected
    got = {r.page_id for r in url_rules.judge_urls(pages, labels, min_support=0.1, min_confidence=0.6).where("mined is not null").collect()}
    assert got == {i for i, t in tokens.items() if any(set(c) <= set(t) for c in expected)}


def test_pages_of_one_long_path(spark):
    """Sixty words that always stand together are one item, and a page with some of them meets its rule."""
    path = "/".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    rows = [(i, f"http://trap.biz/{path}?q={i}") for i in range(40)] + [(i, f"http://fine.org/page{i}") for i in range(40, 80)]
    rows += [(90, "http://other.org/waa/waz"), (91, "http://other.org/none"), (92, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels).collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(40), 90}


def test_a_long_text_full_of_parts(spark):
    """Five MB of endpoints in one text: its spans are gathered in blocks."""
    import time

    n = 360_000
    text = "10.0.0.1:8080 " * n + "password = secret99"
    docs = spark.createDataFrame([(1, text), (2, "10.0.0.1:8080 " * 600 + "user=abc")], "doc_id long, text string")
    before = time.time()
    rows = {r.doc_id: r for r in credentials.scan_secrets(docs).collect()}
    assert time.time() - before < 60
    assert [(s.start, s.stop) for s in rows[1].strong] == [(14 * n, 14 * n + 19)]
    near = [s.start for s in rows[1].weak]
    assert sorted(near) == [14 * k for k in range(n) if 14 * n - 14 * k <= 200]
    assert sorted(s.start for s in rows[2].weak if s.kind == "endpoint") == [14 * k for k in range(600) if 8400 - 14 * k <= 200]
