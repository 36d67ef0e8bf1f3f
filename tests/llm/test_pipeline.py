"""The pipeline, stage by stage, against plain versions."""

import brute
import corpus_pipeline as cp
import pytest
from test_packing import check, ids_of
from test_pairs import brute_components, brute_runs

from trapline.llm import decision_list


def plain_verdict(rules, text):
    """Whether a text stays: the base rules and the learned list, on counts made by hand."""
    n_words, word_chars, symbols, dup, repeat, failed = brute.statistics(text)
    text = text or ""
    lines = [x for x in text.split("\n") if brute.words(x)]
    counts = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "n_lines": len(lines), "n_distinct_words": len(set(brute.words(text))), "n_marks": sum(c in "!?" for c in text),
        "n_capitals": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text),
    }

    def value(name):
        top, bottom = decision_list.FEATURES[name]
        return counts[top] / max(1, counts[bottom]) if bottom else float(counts[top])

    hit = any(all((value(c.feature) > c.threshold) == c.above for c in rule) for rule in rules)
    return not failed and not hit


def test_every_stage_on_what_the_one_before_kept(spark, sf_dir, monkeypatch):
    from tokenizers import Tokenizer

    from trapline.llm import tokens

    inputs = {}

    def recorded(name, stage):
        def run(spark, docs, sf_dir):
            inputs[name] = docs
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(cp, "STAGES", [recorded(*stage) for stage in cp.STAGES])
    packed = cp.run(spark, sf_dir).collect()
    assert list(inputs) == [name for name, _ in cp.STAGES]

    docs = inputs["quality_rules"]
    assert all(table.columns == docs.columns for table in inputs.values())
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    statistics = decision_list.with_statistics(known)
    rules = decision_list.learn(decision_list.with_labels(statistics, labels, "doc_id", "quality"))
    found = {r.doc_id: tuple(r) for r in inputs["line_dedup"].collect()}
    assert found == {k: tuple(r) for k, r in rows.items() if plain_verdict(rules, r.text)}

    ids = sorted(found)
    texts = brute_runs([found[i][1] for i in ids], 10)
    expected = {}
    for k, i in enumerate(ids):
        text, gone = texts[k]
        if not gone or brute.words(text):
            r = rows[i]
            expected[i] = (i, text, r.lang, r.source, len(text) if gone else r.n_chars)
    assert {r.doc_id: tuple(r) for r in inputs["ngram_jaccard"].collect()} == expected

    ids = sorted(expected)
    groups = brute_components([expected[i][1] for i in ids], 5, 80)
    expected = {i: expected[i] for k, i in enumerate(ids) if groups[k][1] == k}
    assert {r.doc_id: tuple(r) for r in inputs["decontamination"].collect()} == expected

    items = [brute.shingle_set(r.text, 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        own = brute.shingle_set(text, 5)
        return any(s and 100 * len(s & own) >= 80 * len(s) for s in items)

    expected = {i: r for i, r in expected.items() if not leaks(r[1])}
    assert {r.doc_id: tuple(r) for r in inputs["packing"].collect()} == expected
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    check(packed, {i: ids_of(tokenizer, r[1]) for i, r in expected.items()})


@pytest.mark.parametrize("n", [0, 4])
def test_odd_rows_and_no_rows(spark, tmp_path, n):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    same = (2, "a b\n" * 40, "en", "s", 160)
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), same, same], schema)
    docs.limit(n).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0  # the base rules reject all of them
