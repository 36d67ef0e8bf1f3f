"""The registered queries of this subpackage and their SQL: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import bbit_minhash, containment, credentials, decision_list, jaccard_join, line_crf, line_runs, packing, ranked_search, shards, suffixes, token_alignment, url_rules
from trapline.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = shards.materialise(table(spark, sf_dir, "documents"))
    return index


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_digest(credentials.scan_secrets(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_report(line_runs.drop_later_runs(table(spark, sf_dir, "documents")))


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_report(line_runs.drop_repeated_lines(table(spark, sf_dir, "documents")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


CHECKS = {
    "op1_jaccard_join": (op1_jaccard_join, jaccard_join.ORACLE_SQL),
    "op2_training_shards": (op2_training_shards, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_pack": (op4_pack, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_decontamination": (op7_decontamination, containment.ORACLE_SQL),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_url_filter": (op9_url_filter, None),
    "op10_line_dedup": (op10_line_dedup, line_runs.RUNS_SQL),
    "op10_line_windows": (op10_line_windows, line_runs.ORACLE_SQL),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_minhash_dedup": (op12_minhash_dedup, bbit_minhash.ORACLE_SQL),
    "op13_ranked_search": (op13_ranked_search, ranked_search.ORACLE_SQL),
}
