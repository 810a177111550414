"""The queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sequoria.llm import contamination, divergence, fuzzy_lines, jaccard_join, page_template, personal_data, ranked_search, recompression, repetition, sampled_pieces, secret_scan, suffix_dedup, word_bpe


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, benchmark = _table("documents"), _table("pages"), _table("benchmark")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.extract_articles(pages(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_report(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir), size=3, least=90)


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_report(documents(spark, sf_dir))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.encode_documents(documents(spark, sf_dir))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeat_report(documents(spark, sf_dir))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_report(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.best_documents(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(documents(spark, sf_dir))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip_report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_html_extraction": op2_html_extraction,
        "op3_personal_data": op3_personal_data,
        "op4_decontamination": op4_decontamination,
        "op5_quality_rules": op5_quality_rules,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_fuzzy_lines": op7_fuzzy_lines,
        "op8_sampled_pieces": op8_sampled_pieces,
        "op9_recompression": op9_recompression,
        "op10_suffix_arrays": op10_suffix_arrays,
        "op11_ranked_search": op11_ranked_search,
        "op12_source_divergence": op12_source_divergence,
        "op13_word_bpe": op13_word_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": contamination.SQL,
        "op5_quality_rules": repetition.SQL,
        "op6_jaccard_join": jaccard_join.SQL,
        "op9_recompression": recompression.SQL,
        "op10_suffix_arrays": suffix_dedup.SQL,
        "op11_ranked_search": ranked_search.SQL,
        "op12_source_divergence": divergence.SQL,
    }
