"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language, licenses, line_dedup, negatives, packing, quality, repeats, simhash, spelling, token_files, warc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), length=1024, end_id=0)


def op2_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_documents(spark, sf_dir))


def op3_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_documents(spark, sf_dir))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir))


def op5_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=2)


def op8_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), words=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op10_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_documents(spark, sf_dir), length=400)


def op12_trie_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def op13_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_packing,
        op2_language_masks,
        op3_segment_edit_join,
        op4_robust_outliers,
        op5_warc_chains,
        op6_sentence_rules,
        op7_direct_codes,
        op8_qgram_leaks,
        op9_simhash_components,
        op10_template_slots,
        op11_bucket_refinement,
        op12_trie_automata,
        op13_ball_trees,
    )
}

#: DuckDB SQL by query; the others' results can't be expressed there and are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op6_sentence_rules": licenses.oracle_sql(), "op13_ball_trees": negatives.oracle_sql()}
