"""The registered queries of the ten operators, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import op01_jaccard, op02_decontaminate, op03_materialise, op04_quality, op05_toxicity, op06_html, op07_lm, op08_urls, op09_secrets, op10_bpe
from marginalia.session import Scratch, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_jaccard.join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "shards").path("training-order")
    total, layout = op03_materialise.write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, out, key=20240229)
    return op03_materialise.index(spark, out, layout) if total else spark.createDataFrame([], "slot long, shard int, byte_offset long, doc_id long, seq int, n_tokens int, tokens_sha256 string")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_quality.quality(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_html.extract(table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_lm.score(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_secrets.digest(op09_secrets.secrets(table(spark, sf_dir, "documents")))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


_ALL = (
    op1_ngram_jaccard_join,
    op2_benchmark_decontamination,
    op3_token_id_output,
    op4_quality_rules,
    op5_toxicity,
    op6_html_extraction,
    op7_lm_scoring,
    op8_url_filters,
    op9_secret_scans,
    op10_byte_level_bpe,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op1_ngram_jaccard_join": op01_jaccard.ORACLE, "op4_quality_rules": op04_quality.ORACLE}
