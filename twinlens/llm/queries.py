"""The corpus operators as queries over the driver's tables, and SQL for those that SQL can express.

Tokenizer files are found by ``TWINLENS_TOKENIZERS`` (a folder) or through the ``public_tokenizers`` package.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from twinlens.llm.oracles import SQL


ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tokenizer(name: str) -> str:
    folder = os.environ.get("TWINLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; texts are handed to workers fewer at a time than Spark's default, since they may be long."""
    if spark.conf.get(ROWS_AT_ONCE, "10000") == "10000":
        spark.conf.set(ROWS_AT_ONCE, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm import kneser_ney

    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.fit(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.substring_dedup import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"), width=20)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from twinlens.llm import quality_classifier

    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_bpe": op6_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = dict(SQL)
