"""The corpus pipeline: five operators in a row, each on what the one before kept.

toxicity -> MinHash near-dedup -> substring dedup -> benchmark decontamination -> BPE encoding and decoding.

Every stage but the last returns the columns of ``documents``, extra ones too; ``run`` writes each stage's rows to the
shared folder, reads them again, and drops what the stage after has replaced.  ``n_chars`` follows the text where a stage
changes it.  Tables beside the documents (labels, benchmark) are read from ``sf_dir``.  SQL can't express the learnt first
stage, so there is no ORACLE_SQL; tests hold the stages against brute force.

Near-dedup takes shingles of five words here (the operator's own query takes four, as its contract says).

Defined cases, for all stages: a row with a null, empty or blank text stays and has no ids in the end; a row that loses
all words to substring dedup or decontamination goes; a row without a doc_id is judged by its text alone, links with
nothing, repeats nothing and stays; repeated rows, and rows that share a doc_id, stay or go together in near-dedup and are
cut each by its own text against the benchmark; ties go to the smallest doc_id; texts of any length are worked on whole;
empty documents give no rows, without labels nothing is toxic, without a benchmark nothing is contaminated; extra columns
are kept and don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import bpe, decontamination, near_dedup, substring_dedup, toxicity
from twinlens.llm.common import drop_path, trim_driver, written
from twinlens.llm.queries import table, tokenizer


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there is such a column, after the texts were cut."""
    if "n_chars" not in docs.columns:
        return docs
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(length, "n_chars"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    kept = toxicity.filter_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    trim_driver(spark)  # of the examples, which workers have now
    return kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of smallest doc_id."""
    groups = near_dedup.near_duplicates(docs, width=5, percent=80)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier passage go; documents of which nothing stays go too."""
    return _counted(substring_dedup.cut_rows(docs, docs.columns, width=20))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in a benchmark window go; documents of which nothing stays go too."""
    return _counted(decontamination.cut_rows(docs, table(spark, sf_dir, "benchmark"), docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document."""
    return bpe.encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("bpe encoding and decoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before:
            drop_path(spark, before)
        before = docs.scratch_path
    return STAGES[-1][1](spark, docs, sf_dir)
