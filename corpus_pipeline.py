"""From raw documents to token ids: each stage's result is written and read back as the next one's documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, decontam, langid, mixture, neardup, tokenids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: null and letterless texts, and those with too few n-grams of any learned language.

    Without labelled documents all go; equal rows go or stay together; an empty table stays empty. As in all stages, other
    columns pass through, whatever their names, and a null doc_id is an id.
    """
    return langid.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8 or more).

    The least doc_id of a group stays; rows that repeat it stay once. Texts without words and rows without doc_id are of no
    group and stay; an empty table stays empty.
    """
    return neardup.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null texts and texts of fewer than five words stay; equal rows go or stay together; an empty benchmark or table changes
    nothing.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a copy for each pass that takes at least half of the words.

    Documents without words go; a null source is a source; equal rows are documents of their own; an empty table stays empty.
    """
    return mixture.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with document boundaries, and what is read back of each document.

    A null text holds the end id alone; null doc_ids come first; rows that repeat a doc_id keep a row each; an empty table
    gives no rows.
    """
    return tokenids.token_ids(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture_of_sources),
    ("token_ids", token_output),
]
#: Not SQL, as the first and last stage are not; tests hold the stages between against brute force, each on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes as soon as the next one's documents are written."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    kept = set(common.tables())
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_tables(spark, [t for t in common.tables() if t not in kept and t != docs.scratch_path])
    return STAGES[-1][1](spark, docs, sf_dir)
