"""A corpus pipeline of five stages: each takes the documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfund.llm.common import table, written
from quillfund.llm.pieces import default_model, digests, encode_and_decode
from quillfund.llm.simhash import keep_one
from quillfund.llm.spaced_seeds import clean
from quillfund.llm.surrogates import replace_pii
from quillfund.llm.weak_toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go; it is fitted on the labelled ones among ``docs``."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    return replace_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's ids, with the digests of ids and decoded text."""
    found = encode_and_decode(docs, default_model())
    return digests(found, "ids")


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("pii surrogates", pii), ("sentencepiece", tokens)]

#: Training a classifier, XXH64 and BPE have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again, over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
