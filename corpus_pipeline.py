"""The corpus pipeline: five stages over ``documents``, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenwright.llm import decontamination, mixing, pii, quality, simhash
from screenwright.llm.common import keep, tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in line with the rules."""
    return quality.with_quality(docs).where("_kept").select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    found = decontamination.decontaminate(docs, tables(spark, sf_dir, "benchmark"))
    return found.where(~decontamination.contaminated()).select(*(f"`{c}`" for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the target weights of their sources, a row for each copy."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("personal_data", personal_data), ("mixture", mixture)]

#: SimHash and the trained classifier have no form in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
