"""From raw documents to a training mix, stage by stage; every stage is one of the operators of ``scorewise.llm``.

A stage takes the documents that its predecessor kept and returns those that it keeps, with the columns of ``documents``; the
last one returns the mix itself, a row per copy. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewise.llm import decontaminate, exact, language, mixing, near
from scorewise.llm.queries import ARROW_ROWS, table
from scorewise.session import configure
from scorewise.sources.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letters, or no language with three words in ten."""
    prepared(spark)
    return language.recognised(docs, language.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepared(spark)
    return exact.without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    prepared(spark)
    return near.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    prepared(spark)
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks for."""
    prepared(spark)
    return mixing.mixed(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
]

ORACLE_SQL = None  # language shares and sketches cannot be said in SQL; tests/llm holds a brute-force version


def prepared(spark: SparkSession) -> SparkSession:
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
