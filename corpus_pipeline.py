"""Corpus pipeline: quality classifier, quality rules, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's rows as Parquet to the shared
scratch folder and rereads them as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import near_dup, packing, pii, quality_classifier, quality_rules
from newsloom.llm.arrow import written
from newsloom.sources.tables import read_table

# The classifier's model is fitted, not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: drops documents predicted to be of low quality.

    Null and empty texts are scored like any other. Rows that repeat an id are scored each for itself. Without labels, or
    with labels of one kind only, the model gives one score to all. An empty table gives no rows.
    """
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read_table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: drops documents that fail the threshold table. Null and empty texts have no words and fail; equal rows
    fare alike; an empty table gives no rows; other columns pass whatever their names."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group stays (five words, similarity 0.8), that of the smallest id. Texts without
    words are in no group; of rows that repeat an id one stays; rows without an id all stay."""
    return near_dup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: replaces personal data by pseudonyms under the session's key. Null texts stay null; equal values get equal
    pseudonyms in every row; ids and other columns stay."""
    return pii.rewrite(docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: assigns every row to a bucket, a batch and a slot, those of null and empty texts (no words) and repeated
    rows too. An empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_model), ("quality_rules", rules), ("near_duplicates", near_duplicates),
          ("pii", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
