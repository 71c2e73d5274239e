"""A filtering pipeline over `documents`: each stage works on what the one before it kept, written as Parquet and read
again.  All stages but the last return the columns of documents; the last places every document in a training bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexharbor.llm import nearcopies, packing, passages, quality, secrets
from lexharbor.llm.common import drop, read, scratch_tables, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go (operator 3)."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 7's trees, 5-word shingles, similarity 0.8)."""
    return nearcopies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out (operator 10)."""
    return passages.remove_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark (operator 1)."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in bins of several lengths (operator 6)."""
    return packing.pack_documents(stored(packing.token_lengths(docs), spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the forest, the trees or the packing; tests/llm/test_stages.py holds every stage against a
#: brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another.  A stage's scratch tables and its input go once its result is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch_tables(spark):
            after = stored(stage(spark, docs, sf_dir), spark, keep=True)
        if before is not None:
            drop(spark, before)
        docs = before = after
    return docs
