"""Corpus preparation: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of `documents`. run() writes each
stage's result in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm.decontaminate import decontaminate
from lociforge.llm.length_buckets import length_buckets
from lociforge.llm.near_dedup import near_dedup
from lociforge.llm.quality import quality_filter
from lociforge.llm.store import written
from lociforge.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are rejected; rows that repeat an id are each judged."""
    return quality_filter(docs).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates.

    Rows with a null id stay, as do all rows of an id that stays.
    """
    dropped = near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; all stay, if with an empty text. Words are parted by one space.

    Rows with a null id lose nothing; rows that repeat an id are one document, which loses nothing to itself.
    """
    kept = substring_dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; all of them, if there are no items. Null texts are clean."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, carry=("text", "lang", "source", "n_chars")).where("not contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of the documents that are left, rows with null ids and empty texts among them."""
    return length_buckets(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL for run()'s rows; none, as SQL can't express the boundaries that dynamic programming chooses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. No documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
