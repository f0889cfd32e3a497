"""The corpus pipeline: five stages from documents to a training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the docs of the next.  All but the last return the columns of documents.
Columns beyond those, whatever their names, are handed on; rows repeated in documents
are one group of near-duplicates; empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemill.llm import decontaminate, mixing, quality, simhash, suffixes
from sourcemill.llm.session import scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts have too few words and go; very long ones are judged whole.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    The smallest doc_id stays, a null one only where the group has no other; texts without
    a word are one group; very long texts are hashed whole.
    """
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has too; documents without a word left go.

    A null doc_id is later than all others; of rows with one doc_id none is earlier; very
    long texts are sorted whole; n_chars follows the new text.
    """
    cleaned = suffixes.without_repeats(docs)
    cleaned = cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts and items overlap nothing; an empty benchmark keeps all.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which document is used in which pass and place of its source.

    A null source is one of its own; a document with a null doc_id is used like any other.
    """
    return mixing.mix(docs, target_entropy=mixing.TARGET_ENTROPY)


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_free),
    ("source_mixing", mixture),
]

#: Suffix arrays, wide fingerprints and spaced seeds have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
