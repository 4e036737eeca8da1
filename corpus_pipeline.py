"""The corpus pipeline: from ``documents`` to packed batches.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import entries, exact_dedup, mixing, near_dup, packing, quality
from loomtext.llm.common import materialise, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, entries.trusted_ids(table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity joins, the document with the least doc_id stays."""
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the languages meet their shares; every document stays at least once."""
    labels = table(spark, sf_dir, "labels")
    return mixing.resample(docs, entries.labelled_domains(docs, labels), entries.TARGETS, least=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its length in words and its place: bucket, boundary, batch, slot and padding."""
    n = F.size(quality.words_of(F.coalesce("text", F.lit("")))).cast("long")
    sized = docs.select("*", F.explode(F.array(n)).alias("n_tokens"))  # one value a row: a text is cut into words once, however often its length is asked for
    return packing.pack(sized, "n_tokens", "doc_id", entries.BUCKETS, entries.BUDGET, stored=True)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing to target weights", mix), ("packing", pack)]

#: The stages cut texts by content and fit models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
