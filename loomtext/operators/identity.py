"""Chunk records: validation, links and set differences."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = (
    "id", "text", "source_id", "source_path", "source_title", "license", "source_checksum", "chunk_index", "chunk_total",
    "chunk_profile", "embedding_model", "embedding_dimension", "tokenizer", "token_count", "ingested_at",
)


def validate(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``violations``, an array of codes, empty for valid rows. Missing columns count as null."""
    codes = [F.when(F.col(c).isNull() if c in chunks.columns else F.lit(True), F.lit(f"missing:{c}")) for c in REQUIRED]
    if "license" in chunks.columns:
        codes.append(F.when(F.trim("license") == "", F.lit("blank:license")))
    if "token_count" in chunks.columns:
        codes.append(F.when(F.col("token_count") <= 0, F.lit("range:token_count")))
    return chunks.withColumn("violations", F.array_compact(F.array(*codes)))


def link_neighbors(chunks: DataFrame) -> DataFrame:
    """``chunk_prev_id`` and ``chunk_next_id`` by position inside one file. Only keys are sorted by file; texts meet their links by id.

    Rows that repeat source, path, position and id are one record and have its links.
    """
    place = ["source_id", "source_path", "chunk_index", "id"]
    w = Window.partitionBy("source_id", "source_path").orderBy("chunk_index", "id")
    links = chunks.select(*place).distinct().select(*[F.col(c).alias(f"__{c}") for c in place], F.lag("id").over(w).alias("chunk_prev_id"), F.lead("id").over(w).alias("chunk_next_id"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
    return chunks.drop("chunk_prev_id", "chunk_next_id").join(links, functools.reduce(operator.and_, same)).drop(*[f"__{c}" for c in place])
