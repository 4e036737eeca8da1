"""Reciprocal-rank fusion and the resolution of chunk ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank, found_by, dense_rank, lexical_rank``.

    The score is the sum of 1 / (k + rank) over both lists. Order: score, best
    rank, id. A chunk that a list repeats has its last rank there.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    d = dense.groupBy("query_id", "chunk_id").agg(F.max("dense_rank").alias("dense_rank"))
    x = lexical.groupBy("query_id", "chunk_id").agg(F.max("lexical_rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("dense_rank") + part("lexical_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.least("dense_rank", "lexical_rank"), "chunk_id")
    found = F.when(F.col("lexical_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "lexical").otherwise("both")
    out = scored.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("found_by", found)
    return out if limit is None else out.where(F.col("rank") <= limit)


def resolve(fused: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fused hits with their chunk's columns, and the hits whose chunk is gone."""
    side = chunks.withColumnRenamed("id", "chunk_id")
    return fused.join(side, "chunk_id"), fused.join(side.select("chunk_id"), "chunk_id", "left_anti")
