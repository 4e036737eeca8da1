"""The policy chain after fusion. Every step works on all queries at once, by query_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclude(hits: DataFrame, types: tuple[str, ...], when: str | None = None) -> DataFrame:
    """Drop hits of these document types, for the queries whose flag ``when`` is set (None: all). Hits without a type stay."""
    bad = F.coalesce(F.col("doc_type").isin(list(types)), F.lit(False))
    return hits.where(~(bad if when is None else bad & F.col(when)))


def dedup(hits: DataFrame) -> DataFrame:
    """Of hits with one fingerprint the best ranked stays."""
    w = Window.partitionBy("query_id", "fingerprint").orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cap_per_document(hits: DataFrame, cap: int = 3) -> DataFrame:
    """At most ``cap`` hits for each source path (else source id)."""
    owner = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), F.nullif(F.col("source_id"), F.lit("")), F.lit("?"))
    w = Window.partitionBy("query_id", owner).orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def demote(hits: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """``position``: hits of these types after all others, else by rank. Ranks stay."""
    last = F.coalesce(F.col("doc_type").isin(list(types)), F.lit(False))
    w = Window.partitionBy("query_id").orderBy(last, "rank")
    return hits.withColumn("position", F.row_number().over(w).cast("long"))


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("position") <= k)


def expand_neighbors(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks before and after each hit that are not hits themselves, in order of first mention; score 0, after the hits."""
    kept = hits.select("query_id", "chunk_id")
    said = hits.select("query_id", "position", F.posexplode(F.array("chunk_prev_id", "chunk_next_id")).alias("side", "neighbor")).where(F.col("neighbor").isNotNull())
    first = said.groupBy("query_id", F.col("neighbor").alias("chunk_id")).agg(F.min(F.struct("position", "side")).alias("at"))
    new = first.join(kept, ["query_id", "chunk_id"], "left_anti").join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")
    count = hits.groupBy("query_id").agg(F.max("position").alias("__last"))
    w = Window.partitionBy("query_id").orderBy("at")
    new = new.withColumn("__n", F.row_number().over(w)).join(count, "query_id").withColumn("position", (F.col("__last") + F.col("__n")).cast("long"))
    made = {"score": F.lit(0.0), "rank": F.lit(None).cast("long"), "found_by": F.lit("neighbor"), "dense_rank": F.lit(None).cast("long"), "lexical_rank": F.lit(None).cast("long")}
    new = new.withColumns(made).withColumn("is_neighbor", F.lit(True))
    return hits.withColumn("is_neighbor", F.lit(False)).unionByName(new.drop("at", "__n", "__last"), allowMissingColumns=True)


def trim_budget(hits: DataFrame, budget: int = 2048, cost: str = "token_count") -> DataFrame:
    """The longest prefix, by position, whose costs stay within the budget."""
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("spent", F.sum(F.greatest(F.col(cost), F.lit(0))).over(w).cast("long")).where(F.col("spent") <= budget)
