"""Citations of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render() -> Column:
    part = F.when(F.col("chunk_index").isNotNull() & F.col("chunk_total").isNotNull(), F.concat(F.lit(" ["), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("chunk_total").cast("string"), F.lit("]")))
    head = F.when(F.col("section_heading").isNotNull(), F.concat(F.lit(" — "), F.col("section_heading")))
    return F.concat(F.col("source_title"), F.coalesce(part, F.lit("")), F.coalesce(head, F.lit("")), F.lit(" ("), F.col("license"), F.lit(")"))


def build(hits: DataFrame) -> DataFrame:
    """One citation for each chunk of a query, the first by position, with ``citation``."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("position")
    first = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    known = first.withColumns({"source_title": F.coalesce("source_title", F.lit("unknown")), "license": F.coalesce("license", F.lit("UNKNOWN"))})
    return known.withColumn("citation", render())


def required_attributions(citations: DataFrame) -> DataFrame:
    """``query_id, attributions``: the distinct licences that ask for attribution, sorted."""
    need = F.when(F.col("license").rlike("BSD|CC"), F.col("license"))
    return citations.groupBy("query_id").agg(F.array_sort(F.collect_set(need)).alias("attributions"))
