"""The lexical arm: an inverted index and BM25 as DataFrame algebra."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as tx

if TYPE_CHECKING:
    from loomtext.operators.segments import Segments


class LexicalIndexError(RuntimeError):
    """The index is empty or missing."""


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame  # term, chunk_id, tf
    doc_stats: DataFrame  # chunk_id, ord, dl
    term_stats: DataFrame  # term, df, idf
    corpus_stats: DataFrame  # n, avgdl, avg_idf


def doc_length(text: Column) -> Column:
    """The number of terms of a chunk's text."""
    return F.size(tx.terms(F.coalesce(text, F.lit("")))).cast("long")


def build_index(chunks: DataFrame, epsilon: float = 0.25) -> LexicalIndex:
    """The index over (chunk_id, ord, text). Inverse document frequencies below zero become epsilon times their mean."""
    tokens = chunks.select("chunk_id", "ord", tx.terms(F.coalesce("text", F.lit(""))).alias("terms"))
    doc_stats = chunks.select("chunk_id", F.col("ord").cast("long").alias("ord"), doc_length(F.col("text")).alias("dl"))
    exploded = tokens.select("chunk_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    # A chunk's different terms are counted where they are read; no posting moves for it.
    freq = tokens.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return with_statistics(exploded.groupBy("term", "chunk_id").agg(F.count("*").alias("tf")), doc_stats, epsilon, freq)


def with_statistics(postings: DataFrame, doc_stats: DataFrame, epsilon: float = 0.25, freq: DataFrame | None = None) -> LexicalIndex:
    """The index of these postings and document lengths: statistics of terms and corpus are sums over them. ``freq`` (term, df) if it is known already."""
    sizes = doc_stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    freq = postings.groupBy("term").agg(F.count("*").alias("df")) if freq is None else freq
    raw = freq.crossJoin(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = raw.agg(F.avg("raw").alias("avg_idf"))  # one row
    idf = F.when(F.col("raw") < 0, epsilon * F.col("avg_idf")).otherwise(F.col("raw"))
    term_stats = raw.crossJoin(F.broadcast(means)).select("term", "df", F.round(idf, 12).alias("idf"))
    return LexicalIndex(postings, doc_stats, term_stats, sizes.crossJoin(F.broadcast(means)))


def bm25_topk(queries: DataFrame, index: LexicalIndex | Segments, k: int = 24, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, chunk_id, score, lexical_rank``: the k best chunks with a score above zero.

    A term counts as often as the query has it. Scores are rounded to 6 places
    before they are ranked; ties go by corpus order. Only postings of terms
    that some query has are read into the join; of an index of segments, only
    those that may matter.
    """
    if not isinstance(index, LexicalIndex):
        return index.topk(queries, k, k1, b)
    asked = queries.select("query_id", F.explode_outer(tx.terms(F.coalesce("query", F.lit("")))).alias("term")).where(F.col("term").isNotNull())
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = asked.join(index.term_stats, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    # What a posting gives doesn't depend on the query, so it is worked out once for each posting, before queries multiply them.
    needed = index.postings.join(weighted.select("term").distinct(), "term", "left_semi")
    sized = needed.join(index.doc_stats, "chunk_id").crossJoin(F.broadcast(index.corpus_stats))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = sized.select("term", "chunk_id", "ord", impact.alias("impact")).join(weighted, "term")
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"), F.min("ord").alias("ord"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ord"))
    ranked = scored.where("score > 0").withColumn("lexical_rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("lexical_rank") <= max(1, k)).drop("ord")


def save_index(index: LexicalIndex, path: str, epsilon: float = 0.25) -> None:
    """Write the index; an empty one is refused. Statistics are taken from the postings as written, so that texts are read once."""
    spark = index.postings.sparkSession
    if index.doc_stats.isEmpty():
        raise LexicalIndexError("refusing to save an empty index")
    # Postings lie together by term, so that those of a few terms are few row groups.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.postings.repartition(parts, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    written = with_statistics(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats"), epsilon)
    for name in ("term_stats", "corpus_stats"):
        getattr(written, name).write.mode("overwrite").parquet(f"{path}/{name}")


def open_index(spark: SparkSession, path: str) -> tuple[LexicalIndex | None, str | None]:
    """The index, or None and what is wrong with it: search then goes on with the dense arm alone."""
    try:
        return load_index(spark, path), None
    except LexicalIndexError as e:
        return None, str(e)


def no_hits(queries: DataFrame) -> DataFrame:
    """What :func:`bm25_topk` gives without an index."""
    return queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("lexical_rank"))


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    try:
        index = LexicalIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "doc_stats", "term_stats", "corpus_stats")))
    except Exception as e:  # Spark's error for a missing path
        raise LexicalIndexError(f"no index at {path}") from e
    if index.doc_stats.isEmpty():
        raise LexicalIndexError(f"the index at {path} is empty")
    return index
