"""Hybrid search over a table of queries: one plan, whatever their number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import dense, fusion, lexical, policy
from loomtext.operators.filters import compile_filter
from loomtext.sources.files import written
from loomtext.settings import Retrieval


@dataclass(frozen=True)
class SearchResult:
    results: DataFrame
    stats: DataFrame
    rejected: DataFrame
    lexical_error: str | None = None
    lexical: DataFrame | None = None  # the lexical arm's lists


#: Chunk columns that the chain after fusion uses; the text joins last.
LIGHT = ("id", "source_id", "source_path", "doc_type", "fingerprint", "chunk_prev_id", "chunk_next_id", "token_count")


def split_queries(queries: DataFrame, most_chars: int) -> tuple[DataFrame, DataFrame]:
    """Queries that may run, and those rejected: blank, or longer than ``most_chars``."""
    ok = F.coalesce((tx.strip(F.col("query")) != "") & (F.length("query") <= most_chars), F.lit(False))
    return queries.where(ok), queries.where(~ok)


def search(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, index: lexical.LexicalIndex | None,
    where: dict | None = None, config: Retrieval | None = None, compat_where: bool = False, lexical_error: str | None = None,
) -> SearchResult:
    """Search for every query (query_id, query, embedding).

    ``where`` holds for both arms and for neighbours; with ``compat_where`` for
    the dense arm only. Without ``where``, queries that don't ask for a contrast
    get no chunks of the excluded types. The number of queries is not bounded.
    ``vectors`` may have ``doc_type`` beside the vector, as stored collections
    do; else it is joined from the chunks. Without an ``index`` (see
    :func:`lexical.open_index`) the lexical arm is empty and the result says why.
    The lists of both arms and the hits kept of them are written, for several
    steps read them: no arm runs twice.
    """
    c = config or Retrieval()
    good, rejected = split_queries(queries, c.most_query_chars)
    flagged = good.withColumn("exclude", ~tx.contrast_intent(F.col("query")) & F.lit(where is None))
    if "same" in chunks.columns:  # says of two chunks whether their fingerprints agree, and is shorter
        chunks = chunks.drop("fingerprint").withColumnRenamed("same", "fingerprint")
    light = chunks.select(*LIGHT, *[k for k in ("dialect", "register", "license") if k in chunks.columns])
    keep = compile_filter(where)
    bad = F.coalesce(F.col("doc_type").isin(list(c.excluded_types)), F.lit(False))
    if where is None and "doc_type" in vectors.columns:
        corpus = vectors
    else:
        corpus = vectors.drop("doc_type").join(light.where(keep).select(F.col("id").alias("chunk_id"), "doc_type"), "chunk_id")
    near = written(dense.similarity_floor(dense.dense_topk(flagged, corpus, c.dense_k, ~bad, "exclude"), c.similarity_floor), "search-dense")
    words = lexical.no_hits(good) if index is None else written(lexical.bm25_topk(good, index, c.lexical_k, c.k1, c.b), "search-lexical")
    if index is None:
        lexical_error = lexical_error or "no lexical index"
    fused = fusion.fuse(near, words, c.rrf_k)
    hits, _ = fusion.resolve(fused, light)
    hits = hits.join(flagged.select("query_id", "exclude"), "query_id")
    if not compat_where:
        hits = hits.where(keep)
    hits = policy.exclude(hits, c.excluded_types, "exclude")
    hits = policy.cap_per_document(policy.dedup(hits), c.per_document)
    hits = written(policy.top(policy.demote(hits, c.demoted_types), c.final_k), "search-hits")
    if c.neighbors > 0:
        pool = light if compat_where else light.where(keep)
        hits = policy.expand_neighbors(hits.drop("exclude"), pool).join(flagged.select("query_id", "exclude"), "query_id")
        hits = policy.exclude(hits, c.excluded_types, "exclude")
    else:
        hits = hits.withColumn("is_neighbor", F.lit(False))
    hits = policy.trim_budget(hits.drop("exclude"), c.token_budget)
    cols = ("query_id", "position", "chunk_id", "score", "rank", "found_by", "dense_rank", "lexical_rank", "is_neighbor")
    stats = search_stats(flagged, near, words, fused, hits)
    return SearchResult(hits.select(*cols, "spent"), stats, rejected, lexical_error, words)


def search_stats(queries: DataFrame, near: DataFrame, words: DataFrame, fused: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each query that ran, with the size of each list; a query without hits has zeros."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    out = queries.select("query_id", F.col("exclude").alias("negative_excluded"))
    for df, name in ((near, "dense_n"), (words, "lexical_n"), (fused, "fused_n"), (hits.where("NOT is_neighbor"), "ranked_n"), (hits.where("is_neighbor"), "neighbor_n")):
        out = out.join(count(df, name), "query_id", "left")
    return out.fillna(0, ["dense_n", "lexical_n", "fused_n", "ranked_n", "neighbor_n"])
