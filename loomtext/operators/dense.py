"""The dense arm: exact nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors in a block of queries and in one of the corpus; distances held at a time; a distance (in millionths) that no pair has.
QUERY_BYTES, CORPUS_BYTES, TILE_BYTES, FAR = 16 << 20, 64 << 20, 8 << 20, 1 << 40
#: Blocks a side up to which smaller ones are made: each side of the grid is dealt once for every block of the other.
MOST_BLOCKS = 16


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def probe(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Dimension, norm, and whether the norm is 1 within 0.001."""
    n = norm(F.col(column))
    return vectors.select("*", F.size(column).cast("long").alias("dimension"), n.alias("norm"), (F.abs(n - 1) < 1e-3).alias("is_unit"))


def check_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """``vectors``; reading a row of another dimension is an error."""
    ok = F.assert_true(F.size(column) == dimension, F.lit(f"a vector is not of dimension {dimension}"))
    return vectors.where(ok.isNull())


def dense_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 24, admissible: Column | None = None, when: str | None = None,
    query_bytes: int = QUERY_BYTES, corpus_bytes: int = CORPUS_BYTES,
) -> DataFrame:
    """``query_id, chunk_id, distance, dense_rank`` of the k nearest chunks of each query.

    Vectors of all ``queries`` (query_id, embedding) up to ``query_bytes``, by
    their counted size, go to every task, and each partition of ``vectors``
    (chunk_id, embedding) is read where it lies. More queries never reach the
    driver: queries and corpus are dealt to a grid of blocks, each of a bounded
    size, and every pair of blocks meets in one group. Blocks smaller than
    QUERY_BYTES and CORPUS_BYTES are made up to MOST_BLOCKS a side, so that what
    is dealt grows with the tables, not with their product. The corpus is scanned
    once either way, and only candidates are shuffled for the last ranking.

    Chunks that are not ``admissible`` are no candidates; with ``when``, a column
    of ``queries``, for the queries in which it is true. Ties go by chunk id.
    Distances are rounded to 6 places before they are ranked.
    """
    flag = F.lit(True) if when is None else F.coalesce(F.col(when), F.lit(False))
    # Fresh names, so that queries taken from the corpus itself can meet it.
    rows = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding"), flag.alias("strict")).where(F.col("embedding").isNotNull())
    fits = F.lit(True) if admissible is None else F.coalesce(admissible, F.lit(False))
    corpus = vectors.select(F.col("chunk_id").alias("chunk_id"), F.col("embedding").alias("embedding"), fits.alias("fits")).where(F.col("embedding").isNotNull())
    if when is None:
        corpus = corpus.where("fits")
    size = rows.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0))).first()[0]
    types, schema = candidate_types(rows, corpus)
    if size <= query_bytes:
        table = rows.toArrow() if size else None
        found = corpus.mapInArrow(_scan(table, k, types), schema) if size else _none(rows, corpus)
    else:
        n_rows = corpus.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0))).first()[0]
        q_blocks, c_blocks = blocks(size, query_bytes, QUERY_BYTES), blocks(n_rows, corpus_bytes, CORPUS_BYTES)
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        left = rows.withColumn("__q", block("query_id", q_blocks)).withColumn("__c", every(c_blocks))
        right = corpus.withColumn("__c", block("chunk_id", c_blocks)).withColumn("__q", every(q_blocks))
        found = meet(left, right, ["__q", "__c"], k, types, schema)
    return top(found, k)


def blocks(size: int, asked: int, bound: int) -> int:
    """Blocks of ``asked`` bytes, MOST_BLOCKS at most unless they would be larger than ``bound``."""
    return max(1, min(-(-size // asked), max(MOST_BLOCKS, -(-size // bound))))


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("dense_rank", F.row_number().over(w).cast("long")).where(F.col("dense_rank") <= k)


def candidate_types(queries: DataFrame, corpus: DataFrame) -> tuple[list[pa.DataType], str]:
    """Types of query and chunk ids, and the schema of candidates."""
    kinds = [to_arrow_type(x.schema[c].dataType) for x, c in ((queries, "query_id"), (corpus, "chunk_id"))]
    return kinds, f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(corpus.dtypes)['chunk_id']}, distance double"


def _none(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    return rows.join(corpus.limit(0), F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("distance"))


def meet(left: DataFrame, right: DataFrame, by: list[str], k: int, types: list[pa.DataType], schema: str) -> DataFrame:
    """Candidates of every group of queries and of chunks that agree in ``by``."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return table_of([])
        asked = Asked(queries, k, types[0])
        return table_of(list(asked.candidates(rows.select(["chunk_id", "embedding", "fits"]))))

    def table_of(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts, pa.schema(list(zip(("query_id", "chunk_id", "distance"), (*types, pa.float64()), strict=True))))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def _scan(queries: pa.Table, k: int, types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(queries, k, types[0])
        for batch in batches:
            yield from asked.candidates(pa.Table.from_batches([batch]))

    return run


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column, of length 1."""
    flat = pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), -1)
    return flat / np.maximum(np.sqrt((flat**2).sum(axis=1, keepdims=True)), 1e-300)


class Asked:
    """Queries that meet corpus rows part by part. It remembers the k least distances of each query, so that later parts give fewer candidates."""

    def __init__(self, queries: pa.Table, k: int, kind: pa.DataType) -> None:
        self.ids, self.k = queries.column("query_id").combine_chunks().cast(kind), k
        self.unit, self.strict = unit_rows(queries.column("embedding")), queries.column("strict").to_numpy().astype(bool)
        self.best = np.full((len(self.unit), k), FAR)

    def candidates(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Every row that may be among the k nearest of a query: ordered by millionths of distance, then id."""
        if not rows.num_rows:
            return
        rows = rows.take(pc.sort_indices(rows.column("chunk_id")))
        unit, out = unit_rows(rows.column("embedding")), ~rows.column("fits").to_numpy().astype(bool)
        names, n = rows.column("chunk_id").combine_chunks(), rows.num_rows
        k, step = min(self.k, n), max(1, TILE_BYTES // (8 * n))
        for lo in range(0, len(self.unit), step):
            here = slice(lo, lo + step)
            far = np.rint((1 - self.unit[here] @ unit.T) * 1e6).astype(np.int64)
            far[np.ix_(self.strict[here], out)] = FAR
            near = np.partition(far * n + np.arange(n), k - 1, axis=1)[:, :k]
            distance = near // n
            self.best[here] = np.partition(np.concatenate([self.best[here], distance], axis=1), self.k - 1, axis=1)[:, : self.k]
            q, c = np.nonzero((distance < FAR) & (distance <= self.best[here].max(axis=1)[:, None]))
            if len(q):
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q + lo)), names.take(pa.array(near[q, c] % n)), pa.array(distance[q, c] / 1e6)], names=["query_id", "chunk_id", "distance"])


def similarity_floor(hits: DataFrame, floor: float | None) -> DataFrame:
    """Hits of similarity ``floor`` and more; None keeps all. Ranks stay right, for it cuts a tail off."""
    return hits if floor is None else hits.where(F.lit(1.0) - F.col("distance") >= floor)
