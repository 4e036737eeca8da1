"""Approximate nearest neighbours: an inverted file of cells.

Centres come from k-means over a bounded sample of the vectors; every vector is
then assigned to the cell of its nearest centre. Cells are stored as partitions
of a table, each in slices of a bounded number of rows, so that no cell, however
many vectors fall in it, meets in one task. A query is compared with the vectors
of its ``nprobe`` nearest cells only, and other cells are not read.

How many cells must be probed for a wanted recall is measured against the exact
neighbours of a sample of queries, not assumed. Probing all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomtext.operators.dense import QUERY_BYTES, candidate_types, dense_topk, meet, norm, top, unit_rows

#: Vectors that k-means sees at most, its rounds, and rows in a slice of a cell.
SAMPLE, ROUNDS, SLICE_ROWS = 100_000, 12, 100_000
#: Centres go to every task, so their size is bounded.
CENTRE_BYTES = 64 << 20


@dataclass(frozen=True)
class Cells:
    vectors: DataFrame  # chunk_id, embedding, other columns, cell, slice
    centres: np.ndarray
    slices: dict[int, int]  # cells that have rows
    path: str
    nprobe: int

    def probing(self, nprobe: int) -> Cells:
        return replace(self, nprobe=nprobe)


def train(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, from ``sample`` vectors at most, the first by a hash of their id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors.where(F.col("embedding").isNotNull()).where(norm(F.col("embedding")) > 0)
    some = some.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    if some.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(featuresCol="v", k=max(2, cells), seed=seed, maxIter=ROUNDS, initMode="random", distanceMeasure="cosine").fit(some)
    found = np.unique(np.array([c for c in model.clusterCenters()]), axis=0)[: max(1, cells)]
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def nearest_cells(rows: DataFrame, centres: np.ndarray, n: int, to: str = "cell") -> DataFrame:
    """``rows``, each once for each of its ``n`` nearest cells, with ``to`` and, if ``n`` is more than 1, their place ``nth`` from 0."""
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"the centres take {centres.nbytes} bytes; at most {CENTRE_BYTES} go to every task")
    n = min(n, len(centres))
    rest = [f for f in rows.schema.fields if f.name not in (to, "nth")]
    schema = StructType([*rest, StructField(to, IntegerType()), StructField("nth", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                unit = unit_rows(pa.chunked_array([part.column("embedding")]))
                far = -(unit @ centres.T) if unit.shape[1] == centres.shape[1] else np.zeros((len(unit), len(centres)))
                order = np.argsort(far, axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(len(unit)), n))
                columns = [part.column(f.name).take(at) for f in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(unit)))], names=schema.names)

    return rows.select(*[f"`{f.name}`" for f in rest]).where(F.col("embedding").isNotNull()).mapInArrow(run, schema)


def build(vectors: DataFrame, path: str, cells: int = 256, sample: int = SAMPLE, slice_rows: int = SLICE_ROWS, seed: int = 7) -> Cells:
    """The index over all of ``vectors`` (chunk_id, embedding, columns to filter by), written under ``path``. It probes all cells until :func:`calibrate` says otherwise.

    Vectors are assigned twice, to count the cells and to write them; the counts have a row for each cell.
    """
    spark = vectors.sparkSession
    centres = train(vectors, cells, sample, seed)
    placed = nearest_cells(vectors, centres, 1).drop("nth")
    sizes = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}
    meta = [(i, c.tolist(), sizes.get(i, 0), -(-sizes.get(i, 0) // slice_rows)) for i, c in enumerate(centres)]
    table = spark.createDataFrame(meta, "cell int, centre array<double>, rows long, slices int")
    cut = table.select(F.col("cell").alias("__cell"), "slices")
    sliced = placed.join(F.broadcast(cut), F.col("cell") == F.col("__cell")).withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices").cast("long")).cast("int")).drop("__cell", "slices")
    sliced.repartition("cell", "slice").write.mode("errorifexists").partitionBy("cell", "slice").parquet(f"{path}/cells")
    table.coalesce(1).write.parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str, nprobe: int | None = None) -> Cells:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one row a cell
    there = {r["cell"]: r["slices"] for r in rows if r["slices"]}
    vectors = spark.read.parquet(f"{path}/cells") if there else spark.createDataFrame([], "chunk_id string, embedding array<double>, cell int, slice int")
    return Cells(vectors, np.array([r["centre"] for r in rows]), there, path, nprobe or len(rows))


def ann_topk(queries: DataFrame, index: Cells, k: int = 24, admissible: Column | None = None, when: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """As :func:`dense_topk`, among the vectors of each query's ``index.nprobe`` nearest cells.

    Queries meet the slices of their cells; those of a cell that more of them
    probe than fit in ``query_bytes`` are cut into blocks.
    """
    flag = F.lit(True) if when is None else F.coalesce(F.col(when), F.lit(False))
    rows = queries.select("query_id", "embedding", flag.alias("strict"))
    probes = nearest_cells(rows, index.centres, index.nprobe).drop("nth")
    asked = {r[0]: r[1] for r in probes.groupBy("cell").count().collect() if r[0] in index.slices}  # a row a cell at most
    fits = F.lit(True) if admissible is None else F.coalesce(admissible, F.lit(False))
    corpus = index.vectors.where(F.col("cell").isin(sorted(asked)) if asked else F.lit(False)).select("chunk_id", "embedding", fits.alias("fits"), "cell", "slice")
    if when is None:
        corpus = corpus.where("fits")
    types, schema = candidate_types(rows, corpus)
    width = 8 * index.centres.shape[1]
    plan = [(c, index.slices[c], -(-n * width // query_bytes)) for c, n in asked.items()]
    grid = F.broadcast(rows.sparkSession.createDataFrame(plan, "__cell int, slices int, blocks int"))  # a row a cell
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = probes.join(grid, F.col("cell") == F.col("__cell")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int"))
    left = left.withColumn("slice", every("slices")).select("query_id", "embedding", "strict", "cell", "slice", "block")
    right = corpus.join(grid, F.col("cell") == F.col("__cell")).withColumn("block", every("blocks")).select("chunk_id", "embedding", "fits", "cell", "slice", "block")
    return top(meet(left, right, ["cell", "slice", "block"], k, types, schema), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``queries``, ``wanted`` exact neighbours, ``found`` among them, and their share."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    out = hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("wanted"))


def calibrate(queries: DataFrame, index: Cells, target: float = 0.95, k: int = 24, sample: int = 500) -> Cells:
    """The index with the fewest probes that find ``target`` of the exact ``k`` neighbours of ``sample`` queries at most (the first by a hash of their id).

    Each exact neighbour lies in one cell; where that cell comes in the query's
    order of cells says how many probes find it, so one pass settles all counts.
    """
    some = queries.select("query_id", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = dense_topk(some, index.vectors.select("chunk_id", "embedding"), k)
    at = nearest_cells(some, index.centres, len(index.centres)).select("query_id", F.col("cell").alias("c"), "nth")
    homes = exact.join(index.vectors.select(F.col("chunk_id").alias("home"), "cell"), F.col("chunk_id") == F.col("home"))
    placed = homes.join(at.withColumnRenamed("query_id", "q"), (F.col("query_id") == F.col("q")) & (F.col("cell") == F.col("c")))
    counts = {r[0]: r[1] for r in placed.groupBy("nth").count().collect()}  # a row a cell
    upto = np.cumsum([counts.get(i, 0) for i in range(len(index.centres))])
    need = int(np.searchsorted(upto, target * upto[-1])) + 1 if len(upto) and upto[-1] else len(index.centres)
    return index.probing(min(need, len(index.centres)))


def add(vectors: DataFrame, index: Cells) -> Cells:
    """The index with more vectors, in the cells of the centres it has. Ids must be new."""
    placed = nearest_cells(vectors, index.centres, 1).drop("nth")
    known = index.vectors.sparkSession.createDataFrame([(i, index.slices.get(i, 1)) for i in range(len(index.centres))], "__cell int, slices int")
    sliced = placed.join(F.broadcast(known), F.col("cell") == F.col("__cell")).withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices").cast("long")).cast("int")).drop("__cell", "slices")
    sliced.repartition("cell", "slice").write.mode("append").partitionBy("cell", "slice").parquet(f"{index.path}/cells")
    spark = index.vectors.sparkSession
    vectors = spark.read.parquet(f"{index.path}/cells")
    there = {r[0]: r[1] for r in vectors.groupBy("cell").agg((F.max("slice") + 1).alias("n")).collect()}
    return Cells(vectors, index.centres, there, index.path, index.nprobe)


def health(index: Cells, chunks: DataFrame) -> DataFrame:
    """One row: indexed vectors, ids that only the index or only ``chunks`` (chunk_id) has, the cells and their largest."""
    have, want = index.vectors.select("chunk_id"), chunks.select("chunk_id")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    sizes = index.vectors.groupBy("cell").count().agg(F.count("*").alias("cells"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))
    return one(have, "indexed").crossJoin(one(want.join(have, "chunk_id", "left_anti"), "missing")).crossJoin(one(have.join(want, "chunk_id", "left_anti"), "orphans")).crossJoin(sizes)
