"""The grid of exact search and the index of cells, against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import cells, dense


def frames(spark, n=900, asked=60, dim=12, centres=9, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 4
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all vectors are copies
    q = middle[rng.integers(0, centres, asked)] + rng.normal(size=(asked, dim))
    vec = spark.createDataFrame([(f"c{i:04}", v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [("none", None, "a"), ("zero", [0.0] * dim, "a")], "chunk_id string, embedding array<double>, doc_type string")
    qs = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(q)] + [(-1, None, False)], "query_id int, embedding array<double>, exclude boolean")
    return vec.repartition(5), qs


def listed(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "distance", "dense_rank").collect())


@pytest.mark.parametrize(("query_bytes", "corpus_bytes"), [(100, 1 << 20), (2000, 9000)])
def test_grid_equals_scan(spark, query_bytes, corpus_bytes):
    vec, qs = frames(spark, 300, 20)
    ok = F.col("doc_type") == "a"
    for how in ({}, {"admissible": ok}, {"admissible": ok, "when": "exclude"}):
        assert listed(dense.dense_topk(qs, vec, 7, **how, query_bytes=query_bytes, corpus_bytes=corpus_bytes)) == listed(dense.dense_topk(qs, vec, 7, **how))
    assert dense.dense_topk(qs, vec.limit(0), 7, query_bytes=query_bytes).count() == 0


def test_cells(spark, tmp_path):
    vec, qs = frames(spark)
    index = cells.build(vec, f"file://{tmp_path}/i", cells=16, slice_rows=100, sample=500)
    assert index.vectors.count() == 901 and max(index.slices.values()) >= 3
    exact = dense.dense_topk(qs, vec, 10)
    assert listed(cells.ann_topk(qs, index, 10, query_bytes=300)) == listed(exact)
    ok = F.col("doc_type") == "a"
    assert listed(cells.ann_topk(qs, index, 10, ok, "exclude")) == listed(dense.dense_topk(qs, vec, 10, ok, "exclude"))
    tuned = cells.calibrate(qs, index, 0.9, 10)
    got = cells.recall(cells.ann_topk(qs, tuned, 10), exact).first()
    assert tuned.nprobe < len(index.centres) // 2 and got.recall >= 0.9 and got.wanted == 600
    again = cells.load(spark, index.path, 2)
    assert again.nprobe == 2 and np.array_equal(again.centres, index.centres)
    # Only the cells that are probed are read.
    one = qs.where("query_id = 1")
    plan = cells.ann_topk(one, index.probing(1), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "(cell#" in plan
    more = spark.createDataFrame([(f"n{i}", [float(i)] * 12, "a") for i in range(1, 9)], vec.schema)
    grown = cells.add(more, index)
    assert listed(cells.ann_topk(qs, grown, 10)) == listed(dense.dense_topk(qs, vec.unionByName(more), 10))
    h = cells.health(grown, vec.where("embedding is not null").select("chunk_id")).first()
    assert (h.indexed, h.missing, h.orphans) == (909, 0, 8)


def test_cells_of_nothing(spark, tmp_path):
    vec, qs = frames(spark, 30, 3)
    index = cells.build(vec.limit(0), f"file://{tmp_path}/none")
    assert cells.ann_topk(qs, index, 3).count() == 0 and cells.calibrate(qs, index).nprobe == 1
    with pytest.raises(ValueError, match="centres"):
        cells.nearest_cells(vec, np.zeros((1 << 20, 12)), 1)
