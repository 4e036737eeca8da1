"""Embedding texts in batches with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

#: From texts to vectors, in the order of the texts. It runs on the executors and must be picklable.
Embedder = Callable[[list[str]], list[list[float]]]

# Texts in one call of the model.
BATCH = 16


class EmbeddingError(RuntimeError):
    """The model gave another number of vectors, or vectors of another size."""


def checked(vectors: list[list[float]], texts: list[str], dimension: int) -> np.ndarray:
    if len(vectors) != len(texts):
        raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
    if wrong := [len(x) for x in vectors if len(x) != dimension]:
        raise EmbeddingError(f"a vector of size {wrong[0]} in place of {dimension}")
    return np.asarray(vectors, np.float32).reshape(len(texts), dimension)


def embed(rows: DataFrame, embedder: Embedder, dimension: int, text: str = "text", to: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``rows`` with ``to``, the model's vector of the text as it is: not normalised again, for a probe tells whether it is of unit length.

    The model is called for ``batch`` texts at a time, inside each task; null
    texts count as empty. A wrong number or size of vectors is an error.
    """
    schema = StructType([f for f in rows.schema.fields if f.name != to] + [StructField(to, ArrayType(FloatType(), False))])
    rest = [f.name for f in schema.fields if f.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            got = [checked(embedder(part := texts[i : i + batch]), part, dimension) for i in range(0, len(texts), batch)]
            flat = np.concatenate(got).ravel() if got else np.empty(0, np.float32)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))], names=[*rest, to])

    return rows.select(*[rows[f"`{c}`"] for c in rest]).mapInArrow(run, schema)
