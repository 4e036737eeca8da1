"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its own bytes says so, hence equal
texts are cut alike wherever they stand. The executors read each text once and
pass on its recipe only: for each chunk a 64-bit key and a SHA-256. Keys are
then verified: all chunks of one key must have one SHA-256, and keys that have
several are split into one identifier each. Texts are equal when their ordered
lists of verified identifiers are equal. Long documents don't move: only recipes
are shuffled, and groups of copies are counted with partial sums before their
rows meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from loomtext.llm.common import forget, materialise, tidied

#: Chunk sizes in bytes. The window of the rolling hash (32) is below the least size.
LEAST, MOST, MASK = 256, 16384, (1 << 11) - 1
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)

RECIPE = StructType(
    [
        StructField("text_sha256", StringType()),
        StructField("n_bytes", LongType()),
        StructField("chunks", ArrayType(StructType([StructField("key", LongType()), StructField("sha", BinaryType())]))),
    ]
)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 32 bytes that end there: the sum of gear[b[i-j]] << j."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            tail = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += tail
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, the last included; none for an empty text."""
    if not len(data):
        return []
    marks = np.flatnonzero((rolling(data) >> np.uint32(12)) & np.uint32(MASK) == 0) + 1 if len(data) > LEAST else np.empty(0, np.int64)
    out, at = [], 0
    for m in [*marks.tolist(), len(data)]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or m == len(data):
            if m > at:
                out.append(m)
            at = m
    return out


def recipe(text: str | None) -> tuple[str, int, list[tuple[int, bytes]]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    ends, at, chunks = cuts(np.frombuffer(raw, np.uint8)), 0, []
    for end in ends:
        part = raw[at:end]
        key = xxhash.xxh64_intdigest(part)
        chunks.append((key - (1 << 64) if key >> 63 else key, hashlib.sha256(part).digest()))
        at = end
    return hashlib.sha256(raw).hexdigest(), len(raw), chunks


def recipes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row: ``id, text_sha256, n_bytes, chunks``."""
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("__text"))
    schema = StructType([f for f in rows.schema.fields if f.name != "__text"] + RECIPE.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [recipe(t) for t in batch.column("__text").to_pylist()]
            other = [n for n in batch.schema.names if n != "__text"]
            offsets = np.cumsum([0] + [len(g[2]) for g in got]).astype(np.int32)
            flat = [c for g in got for c in g[2]]
            parts = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.int64()), pa.array([c[1] for c in flat], pa.binary())], ["key", "sha"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in other], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), parts)],
                names=[*other, "text_sha256", "n_bytes", "chunks"],
            )

    return rows.mapInArrow(tidied(run), schema)


def verified(made: DataFrame) -> DataFrame:
    """``made`` with ``ids`` in place of ``chunks``: per chunk (key, variant), equal only for chunks with one SHA-256.

    Of the SHA-256s of a key, in order, the first is variant 0. Keys with more
    than one are looked for over all chunks; while there are none, which is the
    rule for a 64-bit key, no row needs a lookup.
    """
    distinct = made.select(F.explode("chunks").alias("c")).select("c.key", "c.sha").distinct()
    shared = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min("sha").alias("sha")).where("n > 1").select("key")
    if shared.isEmpty():
        return made.withColumn("ids", F.transform("chunks", lambda c: F.struct(c["key"].alias("key"), F.lit(0).alias("variant")))).drop("chunks")
    few = distinct.join(shared, "key", "left_semi")
    few = few.withColumn("variant", F.row_number().over(Window.partitionBy("key").orderBy("sha")) - 1)
    flat = made.select("row", F.posexplode("chunks").alias("i", "c")).select("row", "i", "c.key", "c.sha")
    named = flat.join(few, ["key", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
    ids = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "key", "variant"))).alias("x"))
    ids = ids.select("row", F.transform("x", lambda c: F.struct(c["key"].alias("key"), c["variant"].alias("variant"))).alias("ids"))
    empty = F.array().cast("array<struct<key:bigint,variant:int>>")
    return made.join(ids, "row", "left").withColumn("ids", F.coalesce("ids", empty)).drop("chunks")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``id, keep_id, group_size, kept, text_sha256, n_bytes``.

    Texts are equal when their bytes are; null counts as empty, so empty and
    null texts are one group. Of a group the largest ``key`` stays; a null key
    is smaller than any. Rows that repeat the largest key: exactly one of them
    stays. Columns besides these two are not read. An empty table gives no rows.
    """
    made = materialise(recipes(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "recipes")
    named = verified(made)
    best = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), F.col("row").alias("row"))
    # Counted with partial sums and written, so that the rows of a large group can be split between tasks in the join.
    groups = materialise(named.groupBy(F.col("ids").alias("g_ids")).agg(F.max(best).alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "copies")
    out = named.join(groups, F.col("ids") == F.col("g_ids"), "left")
    alone = F.col("group_size").isNull()
    out = materialise(
        out.select(
            "id",
            F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
            "text_sha256",
            "n_bytes",
        ),
        "exact",
    )
    forget(made, groups)
    return out


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (order of columns as before). Rules as in :func:`exact_groups`.

    The documents are read twice and don't move: what goes to them is the list
    of texts that have copies, each with the key that stays. Only where that
    list is above ``broadcast_bytes`` is it joined by shuffling. Rows that
    repeat both text and staying key are gathered apart, and one of each stays.
    """
    names = docs.columns
    out = exact_groups(docs, key, text)
    copies = out.where("group_size > 1")
    same = F.count_if(F.col("id").eqNullSafe(F.col("keep_id")))
    shared = materialise(copies.groupBy("text_sha256").agg(F.any_value("keep_id").alias("stays"), same.alias("times")).select(F.unhex("text_sha256").alias("sha"), "stays", "times"), "shared")
    forget(out)
    found = shared.agg(F.count("*").alias("n"), F.max("times").alias("times")).first()
    few = F.broadcast(shared) if found["n"] * 128 <= broadcast_bytes else shared
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    digest = F.unhex(F.sha2(F.coalesce(docs[f"`{text}`"], F.lit("")).cast("binary"), 256))
    marked = docs.select(row.alias("r"), docs[f"`{key}`"].alias("k"), digest.alias("d")).join(few, F.col("d") == F.col("sha"), "left")
    marked = marked.where(F.col("sha").isNull() | F.col("k").eqNullSafe(F.col("stays")))
    columns = [F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]
    if (found["times"] or 1) <= 1:
        return marked.select(*columns)
    once = marked.where(F.col("times") > 1).groupBy("sha").agg(F.any_value("r").alias("r"))
    return marked.where(F.coalesce("times", F.lit(1).cast("bigint")) <= 1).select(*columns).unionByName(once.select(*columns))
