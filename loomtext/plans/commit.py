"""A re-index as one action: backup, vectors, chunks, stale rows, lexical index, counts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators import lifecycle, segments
from loomtext.operators.embed import Embedder, embed
from loomtext.operators.keyed import FEW, KeyedStore
from loomtext.operators.lexical import LexicalIndexError
from loomtext.settings import Settings, check_write

#: Columns that differ from run to run and are no change of a chunk.
VOLATILE = ("ingested_at", "embedding", "ord")


@dataclass(frozen=True)
class Committed:
    written: int
    deleted: int
    collection_count: int
    lexical_count: int
    version: int
    index_path: str
    backup: dict | None
    changed: int = 0
    embedded: int = 0


def corpus_order(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``ord``: by source path, then place in it. Only keys are sorted; the one window without a key has a row for each file."""
    keys = chunks.select("id", F.coalesce("source_path", F.lit("")).alias("p"), "chunk_index")
    sizes = keys.groupBy(F.col("p").alias("q")).agg(F.count("*").alias("n"))
    sizes = sizes.select("q", F.coalesce(F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = keys.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("chunk_index", "id")) - 1)
    placed = own.join(sizes, F.col("p") == F.col("q")).select("id", (F.col("before") + F.col("i")).cast("long").alias("ord"))
    return chunks.drop("ord").join(placed, "id")


def place(row: DataFrame) -> Column:
    """A chunk's place in the corpus as a string that sorts as :func:`corpus_order` counts, and that other chunks don't change."""
    return F.concat(F.coalesce(row["source_path"], F.lit("")), F.lit("\x00"), F.lpad(row["chunk_index"].cast("string"), 12, "0"), F.lit("\x00"), row["id"])


def near(keys: DataFrame) -> DataFrame:
    """Written ``keys``, marked to go to every task if they are few."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def hashed(rows: DataFrame, like: DataFrame) -> tuple[Column, Column]:
    """Digests of the text, and of the columns of ``like`` that make a change."""
    names = [c for c in like.columns if c not in (*VOLATILE, "id")]
    cast = lambda c: rows[c].cast(like.schema[c].dataType) if c in rows.columns else F.lit(None).cast(like.schema[c].dataType)
    return F.sha2(F.coalesce(rows["text"], F.lit("")), 256), F.sha2(F.to_json(F.struct(*[cast(c).alias(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def compared(rows: DataFrame, there: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, __t, __r, __new, __old`` of the staged ``rows`` that are not there as they are: "all" for rows to embed, "some" for rows of which only
    other columns differ; and whether the id was there. Digests meet, not texts."""
    t, r = hashed(there, wanted)
    old = there.select(F.col("id").alias("__id"), t.alias("__ot"), r.alias("__or"))
    kind = F.when(F.col("__ot").isNull() | (F.col("__ot") != F.col("__t")), "all").when(F.col("__or") != F.col("__r"), "some")
    met = rows.select("id", "__t", "__r").join(old, F.col("id") == F.col("__id"), "left")
    return met.select("id", "__t", "__r", kind.alias("__new"), F.col("__id").isNotNull().alias("__old")).where(F.col("__new").isNotNull()).distinct()


def commit(
    store: lifecycle.Store | KeyedStore, wanted: DataFrame, settings: Settings, embedder: Embedder, folder: str, name: str = "chunks",
    delete_stale: bool = False, partial: bool = False, confirm: bool = False,
) -> Committed:
    """Bring the collection ``name`` to what is ``wanted``. Nothing is written unless all gates are open.

    A verified backup comes first if rows will be deleted. ``wanted`` is worked
    out once. Only chunks whose text is new are embedded; those of which other
    columns differ keep their vectors, and those that are there as they are are
    not written. Changed rows go into the collection as one new version that,
    with ``delete_stale``, leaves stale ones out. The lexical index takes a
    segment with what has changed, from what is stored, so that it can't name
    chunks that are gone; texts that stay are not read for it.
    """
    spark = wanted.sparkSession
    check_write(settings, confirm)
    there = store.read(name) if store.exists(name) else None
    staged = f"{folder}/staged-{uuid.uuid4().hex}"
    t, r = hashed(wanted, wanted)
    wanted.withColumns({"__t": t, "__r": r}).write.parquet(staged)
    try:
        rows = spark.read.parquet(staged)
        ids = rows.select("id").distinct()
        if there is None:
            changed = rows.withColumn("__new", F.lit("all"))
        else:
            compared(rows, there, wanted).write.parquet(f"{staged}-kinds")
            kinds = spark.read.parquet(f"{staged}-kinds")
            key = [F.col(c).eqNullSafe(F.col(f"k{c}")) for c in ("id", "__t", "__r")]
            named = near(kinds).select(*[F.col(c).alias(f"k{c}") for c in ("id", "__t", "__r")], "__new")
            changed = rows.join(named, key[0] & key[1] & key[2]).drop("kid", "k__t", "k__r")
        changed = changed.drop("__t", "__r")
        gone = there.join(ids, "id", "left_anti") if there is not None else None
        stale = there.select("id").join(ids, "id", "left_anti").count() if there is not None else 0
        lifecycle.guard(stale, delete_stale, partial)
        deleted = stale if delete_stale else 0
        backup = store.snapshot(name, f"{folder}/backup-{name}-{uuid.uuid4().hex}") if deleted else None
        out_of_index = None
        if there is not None:  # texts as they were, of what is replaced or goes; kept before the store moves on
            away = there.join(near(kinds.where("__new = 'all' AND __old").select("id").distinct()), "id", "left_semi")
            away = away.unionByName(gone, allowMissingColumns=True) if deleted else away
            away.select(F.col("id").alias("chunk_id"), place(away).alias("ord"), "text").write.parquet(f"{staged}-gone")
            out_of_index = spark.read.parquet(f"{staged}-gone")
        embed(changed.where("__new = 'all'").drop("__new"), embedder, settings.dimension).write.parquet(f"{staged}-new")  # the model sees a text once
        new = fresh = spark.read.parquet(f"{staged}-new")
        if there is not None:
            held = there.select(F.col("id").alias("__id"), "embedding")
            some = changed.where("__new = 'some'").drop("__new")
            some.join(held, some["id"] == held["__id"]).drop("__id").write.parquet(f"{staged}-some")
            new = new.unionByName(spark.read.parquet(f"{staged}-some"), allowMissingColumns=True)
            version = store.merge(name, new, gone.select("id") if deleted else ids.limit(0), confirm)
            fresh = lifecycle.upsert(new.limit(0), new).join(fresh.select("id").distinct(), "id", "left_semi")  # of repeated ids the row that is stored
        else:
            version = store.write(name, new, confirm)
        stored = store.read(name, version)
        path = f"{folder}/index-{name}"
        added = fresh
        if there is not None and segments.open_index(spark, path)[0] is None:
            added, out_of_index = stored, None  # a collection that had no index yet
        try:
            texts = added.select(F.col("id").alias("chunk_id"), place(added).alias("ord"), "text")
            indexed = segments.put(spark, path, texts, out_of_index, settings.retrieval.epsilon).content["n"]
        except LexicalIndexError:  # nothing is left
            indexed = 0
        sums = (rows.count(), *changed.agg(F.count("*"), F.count_if(F.col("__new") == "all")).first())
    finally:
        for p in (staged, *(f"{staged}-{x}" for x in ("kinds", "gone", "new", "some"))):
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return Committed(sums[0], deleted, stored.count(), indexed, version, path, backup, sums[1], sums[2])


def vectors_of(stored: DataFrame) -> DataFrame:
    """The vectors of a stored collection, with the type that search filters by beside them."""
    return stored.select(F.col("id").alias("chunk_id"), "embedding", "doc_type")
