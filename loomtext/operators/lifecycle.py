"""Re-indexing, writing, snapshots, feedback and health."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.dense import norm
from loomtext.settings import Settings, WriteRefused, allowed_collection, check_write

# Limits and verdicts.
MOST_STALE, SHOWN_TO_ADD, MOST_NOTE = 200, 50, 500
VERDICTS = ("useful", "irrelevant", "wrong", "negative_leak")
MOST_DELTAS = 16
CHUNK_ID = re.compile(r"^[a-f0-9]{16}_\d+$")


def diff(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``id, action``: add what is wanted and not there, and call stale what is there and not wanted."""
    w, e = wanted.select("id").distinct(), existing.select("id").distinct()
    add = w.join(e, "id", "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(e.join(w, "id", "left_anti").withColumn("action", F.lit("stale")))


def plan(changes: DataFrame) -> DataFrame:
    """One row: the counts, the first ids to add and the stale ids, up to the limits, with whether the list is complete."""
    def first(action: str, n: int) -> DataFrame:
        rows = changes.where(F.col("action") == action).select("id").orderBy("id").limit(n)
        return rows.agg(F.array_sort(F.collect_list("id")).alias(f"{action}_ids"))

    counts = changes.agg(F.count_if(F.col("action") == "add").alias("n_add"), F.count_if(F.col("action") == "stale").alias("n_stale"))
    out = counts.crossJoin(first("add", SHOWN_TO_ADD)).crossJoin(first("stale", MOST_STALE))  # one row each
    return out.withColumn("stale_complete", F.col("n_stale") <= MOST_STALE)


def guard(n_stale: int, delete_stale: bool, partial: bool) -> None:
    if delete_stale and partial:
        raise WriteRefused("a run over some sources can't delete stale chunks")
    if delete_stale and n_stale > MOST_STALE:
        raise WriteRefused("TOO_MANY_STALE")


def upsert(target: DataFrame, rows: DataFrame, key: str = "id", few: bool = False) -> DataFrame:
    """``target`` with ``rows`` in place of rows of the same key. Of repeated keys in ``rows`` the greatest row counts, by its columns in order (maps aside). ``few`` keys go to every task."""
    names = [c for c in rows.columns if c != key]
    by = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name != key and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]) if names else F.struct(F.lit(1).alias("none"))
    last = rows.groupBy(key).agg(F.max_by(whole, F.struct(*by) if by else F.lit(1)).alias("__r")).select(key, *[F.col(f"__r.c{i}").alias(c) for i, c in enumerate(names)])
    keys = rows.select(key).distinct()
    return target.join(F.broadcast(keys) if few else keys, key, "left_anti").unionByName(last, allowMissingColumns=True)


def delete(target: DataFrame, ids: list[str]) -> DataFrame:
    """``target`` without ``ids``, a hand-given list; an empty list and absent ids are refused."""
    if not ids:
        raise WriteRefused("nothing to delete")
    want = sorted(set(ids))
    there = {r[0] for r in target.where(F.col("id").isin(want)).select("id").distinct().collect()}
    if gone := [i for i in want if i not in there]:
        raise WriteRefused(f"absent ids: {', '.join(gone[:5])}")
    return target.where(~F.col("id").isin(want))


class Store:
    """Collections as versioned Parquet folders: a write makes a new version, then moves the pointer.

    :meth:`delta` adds rows without rewriting the collection; a read takes, of
    each id, the rows of the last write. After MOST_DELTAS deltas the next one
    writes a version that holds all.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str, kind: str = "v") -> list[int]:
        p, fs = self._fs(f"{self.path}/{allowed_collection(self.settings, name)}")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if re.fullmatch(rf"{kind}\d+", n) and fs.exists(self._fs(f"{self.path}/{name}/{n}/_SUCCESS")[0])]
        return sorted(done)

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions(name)
        if not have:
            raise LookupError("COLLECTION_UNAVAILABLE")
        base = self.spark.read.parquet(f"{self.path}/{name}/v{version or have[-1]}")
        deltas = [n for n in self.versions(name, "d") if n > have[-1]] if version is None else []
        if not deltas:
            return base
        rows = base.withColumn("__at", F.lit(0))
        for n in deltas:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/{name}/d{n}").withColumn("__at", F.lit(n)), allowMissingColumns=True)
        last = rows.groupBy("id").agg(F.max("__at").alias("__last"))
        return rows.join(last, "id").where("__at = __last").drop("__at", "__last")

    def create(self, name: str, rows: DataFrame) -> None:
        if self.exists(name):
            raise WriteRefused(f"{name} exists")
        self.write(name, rows)

    def write(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        check_write(self.settings, confirm)
        number = max([0, *self.versions(name), *self.versions(name, "d")]) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/v{number}")
        return number

    def add(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        return self.write(name, upsert(self.read(name), rows) if self.exists(name) else rows, confirm)

    def delta(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        """Rows by id on top of the collection. What was there is neither read nor written."""
        check_write(self.settings, confirm)
        if not self.exists(name):
            return self.write(name, upsert(rows.limit(0), rows), confirm)
        deltas = [n for n in self.versions(name, "d") if n > self.versions(name)[-1]]
        if len(deltas) >= MOST_DELTAS:
            return self.add(name, rows, confirm)
        number = max([*self.versions(name), *deltas]) + 1
        upsert(rows.limit(0), rows).write.mode("overwrite").parquet(f"{self.path}/{name}/d{number}")
        return number

    def remove(self, name: str, ids: list[str], confirm: bool = True) -> int:
        check_write(self.settings, confirm)
        return self.write(name, delete(self.read(name), ids), confirm)

    def merge(self, name: str, rows: DataFrame, gone: DataFrame, confirm: bool = True) -> int:
        """Rows in place of those of the same id, and the ids in ``gone`` left out, as one version."""
        return self.write(name, upsert(self.read(name), rows).join(gone.select("id").distinct(), "id", "left_anti"), confirm)

    def append(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        return self.delta(name, rows, confirm)

    def fetch(self, name: str, ids: list[str]) -> DataFrame:
        return self.read(name).where(F.col("id").isin(ids) if ids else F.lit(False))

    def snapshot(self, name: str, to: str) -> dict:
        return snapshot(self.read(name), to)


def digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest of the rows: sums of the four parts of each row's SHA-256, so that repeated rows count as often as they occur."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    h = F.sha2(text, 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    got = rows.agg(F.count("*"), *parts).first()
    return got[0], ":".join(str(x or 0) for x in got[1:])


def tree(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, sha256`` of every data file under ``path``: the leaves of its hash tree. Files are read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    base = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    name = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), len(base) + 2, 1 << 20)
    return files.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def root(leaves: DataFrame) -> str:
    """The digest of the leaves in order of their names, through folders of 256 by a hash of the name."""
    line = F.concat_ws("\t", "name", F.col("size").cast("string"), "sha256")
    inner = leaves.groupBy(F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(256)).alias("f")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    top = inner.agg(F.sha2(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.col("f").cast("string"), "h"))), "\n"), F.lit("")), 256))  # 256 rows at most
    return top.first()[0]


def snapshot(rows: DataFrame, to: str) -> dict:
    """A copy of ``rows`` with a manifest beside it; raises unless what was written reads back the same."""
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(f"{to}/rows")
    took, made = digest(rows), digest(spark.read.parquet(f"{to}/rows"))
    if took != made:
        raise RuntimeError("BACKUP_FAILED")
    tree(spark, f"{to}/rows").write.parquet(f"{to}/leaves")
    about = {"path": f"{to}/rows", "folder": to, "rows": made[0], "digest": made[1], "root": root(spark.read.parquet(f"{to}/leaves")), "verified": True}
    spark.createDataFrame([(made[0], made[1], about["root"])], "rows long, digest string, root string").coalesce(1).write.json(f"{to}/manifest")
    return about


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """``name, error`` for each file of a snapshot that is missing, added or altered, and for a manifest that doesn't fit its leaves."""
    there, want = tree(spark, f"{path}/rows"), spark.read.parquet(f"{path}/leaves")
    w = want.select("name", F.col("size").alias("s"), F.col("sha256").alias("h"))
    both = there.join(w, "name", "full_outer")
    error = F.when(F.col("h").isNull(), "added").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") != F.col("h")) | (F.col("size") != F.col("s")), "altered")
    found = both.select("name", error.alias("error")).where(F.col("error").isNotNull())
    said = spark.read.json(f"{path}/manifest").first()["root"]
    return found.unionByName(spark.createDataFrame([("manifest", "altered")] if root(want) != said else [], "name string, error string"))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot, once its files are as they were written; raises otherwise."""
    bad = damaged(spark, path).orderBy("name").limit(5).collect()
    if bad:
        raise RuntimeError("BACKUP_FAILED: " + ", ".join(f"{r['name']} {r['error']}" for r in bad))
    return spark.read.parquet(f"{path}/rows")


def feedback(requests: DataFrame, chunks: DataFrame, collection: str = "chunks") -> DataFrame:
    """``requests`` (chunk_id, verdict, note, recorded_at) as feedback rows with ``error`` for those refused."""
    known = chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("__known")).distinct()
    r = requests.join(known, "chunk_id", "left")
    error = (
        F.when(~F.coalesce(F.col("chunk_id").rlike(CHUNK_ID.pattern), F.lit(False)), "INVALID_PARAMS")
        .when(~F.coalesce(F.col("verdict").isin(list(VERDICTS)), F.lit(False)), "INVALID_PARAMS")
        .when(F.length(F.coalesce("note", F.lit(""))) > MOST_NOTE, "TEXT_TOO_LONG")
        .when(F.col("__known").isNull(), "NOT_FOUND")
    )
    ident = F.concat(F.col("chunk_id"), F.lit("@"), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss"))
    body = F.concat(F.col("verdict"), F.lit(": "), F.coalesce("note", F.lit("")))
    return r.select(ident.alias("id"), F.col("chunk_id").alias("about_chunk_id"), "verdict", body.alias("text"), "recorded_at", F.lit(collection).alias("source_collection"), error.alias("error"))


def health(chunks: DataFrame, doc_stats: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: counts, ids that only one side has, wrong dimensions, and the status."""
    c, d = chunks.select("id"), doc_stats.select(F.col("chunk_id").alias("id"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    wrong = vectors.agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") != dimension).alias("wrong_dimension"), F.max(F.abs(norm(F.col("embedding")) - 1)).alias("norm_error"))
    out = one(c, "chunks").crossJoin(one(d, "indexed")).crossJoin(one(c.join(d, "id", "left_anti"), "missing")).crossJoin(one(d.join(c, "id", "left_anti"), "orphans")).crossJoin(wrong)
    status = F.when(F.col("wrong_dimension") > 0, "FAIL").when((F.col("missing") > 0) | (F.col("orphans") > 0), "DEGRADED").when(F.col("chunks") == 0, "NOT_CREATED").otherwise("OK")
    return out.withColumn("status", status)


def inspect(chunks: DataFrame, ids: DataFrame, include_neighbors: bool = True) -> DataFrame:
    """The records of ``ids`` (id), with the records next to them as ``role`` prev and next."""
    base = chunks.join(ids.select("id").distinct(), "id").withColumn("role", F.lit("self"))
    if not include_neighbors:
        return base
    for role, link in (("prev", "chunk_next_id"), ("next", "chunk_prev_id")):
        near = chunks.join(ids.select(F.col("id").alias("__want")).distinct(), F.col(link) == F.col("__want")).drop("__want")
        base = base.unionByName(near.withColumn("role", F.lit(role)))
    return base


def ingest_stats(sources: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """For each source, those without chunks too: chunks, tokens and bytes of vectors."""
    got = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    out = sources.select(F.col("id").alias("source_id")).join(got, "source_id", "left").fillna(0, ["chunks", "tokens"])
    return out.withColumn("vector_bytes", F.col("chunks") * dimension * 4)
