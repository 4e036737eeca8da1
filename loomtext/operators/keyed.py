"""Collections as tables in key buckets, with a commit log.

The key's checksum names the bucket of a row. A version says, for each bucket,
which folders hold it: one with all its rows, then deltas. So a write reads and
rewrites only the buckets of its keys, a fetch reads only those of the ids it
is asked for, and a delta reads nothing. A bucket with many deltas is rewritten
by the next delta that meets it.

Versions are made through :class:`Ledger`. A write whose buckets another writer
changed in between is done again on what is there now; other writes in between
don't matter to it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomtext.operators.lifecycle import MOST_DELTAS, WriteRefused, snapshot, upsert
from loomtext.settings import Settings, allowed_collection, check_write
from loomtext.sources.ledger import Conflict, Ledger

#: Buckets of a new collection.
BUCKETS = 64
#: Keys up to which they go to every task, so that rows they replace are left out where they lie.
FEW = 1_000_000


def bucket(c: Column, buckets: int) -> Column:
    """The bucket of a key; null keys are in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(buckets).cast("long")), F.lit(0)).cast("int")


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


class KeyedStore:
    """``fields`` of a version: ``buckets`` their number, ``schema``, and ``folders``: for each bucket with rows its folders, oldest first."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings, buckets: int = BUCKETS, key: str = "id"):
        self.spark, self.path, self.settings, self.buckets, self.key = spark, path.rstrip("/"), settings, buckets, key

    def ledger(self, name: str) -> Ledger:
        return Ledger(self.spark, f"{self.path}/{allowed_collection(self.settings, name)}")

    def versions(self, name: str) -> list[int]:
        return self.ledger(name).versions()

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _at(self, name: str, version: int | None = None) -> tuple[int, dict]:
        number, content = self.ledger(name).read(version)
        if not number:
            raise LookupError("COLLECTION_UNAVAILABLE")
        return number, content

    # --- reading ---

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(name, self._at(name, version)[1])

    def fetch(self, name: str, ids: list[str]) -> DataFrame:
        """The rows of a hand-given list of ids, from their buckets only."""
        content = self._at(name)[1]
        touched = {bucket_of(i, content["buckets"]) for i in ids}
        return self._rows(name, content, touched).where(F.col(self.key).isin(ids) if ids else F.lit(False))

    def _rows(self, name: str, content: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(content["schema"])
        folders = {int(b): w for b, w in content["folders"].items() if only is None or int(b) in only}
        paths = [f"{self.path}/{name}/data/__w={w}/__b={b}" for b, many in folders.items() for w in many]
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = [f"`{f.name}`" for f in schema.fields]
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("__w", StringType()), StructField("__b", IntegerType())])).option("basePath", f"{self.path}/{name}/data").parquet(*paths)
        if all(len(many) == 1 for many in folders.values()):
            return rows.select(*names)
        # Later folders win; how late a folder is has a row for each folder of each bucket.
        age = self.spark.createDataFrame([(b, w, i) for b, many in folders.items() for i, w in enumerate(many)], "__bb int, __ww string, __at int")
        aged = rows.join(F.broadcast(age), (F.col("__b") == F.col("__bb")) & (F.col("__w") == F.col("__ww")))
        last = aged.groupBy(F.col(self.key).alias("__k")).agg(F.max("__at").alias("__last"))
        return aged.join(last, F.col(self.key).eqNullSafe(F.col("__k"))).where("__at = __last").select(*names)

    # --- writing ---

    def create(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        """A new collection; refused where there is one."""
        check_write(self.settings, confirm)
        written = self._write(name, rows, self.buckets)
        content = self._content(rows.schema, written)
        if self.exists(name) or not self.ledger(name).create(1, content):
            raise WriteRefused(f"{name} exists")
        return 1

    def _content(self, schema: StructType, written: dict[int, str], buckets: int | None = None) -> dict:
        return {"buckets": buckets or self.buckets, "schema": schema.jsonValue(), "folders": {str(b): [w] for b, w in written.items()}}

    def _write(self, name: str, rows: DataFrame, buckets: int) -> dict[int, str]:
        """Write rows by bucket; which buckets there are, and the folder's name."""
        w = uuid.uuid4().hex
        folder = f"{self.path}/{name}/data/__w={w}"
        dealt = rows.withColumn("__b", bucket(F.col(self.key), buckets))
        dealt.repartition("__b").write.partitionBy("__b").parquet(folder)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        made = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
        return {int(n[4:]): w for n in (x.getPath().getName() for x in made) if n.startswith("__b=")}

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        return {r[0] for r in rows.select(bucket(F.col(self.key), buckets).alias("b")).distinct().collect()}  # a row a bucket at most

    def _change(self, name: str, touched: Callable[[dict], set[int]], after: Callable[[DataFrame], DataFrame], schema: StructType | None = None) -> int:
        """Rewrite the touched buckets of the latest version as ``after`` says; again, if another writer changed one of them meanwhile."""
        for _ in range(20):
            _, base = self._at(name)
            mine = touched(base)
            rows = after(self._rows(name, base, mine))
            written = self._write(name, rows, base["buckets"]) if mine else {}
            lost = []

            def change(version: int, now: dict, base=base, mine=mine, rows=rows, written=written, lost=lost) -> dict | None:
                if any(now["folders"].get(str(b)) != base["folders"].get(str(b)) for b in mine):
                    lost.append(version)
                    return None
                kept = {b: w for b, w in now["folders"].items() if int(b) not in mine}
                return now | {"folders": kept | {str(b): [w] for b, w in written.items()}, "schema": _wider(now["schema"], rows.schema)}

            number = self.ledger(name).commit(change)
            if not lost:
                return number
        raise Conflict(f"{name}: others kept changing the same buckets")

    def write(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        """The collection as ``rows``, all of it."""
        check_write(self.settings, confirm)
        written = self._write(name, rows, self.buckets)
        return self.ledger(name).commit(lambda version, now: self._content(rows.schema, written))

    def add(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        """Rows in place of those of the same key; of repeated keys as in :func:`upsert`. Buckets without such keys stay as they are."""
        check_write(self.settings, confirm)
        if not self.exists(name):
            return self.create(name, upsert(rows.limit(0), rows, self.key))
        return self._change(name, lambda base: self._touched(rows, base["buckets"]), lambda there: upsert(there, rows, self.key))

    def merge(self, name: str, rows: DataFrame, gone: DataFrame, confirm: bool = True) -> int:
        """Rows in place of those of the same key, and the keys in ``gone`` left out, as one version."""
        check_write(self.settings, confirm)
        keys = gone.select(F.col(self.key).alias("__gone")).distinct()
        few = rows.select(self.key).count() <= FEW

        def after(there: DataFrame) -> DataFrame:
            return upsert(there, rows, self.key, few).join(keys, F.col(self.key) == F.col("__gone"), "left_anti")

        return self._change(name, lambda base: self._touched(rows.select(self.key).unionByName(gone.select(self.key)), base["buckets"]), after)

    def remove(self, name: str, ids: list[str], confirm: bool = True) -> int:
        """Without a hand-given list of ids, which must be there."""
        check_write(self.settings, confirm)
        if not ids:
            raise WriteRefused("nothing to delete")
        want = sorted(set(ids))
        there = {r[0] for r in self.fetch(name, want).select(self.key).collect()}
        if absent := [i for i in want if i not in there]:
            raise WriteRefused(f"absent ids: {', '.join(absent[:5])}")
        return self._change(name, lambda base: {bucket_of(i, base["buckets"]) for i in want}, lambda rows: rows.where(~F.coalesce(F.col(self.key).isin(want), F.lit(False))))

    def delta(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        """As :meth:`add`, without reading what is there: the rows lie on top of their buckets until these are rewritten."""
        check_write(self.settings, confirm)
        last = upsert(rows.limit(0), rows, self.key)
        if not self.exists(name):
            return self.create(name, last)
        _, base = self._at(name)
        full = {int(b) for b, many in base["folders"].items() if len(many) > MOST_DELTAS}
        if full and full & self._touched(rows, base["buckets"]):
            return self.add(name, rows, confirm)
        written = self._write(name, last, base["buckets"])

        def change(version: int, now: dict) -> dict:
            folders = dict(now["folders"])
            for b, w in written.items():
                folders[str(b)] = [*folders.get(str(b), []), w]
            return now | {"folders": folders, "schema": _wider(now["schema"], last.schema)}

        return self.ledger(name).commit(change)

    def append(self, name: str, rows: DataFrame, confirm: bool = True) -> int:
        """Rows whose keys are new, as by :meth:`delta`; the collection is made if there is none."""
        return self.delta(name, rows, confirm)

    def snapshot(self, name: str, to: str) -> dict:
        return snapshot(self.read(name), to)


def _wider(schema: dict, rows: StructType) -> dict:
    """The schema with the columns that only ``rows`` have."""
    old = StructType.fromJson(schema)
    for f in rows.fields:
        if f.name not in old.names:
            old.add(f)
    return old.jsonValue()
