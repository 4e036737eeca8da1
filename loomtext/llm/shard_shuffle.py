"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly over memory-sized buckets by a seeded
hash of the record. Pass two permutes each bucket with Fisher-Yates: the draw
for step ``i`` is a hash of seed, bucket and ``i`` alone, so neither the number
of tasks nor the order of arrival matters. The permuted records are numbered
through all buckets; record number ``p`` goes to shard ``p % n`` at slot
``p // n``. So shard sizes differ by one row at most, and slots have no gaps.

Which bucket a record falls in follows from hashes, so the buckets are counted
before any text moves, and the records themselves are shuffled once. Equal
records would all fall in one bucket; where there are more than ``bucket_rows /
4`` of them they are numbered (in cells, by input partition) and scattered by
that number too. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import forget, materialise, partitions

#: Bucket numbers are summed up in blocks of so many, so that no task sees all of them.
BLOCK = 4096


def fisher_yates(order: Column, seed: int, bucket: Column) -> Column:
    """``order`` permuted: for m from its size down to 1, element ``xxhash64(seed, bucket, m) mod m`` comes next and the last one takes its place."""
    start = F.struct(order.alias("left"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        left, j = acc["left"], F.pmod(F.xxhash64(F.lit(seed), bucket, m), m.cast("long")).cast("int")
        head, rest = F.slice(left, F.lit(1), j), F.slice(left, j + 2, F.greatest(m - j - 2, F.lit(0)))
        moved = F.concat(head, F.slice(left, m, F.when(j < m - 1, 1).otherwise(0)), rest)
        return F.struct(moved.alias("left"), F.concat(acc["out"], F.array(F.get(left, j))).alias("out"))

    n = F.size(order)
    return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), start, step, lambda acc: acc["out"])


def numbered_before(counts: DataFrame) -> DataFrame:
    """``bucket, before`` (records in smaller buckets) from ``bucket, n``, by sums over blocks of buckets."""
    block = F.floor(F.col("bucket") / BLOCK)
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("block", block)
    own = rows.select("block", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own"))
    blocks = rows.groupBy(F.col("block").alias("b")).agg(F.sum("n").alias("n"))  # one row for BLOCK buckets: few enough for one window
    earlier = blocks.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return own.join(earlier, F.col("block") == F.col("b")).select(F.col("bucket").alias("b"), (F.col("own") + F.col("earlier")).alias("before"))


def salted(rows: DataFrame, hot: DataFrame, small: bool) -> DataFrame:
    """``rows`` (mark, r) with ``salt``: 0, and for marks in ``hot`` the number of the row among those of its mark.

    The rows of hot marks are written with the partition they were in; their
    numbers and the counts both come from that one table. A partition number
    worked out twice need not be the same, for adaptive execution may cut each
    branch of a plan differently, and a lost task may come back elsewhere.
    """
    hot = hot.select(F.col("mark").alias("h"))
    hot = F.broadcast(hot) if small else hot
    light = rows.join(hot, F.col("mark") == F.col("h"), "left_anti").withColumn("salt", F.lit(0).cast("long"))
    many = materialise(rows.join(hot, F.col("mark") == F.col("h"), "left_semi").withColumn("part", F.spark_partition_id()), "hot")
    own = many.withColumn("own", F.row_number().over(Window.partitionBy("mark", "part").orderBy("part")))
    counts = many.groupBy(F.col("mark").alias("m"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("m").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("m", "p", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("upto"))
    numbered = own.join(counts, (F.col("mark") == F.col("m")) & (F.col("part") == F.col("p")))
    out = materialise(light.unionByName(numbered.select("mark", "r", (F.col("own") - 1 + F.col("upto")).alias("salt"))), "salted")
    forget(many)
    return out


def external_shuffle(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 17,
    bucket_bytes: int = 4 << 20, bucket_rows: int = 1024, task_bytes: int = 64 << 20, broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Every row with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot``.

    All columns are kept (input columns of these three names are replaced).
    Null texts count as empty for ``size`` and stay null. Null or repeated keys
    are no matter: rows equal in key and text are interchangeable, and each
    gets its own slot. An empty table gives no rows. The same rows and seed
    give each (key, text) the same shards and slots, whatever the partitions,
    their number or order. A bucket holds ``bucket_bytes`` or ``bucket_rows`` on
    average, whichever is less, and a task gets buckets of ``task_bytes``.
    """
    made = ("size", "shard", "slot")
    names = [f.name for f in docs.schema.fields if f.name not in made]
    k, t = docs[f"`{key}`"], docs[f"`{text}`"]
    size = (F.octet_length(F.coalesce(t, F.lit(""))) + 1).cast("long")
    mark = F.xxhash64(F.lit(seed), k, k.isNull(), t, t.isNull())
    marks = docs.select(mark.alias("mark"), size.alias("size")).groupBy("mark").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    hot = F.col("n") > max(1, bucket_rows // 4)
    found = marks.agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.count_if(hot).alias("hot")).first()
    total, n_rows = found["size"] or 0, found["n"] or 0
    n = max(1, -(-total // bucket_bytes), -(-n_rows // bucket_rows))
    rows = docs.select(mark.alias("mark"), F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)], size.alias("size")).alias("r"))
    bucket = F.pmod(F.when(F.col("salt") == 0, F.col("mark")).otherwise(F.xxhash64("mark", "salt")), F.lit(n).cast("long")).alias("bucket")
    if found["hot"]:
        rows = salted(rows, marks.where(hot), found["hot"] * 16 <= broadcast_bytes)
    else:
        rows = rows.withColumn("salt", F.lit(0).cast("long"))
    before = numbered_before(rows.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")))
    few = n * 16 <= broadcast_bytes  # at most n rows of two longs
    tasks = max(partitions(docs.sparkSession), -(-total // task_bytes))
    scattered = rows.select(bucket, F.struct(F.col("mark").alias("mark"), F.col("r").alias("r")).alias("x"))
    if few:  # buckets are dealt to tasks in turn, which a hash of their number would do unevenly
        scattered, by = scattered.withColumn("task", (F.col("bucket") % tasks).cast("int")).repartitionById(tasks, F.col("task")), ("task", "bucket")
    else:  # by hash, as their offsets are, so that the join moves no record again
        scattered, by = scattered.repartition(tasks, "bucket"), ("bucket",)
    gathered = scattered.groupBy(*by).agg(F.collect_list("x").alias("xs"))
    # Records go by mark first; equal marks are equal records, whose order is no matter.
    sorted_by = F.array_sort(F.transform("xs", lambda x, i: F.struct(x["mark"].alias("mark"), i.alias("i"))))
    ordered = gathered.select("bucket", "xs", F.transform(sorted_by, lambda x: x["i"]).alias("order"))
    dealt = ordered.select("bucket", "xs", fisher_yates(F.col("order"), seed, F.col("bucket")).alias("order"))
    at = F.col("before") + F.col("i")
    placed = dealt.join(F.broadcast(before) if few else before, F.col("bucket") == F.col("b")).select("xs", "before", F.posexplode("order").alias("i", "j"))
    return placed.select(F.get("xs", F.col("j"))["r"].alias("r"), at.alias("at")).select(
        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)],
        F.col("r.size").alias("size"),
        F.pmod(F.col("at"), F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.floor(F.col("at") / shards).cast("long").alias("slot"),
    )
