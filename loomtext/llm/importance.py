"""Importance resampling towards a target, with a dictionary of distinct features.

Features are all runs of up to ``most`` words. Texts are read once: each task
counts features by document, and names each distinct feature once for a block of
documents, so that documents hold numbers and a word is a string once a block,
however often it occurs. The blocks' features are summed up into a dictionary
of the corpus and the target, in which each distinct string is hashed once to
its bucket. Bucket sums give log-ratio gains; the gains go back to the blocks'
features, and from there by number to the documents' counts.

The draw is without replacement, by weight plus Gumbel noise from a hash of the
key. Ranks come from sorted ranges and the counts of ranges before each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import forget, materialise, partitions, tidied

#: A block ends when it has so many distinct features; texts are read in pieces of so many bytes; names come in rows of so many.
BLOCK, PIECE, NAMES = 1 << 18, 1 << 20, 1 << 14
#: Bytes of words, A-Z as a-z; all others as spaces.
FOLDED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTED = "row long, id {id}, block long, words long, n long, codes array<int>, counts array<int>, base int, names array<binary>, totals array<long>"


def pieces(raw: bytes, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Words and features of a text, piece by piece; a feature belongs to the piece with its last word."""
    text, at, tail = raw.translate(FOLDED), 0, []
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        if most == 1:
            yield len(words), words
        else:
            run = tail + words
            yield len(words), [b" ".join(run[i - k + 1 : i + 1]) for k in range(1, most + 1) for i in range(max(len(tail), k - 1), len(run))]
            tail = run[-(most - 1) :]
        at = end
    if not text:
        yield 0, []


def unpacked(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """``row, id`` and the text's bytes, a few rows at a time, so that a batch is not held twice."""
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield from zip(part.column("row").to_pylist(), part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True)


def counted(rows: DataFrame, most: int, block: int) -> DataFrame:
    """From ``row, id, text``: a row for each document's piece (``codes`` and ``counts`` of its features), and rows with the ``names`` of each block's codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        codes: dict[bytes, int] = {}
        totals = np.zeros(1 << 12, np.int64)
        docs: list[tuple] = []
        kind = None

        def emit(named: bool) -> Iterator[pa.RecordBatch]:
            nonlocal codes, totals, number, docs
            if docs:
                sizes = np.array([len(d[4]) for d in docs])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([d[i] for d in docs]).astype(np.int32))) for i in (4, 5)]
                yield table_of([d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], [d[3] for d in docs], *lists, None, None, None)
                docs = []
            if named:
                names = list(codes)
                for lo in range(0, len(names), NAMES):
                    some = totals[lo : min(lo + NAMES, len(names))]
                    yield table_of([None], [None], [None], [None], None, None, [lo], [names[lo : lo + NAMES]], [some])
                codes, totals, number = {}, np.zeros(1 << 12, np.int64), number + 1

        def table_of(row, id_, words, n, c, k, base, names, sums) -> pa.RecordBatch:
            size = len(row)
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(row, pa.int64()), pa.array(id_, kind), pa.array([part + number] * size, pa.int64()), pa.array(words, pa.int64()), pa.array(n, pa.int64()),
                    pa.nulls(size, ints) if c is None else c, pa.nulls(size, ints) if k is None else k, pa.nulls(size, pa.int32()) if base is None else pa.array(base, pa.int32()),
                    pa.nulls(size, pa.list_(pa.binary())) if names is None else pa.array(names, pa.list_(pa.binary())), pa.nulls(size, pa.list_(pa.int64())) if sums is None else pa.array(sums, pa.list_(pa.int64())),
                ],
                names=["row", "id", "block", "words", "n", "codes", "counts", "base", "names", "totals"],
            )

        for b in batches:
            kind = b.schema.field("id").type
            held = 0
            for row, key, raw in unpacked(b):
                for words, features in pieces(raw or b"", most):
                    found = Counter(features)
                    own = np.fromiter((codes.setdefault(f, len(codes)) for f in found), np.int64, len(found))
                    times = np.fromiter(found.values(), np.int64, len(found))
                    if len(codes) > len(totals):
                        totals = np.concatenate([totals, np.zeros(max(len(totals), len(codes) - len(totals)), np.int64)])
                    totals[own] += times
                    docs.append((row, key, words, len(features), own, times))
                    held += len(found)
                    if len(codes) >= block:
                        yield from emit(True)
                        held = 0
                    elif held > 1 << 18:
                        yield from emit(False)
                        held = 0
            yield from emit(False)
        yield from emit(True)

    return rows.mapInArrow(tidied(run), COUNTED.format(id=dict(rows.dtypes)["id"]))


def named(parts: DataFrame) -> DataFrame:
    """``block, code, feature, n`` of every block."""
    rows = parts.where(F.col("names").isNotNull()).select("block", "base", F.posexplode(F.arrays_zip("names", "totals")).alias("i", "x"))
    return rows.select("block", (F.col("base") + F.col("i")).alias("code"), F.col("x.names").alias("feature"), F.col("x.totals").alias("n"))


def dictionary(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``feature, bucket, s, t``: each distinct feature with its bucket (checksum of its bytes, modulo ``buckets``) and its counts in corpus and target."""
    none = F.lit(0).cast("long")
    both = named(corpus).select("feature", F.col("n").alias("s"), none.alias("t")).unionByName(named(target).select("feature", none.alias("s"), F.col("n").alias("t")))
    sums = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return sums.select("feature", (F.crc32("feature") % buckets).cast("int").alias("bucket"), "s", "t")


def gains(words: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain``: thousandths of the log ratio of smoothed shares in target and corpus, rounded down; at most ``buckets`` rows."""
    sums = words.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return sums.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("int").alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, key: str, text: str, most: int = 1, buckets: int = 10_000, block: int = BLOCK, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``row, id, words, n, weight`` of every row of ``docs``, which has a number in ``__row``."""
    parts = docs.select(F.col("__row").alias("row"), docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    parts = materialise(counted(parts, most, block), "feature-counts")
    wanted = target.select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = materialise(counted(wanted, most, block), "target-counts")
    words = materialise(dictionary(parts, wanted, buckets), "dictionary")
    gain = gains(words, buckets)
    gain = F.broadcast(gain) if buckets * 16 <= broadcast_bytes else gain
    known = words.join(gain, "bucket").select(F.col("feature").alias("f"), "gain")
    back = named(parts).join(known, F.col("feature") == F.col("f"))
    back = back.groupBy(F.col("block").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "gain"))), lambda x: x["gain"]).alias("gains"))
    rows = parts.where(F.col("row").isNotNull()).select("row", "id", "block", "words", "n", "codes", "counts").join(back, F.col("block") == F.col("b"), "left")
    worth = F.zip_with("codes", "counts", lambda c, k: F.get("gains", c).cast("long") * k)
    weight = F.coalesce(F.aggregate(worth, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    out = rows.select("row", "id", "words", "n", weight.alias("weight")).groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in ("words", "n", "weight")])
    out = materialise(out, "weights")
    forget(parts, wanted, words)
    return out


def importance(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1, buckets: int = 10_000,
    seed: int = 2024, least_words: int = 20, percent: int = 10, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_features, weight, score, rank``.

    Of the N rows with ``least_words`` words and more, floor(``percent`` * N /
    100) are drawn by the highest scores, ties to the smaller key (null keys
    last, equal keys in some order); ``rank`` counts them from 1 and is null
    for the others. Null texts count as empty: no features, weight 0. Equal
    keys have equal noise; a null key has that of an empty name. ``target`` is
    a table with a column ``text`` too. Other columns are not read. An empty
    table gives no rows, an empty target smoothed zeros.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return ranked(weighted(numbered, target, key, text, most, buckets, block), seed, least_words, percent).select(
        F.col("id").alias(key), F.col("n").alias("n_features"), "weight", "score", "rank"
    )


def ranked(weights: DataFrame, seed: int, least_words: int, percent: int) -> DataFrame:
    """``weights`` with ``score`` and ``rank``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")
    scored = materialise(weights.withColumn("score", F.col("weight") + noise), "scores")
    fit = scored.where(F.col("words") >= least_words)
    draw = percent * fit.count() // 100
    by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    placed = fit.repartitionByRange(partitions(fit.sparkSession), *by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    placed = materialise(placed, "placed")
    # A number in a sorted range counts on from the ranges before; there is a row for each range.
    sizes = placed.groupBy(F.shiftright("pos", 33).alias("range")).agg(F.count("*").alias("size"))
    sizes = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1
    first = placed.join(F.broadcast(sizes), F.shiftright("pos", 33) == F.col("range")).select(*scored.columns, F.when(at <= draw, at).alias("rank"))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 2024, least_words: int = 20, percent: int = 10, **how: int) -> DataFrame:
    """The rows of ``docs`` that :func:`importance` draws, with their columns as they are."""
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    drawn = ranked(weighted(numbered, target, key, text, **how), seed, least_words, percent).where("rank is not null").select("row")
    return numbered.join(drawn, F.col("__row") == F.col("row"), "left_semi").select(*docs.columns)
