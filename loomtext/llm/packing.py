"""Packing into optimal length buckets.

The histogram of lengths over all documents goes to the driver, one row for each
different length; they are at most the root of twice the number of tokens.
Dynamic programming over it places the bucket boundaries that make the least
padding; the cost is such that best cuts never move back as lengths grow, so
each bucket more costs d log d steps for d lengths. Inside a bucket every
document is padded to the bucket's boundary, and each batch holds as many
documents as the token budget allows.

Documents are numbered inside a bucket in cells: cells are dealt by hash, each
numbers its own rows, and the counts of cells before it give the offset. So no
bucket, however large, meets in one task. There are as many cells as rows and
tokens ask for, so a task's work stays the same as the input grows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialise
from loomtext.llm.shard_shuffle import numbered_before, salted


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the greatest length) with the least padding.

    ``lengths`` ascend; ``counts`` documents with ``sums`` tokens are in each
    bin. A bucket pads all its documents to its greatest length. Of equal
    solutions the one with fewer, then longer first buckets.
    """
    d = len(lengths)
    if not d:
        return []
    c, s = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(sums)])
    cost, back = np.full(d + 1, np.inf), []
    cost[0] = 0.0
    for _ in range(min(buckets, d)):
        new, frm = np.full(d + 1, np.inf), np.zeros(d + 1, int)
        new[0] = 0.0
        todo = [(1, d, 0, d - 1)]  # lengths, and where their best cuts lie
        while todo:
            lo, hi, a, b = todo.pop()
            j = (lo + hi) // 2
            b_j = min(b, j - 1) + 1
            x = cost[a:b_j] + lengths[j - 1] * (c[j] - c[a:b_j]) - (s[j] - s[a:b_j])
            frm[j] = i = int(b_j - 1 - np.argmin(x[::-1]))
            new[j] = x[i - a]
            todo += [t for t in ((lo, j - 1, a, i), (j + 1, hi, i, b)) if t[0] <= t[1]]
        back.append(frm)
        if back and new[d] >= cost[d]:
            back.pop()
            break
        cost = new
    out, j = [], d
    for frm in reversed(back):
        if j:
            out.append(int(lengths[j - 1]))
            j = frm[j]
    return sorted(out)


def pack(docs: DataFrame, length: str, key: str, buckets: int = 16, budget: int = 32768, cell_rows: int = 200_000, cell_tokens: int = 8 << 20, stored: bool = False) -> DataFrame:
    """Every row with ``bucket, boundary, batch, slot, padding`` (input columns of these names are replaced).

    ``batch`` is unique over all buckets as (bucket, batch). A batch holds
    ``budget // boundary`` documents, at least one. ``length`` must not be
    negative; null counts as 0. Rows are ordered inside a bucket by cell, then a
    hash of key and length; repeated keys each get a slot of their own, and
    where a key has more than a quarter of ``cell_rows`` rows these are dealt to
    cells by number. Every ``cell_rows`` rows or ``cell_tokens`` tokens, whichever
    are reached first, make eight cells. An empty table gives no rows. No row is
    left out or cut.

    Keys and lengths are written once, for the histogram and the offsets; the
    rows themselves are read once more, for their places. ``stored`` says that
    reading them again is cheap, as for a projection of a stored table; else
    they are written first.
    """
    made = ("bucket", "boundary", "batch", "slot", "padding")
    names = [c for c in docs.columns if c not in made]
    size = F.coalesce(docs[f"`{length}`"].cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]).alias("__row"), docs[f"`{key}`"].alias("__key"), size.alias("__n"))
    rows = rows if stored else materialise(rows, "lengths")
    often = F.col("n") > max(1, cell_rows // 4)
    hot = not rows.groupBy(F.xxhash64("__key").alias("k")).agg(F.count("*").alias("n")).where(often).limit(1).isEmpty()
    mark = F.xxhash64("__key", F.col("__key").isNull(), F.col("__n"))
    marked = rows.select(mark.alias("mark"), F.struct("__row", "__key", "__n").alias("r"))
    if hot:
        marks = marked.groupBy("mark").agg(F.count("*").alias("n")).where(often)
        marked = salted(marked, marks, small=False)
    else:
        marked = marked.withColumn("salt", F.lit(0).cast("long"))
    flat = marked.select("r.__row", "r.__key", "r.__n", "mark", "salt")
    return number(flat, materialise(flat.select("mark", "salt", "__n"), "marks"), names, buckets, budget, cell_rows, cell_tokens)


def number(rows: DataFrame, light: DataFrame, names: list[str], buckets: int, budget: int, cell_rows: int, cell_tokens: int) -> DataFrame:
    counted = light.groupBy("__n").agg(F.count("*").alias("n"))
    found = counted.orderBy("__n").collect()  # one row a length
    lengths, n = np.array([r["__n"] for r in found], np.int64), np.array([r["n"] for r in found], float)
    bounds = best_boundaries(lengths, n, n * lengths, buckets) or [0]
    cells = 8 * max(1, -(-sum(r["n"] for r in found) // cell_rows), -(-sum(r["n"] * r["__n"] for r in found) // cell_tokens))
    starts = [int(n[lengths <= b].sum()) for b in [-1, *bounds[:-1]]]  # documents in smaller buckets
    index = sum((F.when(F.col("__n") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    cell = F.pmod(F.xxhash64("mark", "salt"), F.lit(cells).cast("long"))

    def place(x: DataFrame) -> DataFrame:
        at = x.select("*", index.alias("bucket"))
        return at.select("*", F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket")).alias("boundary"), (F.col("bucket") * F.lit(cells).cast("long") + cell).alias("__cell"))

    placed = place(rows)
    before = numbered_before(place(light).groupBy(F.col("__cell").alias("bucket")).agg(F.count("*").alias("n")))
    own = Window.partitionBy("__cell").orderBy("mark", "__key", "salt")
    ranked = placed.withColumn("__i", F.row_number().over(own) - 1)
    at = F.col("before") - F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("bucket")) + F.col("__i")
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget).cast("long") / F.greatest(F.col("boundary"), F.lit(1))).cast("long")
    out = ranked.join(before, F.col("__cell") == F.col("b"))
    return out.select(
        *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)],
        "bucket", "boundary", F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"),
        (F.col("boundary") - F.col("__n")).alias("padding"),
    )
