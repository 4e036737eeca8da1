"""Near-duplicates by SimHash, found through distances to pivots.

A fingerprint has a bit set where over half of the text's shingle hashes have
it. Two fingerprints link if at most ``most`` bits differ.

Every fingerprint has a row of Hamming distances to reference fingerprints, the
pivots. Distances to one pivot differ by no more than the fingerprints do, so a
pair whose rows differ by more than ``most`` anywhere is discarded; only the
survivors are compared bit by bit.

So that not all pairs have to be tried, pivots come in families: a random
reference, and the same with one of ``most + 2`` blocks of bits turned over. Half
the difference of the two distances tells how far a fingerprint is from the
reference within the block. At most ``most`` blocks hold differing bits, so a
linked pair has the same distances in at least two blocks: fingerprints meet in
a bucket for each pair of blocks and the distances in these. Large buckets are
cut into tiles, and each pair of tiles is compared on its own. A bucket returns
a spanning forest, not its pairs; components are those of the forests.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import forget, materialise, tidied
from loomtext.llm.near_dup import components

WORDS, SEED, MOST = 3, 42, 3
REFERENCES, TILE, PIECE = 8, 2048, 1 << 20
#: Bytes with A-Z as a-z, and each kind of white space as a space.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def fingerprint(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8; zero without words. A text of fewer than ``words`` words has one shingle, all of them."""
    text, at, tail = raw.translate(FOLDED), 0, []
    sums, n = np.zeros(64, np.int64), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        run = tail + text[at:end].split()
        at = end
        if len(run) >= words:
            got = digests(run, words, seed)
            sums += np.unpackbits(got, axis=1).sum(axis=0, dtype=np.int64)
            n += len(got)
        tail = run[-(words - 1) :] if words > 1 else []
    if not n and tail:
        sums, n = np.unpackbits(digests(tail, len(tail), seed), axis=1).sum(axis=0, dtype=np.int64), 1
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big") if n else 0


def digests(run: list[bytes], words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, eight bytes a row; shingles are slices of the words joined by spaces."""
    joined, sizes = b" ".join(run), np.fromiter(map(len, run), np.int64, len(run))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    of = xxhash.xxh64_digest
    out = b"".join([of(joined[s:e], seed) for s, e in zip(starts[: len(run) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])
    return np.frombuffer(out, np.uint8).reshape(-1, 8)


def fingerprints(docs: DataFrame, key: str, text: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id, print`` of every row; ``print`` holds the 64 bits as a long."""
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t or b"", words, seed) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"])

    return rows.mapInArrow(tidied(run), f"id {dict(rows.dtypes)['id']}, print long")


class Pivots:
    """References and, for each, one more for every block of bits."""

    def __init__(self, most: int = MOST, references: int = REFERENCES) -> None:
        cuts = np.linspace(0, 64, most + 3).round().astype(int)
        self.most, self.widths = most, np.diff(cuts)
        masks = np.array([sum(1 << i for i in range(lo, hi)) for lo, hi in itertools.pairwise(cuts.tolist())], np.uint64)
        refs = np.random.default_rng(5190).integers(0, 1 << 64, references, dtype=np.uint64)
        self.all = np.concatenate([refs, (refs[:, None] ^ masks[None, :]).ravel()])
        self.pairs = list(itertools.combinations(range(len(masks)), 2))

    def distances(self, prints: np.ndarray) -> np.ndarray:
        """The table: a row for each fingerprint, a column for each pivot."""
        return np.bitwise_count(prints[:, None] ^ self.all[None, :]).astype(np.int8)

    def within(self, table: np.ndarray) -> np.ndarray:
        """Distances to each reference (second axis) within each block (third)."""
        k = len(self.widths)
        refs = table.shape[1] // (k + 1)
        whole, turned = table[:, :refs, None].astype(np.int16), table[:, refs:].reshape(len(table), refs, k).astype(np.int16)
        return (whole - turned + self.widths) // 2

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint and pair of blocks a number made of the distances within these."""
        near = self.within(self.distances(prints)).astype(np.uint64)
        base = np.uint64(int(self.widths.max()) + 1)
        code = np.zeros((len(prints), near.shape[2]), np.uint64)
        for t in range(near.shape[1]):  # wraps round for many references, which only makes buckets larger
            code = code * base + near[:, t]
        return np.stack([code[:, a] * np.uint64(0x9E3779B97F4A7C15) + code[:, b] for a, b in self.pairs], axis=1).view(np.int64)


def forest(prints: np.ndarray, group: np.ndarray, pivots: Pivots) -> np.ndarray:
    """For each fingerprint the place of one it is linked to within its group, directly or not: the least of its tree. Groups lie together."""
    n = len(prints)
    table, root = pivots.distances(prints), np.arange(n)
    left, k, few = np.arange(n), 0, min(6, len(pivots.all))
    while True:
        k += 1
        left = left[left + k < n]
        left = left[group[left] == group[left + k]]
        if not len(left):
            return root
        a = left[root[left] != root[left + k]]  # those in one tree already need no comparison
        for part in (slice(0, few), slice(few, None)):
            a = a[(np.abs(table[a, part] - table[a + k, part]) <= pivots.most).all(axis=1)]
        a = a[np.bitwise_count(prints[a] ^ prints[a + k]) <= pivots.most]
        if len(a):
            for x, y in zip(a.tolist(), (a + k).tolist(), strict=True):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
            while not np.array_equal(above := root[root], root):
                root = above


def linked(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """``a, b`` for fingerprints that link within a bucket or pair of tiles; rows of these lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0, 5), np.int64)]
        for b in batches:
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("print", "pair", "bucket", "i", "j")], axis=1))
            rows = np.concatenate(held)
            new = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)) + 1
            if len(new):
                yield edges(rows[: new[-1]])
                held = [rows[new[-1] :]]
            else:
                held = [rows]
        yield edges(np.concatenate(held))

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        prints = np.ascontiguousarray(rows[:, 0])
        group = np.concatenate([[0], np.cumsum((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))]) if len(rows) else np.empty(0, np.int64)
        root = forest(prints.view(np.uint64), group, pivots)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(prints[at]), pa.array(prints[root[at]])], names=["a", "b"])

    return rows.mapInArrow(tidied(run), "a long, b long")


def buckets(prints: DataFrame, pivots: Pivots) -> DataFrame:
    """``print, pair, bucket``: each fingerprint once for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots.pairs)
        for b in batches:
            x = b.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = pivots.keys(x.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), pa.array(keys.ravel())], names=["print", "pair", "bucket"])

    return prints.select("print").mapInArrow(run, "print long, pair int, bucket long")


def links(prints: DataFrame, most: int = MOST, references: int = REFERENCES, tile: int = TILE) -> DataFrame:
    """A forest, as ``a, b``, that joins all distinct ``print``s which links join."""
    pivots = Pivots(most, references)
    placed = materialise(buckets(prints, pivots), "pivot-buckets")
    sizes = placed.groupBy(F.col("pair").alias("p"), F.col("bucket").alias("k")).agg(F.count("*").alias("size")).where("size > 1")
    met = placed.join(sizes, (F.col("pair") == F.col("p")) & (F.col("bucket") == F.col("k")))
    met = met.withColumn("cut", F.ceil(F.col("size") / tile).cast("int")).withColumn("own", F.pmod(F.xxhash64("print"), F.col("cut").cast("long")).cast("int"))
    met = met.select("print", "pair", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("with"))
    met = met.select("print", "pair", "bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    met = met.repartition("pair", "bucket", "i", "j").sortWithinPartitions("pair", "bucket", "i", "j")
    out = materialise(linked(met, pivots), "print-links")
    forget(placed)
    return out


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED, most: int = MOST, references: int = REFERENCES, tile: int = TILE) -> DataFrame:
    """One row per row: ``id, print, component_id``.

    Words are runs of characters that are not ASCII white space, with A-Z as
    a-z; repeated shingles count as often as they occur. ``component_id`` is the
    least key of all rows that links join with this one, directly or not. Null
    texts and texts without words have the fingerprint zero, which links like
    any other. Null keys are rows like others; a component of null keys has a
    null ``component_id``. Other columns are not read; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, key, text, words, seed), "fingerprints")
    nodes = materialise(rows.groupBy("print").agg(F.min("id").alias("least")), "prints")
    found = links(nodes, most, references, tile)
    label = components(found)
    marked = nodes.join(label.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    to = materialise(marked.join(least, "label").select(F.col("print").alias("p"), "component_id"), "print-components")
    forget(nodes, found, label)
    return rows.join(to, F.col("print") == F.col("p")).select("id", "print", "component_id")
