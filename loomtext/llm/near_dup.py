"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed five-word shingles. Texts with equal sets are one
class from the start. In each run all sets are split by a shared token: a set
goes to the bucket named by its MinHash under the run's hash function, so two
sets meet with a probability equal to their similarity. Buckets above ``limit``
are split again, each along PICKS tokens chosen by hash functions that the
bucket itself picks; a bucket that hardly gets smaller is made of similar sets
and is left whole. Runs are repeated until a pair at the threshold has met with
the target recall, all splits on its way counted.

Buckets are then compared by brute force on the true sets. Large buckets are
cut into blocks of bounded rows and shingles, and each pair of blocks is a
group's work, so no bucket meets in one task. A pair that meets in several buckets counts in the first only, so
links are counted once. A bucket returns sums and a spanning forest, never its
pairs. Components come from contracting the forests, round by round, on the
cluster.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.bytehash import mixed, prefix_sums, substring_hashes
from loomtext.llm.common import forget, materialise, tidied

WORDS = 5
SIMILAR, RECALL = 0.8, 0.99999
LIMIT, BLOCK, DEPTH = 200, 1024, 4
#: Shingles in a block: a task holds those of two blocks.
SHINGLES = 2 << 20
#: Hash functions for splits, of which a bucket picks some (the number is prime, so that picks differ).
SPLITS, PICKS = 23, 3

_rng = np.random.default_rng(5190)
PLACES = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Texts are hashed in pieces of so many bytes at most, cut at white space.
PIECE = 1 << 21


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word (run of bytes that are not ASCII white space)."""
    if len(raw) > PIECE:
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            while end < len(raw) and not SPACES[raw[end]]:
                end += 1
            out.append(word_hashes_of(raw[at:end]))
            at = end
        return np.concatenate(out)
    return word_hashes_of(raw)


def word_hashes_of(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACES[data], [True]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    return substring_hashes(prefix_sums(data), starts, ends)


def shingles(raw: bytes) -> np.ndarray:
    """The sorted set of hashed shingles: five words in a row; of a text with one to four words, all of them; of none, nothing."""
    w = word_hashes(raw)
    if len(w) >= WORDS:
        n = len(w) - WORDS + 1
        h = w[:n] * PLACES[0]
        for i in range(1, WORDS):
            h = h + w[i : i + n] * PLACES[i]
    elif len(w):
        h = (w * PLACES[: len(w)]).sum(dtype=np.uint64, keepdims=True) + PLACES[WORDS : WORDS + 1] * np.uint64(len(w))
    else:
        return w
    return np.unique(mixed(h))


def sketch(docs: DataFrame, key: str, text: str, keep: list[str], runs: int) -> DataFrame:
    """``id, c0.. (kept columns), digest, n, sig, z``: digest and size of the shingle set, its MinHashes for runs and splits, the packed text."""
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("__text"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, factors = zstandard.ZstdCompressor(level=1), hash_factors(runs + SPLITS)
        for batch in batches:
            digest, n, sig, z = [], [], [], []
            for t in batch.column("__text").to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                s = shingles(raw)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minimum(s, factors).view(np.int64) if len(s) else None)
                z.append(None if t is None else pack.compress(raw))
            other = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in other], pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.list_(pa.int64())), pa.array(z, pa.binary())],
                names=[*other, "digest", "n", "sig", "z"],
            )

    return rows.mapInArrow(tidied(run), ", ".join([*fields, "digest binary, n int, sig array<bigint>, z binary"]))


def hash_factors(n: int) -> np.ndarray:
    """Odd factors of ``n`` hash functions."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def minimum(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[None, at : at + 4096] * factors[:, None]).min(axis=1))
    return out


def runs_for(recall: float, similar: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with this recall, even if its buckets are split every time.

    It meets in a run if its sets agree in the run's hash and, at each of
    ``depth - 1`` splits, in one of PICKS hashes at least.
    """
    met = similar * (1 - (1 - similar) ** PICKS) ** (depth - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else 1


def buckets(reps: DataFrame, runs: int, limit: int, depth: int) -> DataFrame:
    """``leaf, rep, size``: the buckets of two and more sets in which splitting ends."""
    level = reps.select("rep", F.posexplode(F.slice("sig", 1, runs)).alias("run", "v")).select("rep", F.xxhash64("run", "v").alias("leaf"), F.lit(None).cast("bigint").alias("above"))
    done: list[tuple[DataFrame, Column]] = []
    for d in range(depth):
        # Sizes are written before they are joined, so that a large bucket's rows can be split between tasks.
        sizes = materialise(level.groupBy(F.col("leaf").alias("l")).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        sized = materialise(level.join(sizes, F.col("leaf") == F.col("l")).select("leaf", "rep", "size", "above"), "level")
        forget(sizes, level)
        whole = (F.col("size") <= limit) | F.coalesce(2 * F.col("size") >= F.col("above"), F.lit(False))
        if d == depth - 1:
            whole = F.lit(True)
        done.append((sized, whole))
        wide = sized.where(~whole)
        if wide.isEmpty():
            break
        first, stride = (F.pmod(F.xxhash64("leaf", F.lit(f"split {i}")), F.lit(SPLITS - i).cast("bigint")) + i for i in (0, 1))
        pick = lambda j: (F.lit(runs) + F.pmod(first + j * stride, F.lit(SPLITS).cast("bigint"))).cast("int")  # noqa: B023, E731
        child = lambda j: F.xxhash64("leaf", pick(j), F.get("sig", pick(j)))  # noqa: B023, E731
        split = wide.join(reps.select("rep", "sig"), "rep")
        level = materialise(split.select("rep", F.explode(F.array(*[child(j) for j in range(PICKS)])).alias("leaf"), F.col("size").alias("above")), "split")
    out = [x.where(whole).select("leaf", "rep", "size") for x, whole in done]
    leaves = materialise(functools.reduce(DataFrame.unionByName, out), "leaves")
    forget(*[x for x, _ in done])
    return leaves


def compare(sets: list[np.ndarray], other: list[np.ndarray] | None, unseen: np.ndarray, similar: float) -> np.ndarray:
    """Which pairs of ``sets`` with ``other`` (or with themselves) that are marked in ``unseen`` are similar."""
    both = sets if other is None else sets + other
    rows = np.flatnonzero(unseen.any(axis=1))
    link = np.zeros(unseen.shape, bool)
    if not len(rows):
        return link
    sizes = np.array([len(s) for s in both], np.int64)
    owner = np.repeat(np.arange(len(both), dtype=np.int32), sizes)
    flat = np.concatenate(both)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    group, owner = group[several], owner[several]
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group
    m = len(sets)
    inter = np.zeros((len(rows), unseen.shape[1]), np.float32)
    wide = int(group[-1]) + 1 if len(group) else 0
    step = 4096
    for at in range(0, wide, step):
        lo, hi = np.searchsorted(group, [at, at + step])
        x = np.zeros((len(both), min(step, wide - at)), np.float32)
        x[owner[lo:hi], group[lo:hi] - at] = 1
        inter += x[rows] @ (x if other is None else x[m:]).T
    left, right = sizes[rows][:, None], (sizes if other is None else sizes[m:])[None, :]
    link[rows] = (inter >= similar * (left + right - inter) - 1e-6) & unseen[rows]
    return link


def met_before(leaf: int, a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs share a bucket whose number is below this one's."""
    seen = np.zeros((len(a), len(a if b is None else b)), bool)
    where: dict[int, tuple[list[int], list[int]]] = {}
    for side, rows in ((0, a), (1, a if b is None else b)):
        for i, leaves in enumerate(rows):
            for v in leaves:
                if v >= leaf:
                    break
                where.setdefault(int(v), ([], []))[side].append(i)
    for i, j in where.values():
        if i and j:
            seen[np.ix_(i, j)] = True
    return seen


def roots(link: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least number in its component."""
    label = rep.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(link, label[None, :], top).min(axis=1))
        if (new == label).all():
            return label
        label = new


def links_of(leaf: int, rep: np.ndarray, weight: np.ndarray, side: np.ndarray, hist: list[np.ndarray], sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a bucket (or of a pair of blocks) its links in documents, and an edge's other end."""
    n = len(rep)
    cross = (side == 1).any() and (side == 0).any()
    if cross:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        unseen = ~met_before(leaf, [hist[i] for i in a], [hist[i] for i in b])
        part = compare([sets[i] for i in a], [sets[i] for i in b], unseen, similar)
        link = np.zeros((n, n), bool)
        link[np.ix_(a, b)] = part
        link[np.ix_(b, a)] = part.T
    else:
        unseen = ~met_before(leaf, hist, None)
        np.fill_diagonal(unseen, False)
        link = compare(sets, None, unseen, similar)
        link |= link.T
    if not link.any():
        return np.zeros(n, np.int64), rep
    return link @ weight, roots(link, rep)


def verify(rows: DataFrame, similar: float) -> DataFrame:
    """``rep, links, root`` for the members of buckets that have links. ``rows`` lie together by (leaf, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        cache: dict[int, np.ndarray] = {}
        cached = 0

        def done(key: tuple, held: list[tuple]) -> list[tuple[int, int, int]]:
            if len(held) < 2 or (key[1] != key[2] and len({h[2] for h in held}) < 2):  # pairs within one block meet in its own group
                return []
            rep = np.array([h[0] for h in held], np.int64)
            links, root = links_of(key[0], rep, np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held]), [h[3] for h in held], [h[4] for h in held], similar)
            return [(int(r), int(n), int(t)) for r, n, t in zip(rep, links, root, strict=True) if n]

        last, held, out = None, [], []
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            flat, offsets = cols["hist"].values.to_numpy(zero_copy_only=False), cols["hist"].offsets.to_numpy()
            keys = zip(cols["leaf"].to_pylist(), cols["i"].to_pylist(), cols["j"].to_pylist(), strict=True)
            reps, weights, sides = (cols[c].to_pylist() for c in ("rep", "weight", "side"))
            for r, key in enumerate(keys):
                if key != last:
                    out += done(last, held) if held else []
                    last, held = key, []
                if reps[r] not in cache:
                    if cached > SHINGLES:
                        cache.clear()
                        cached = 0
                    cache[reps[r]] = shingles(unpack.decompress(cols["z"][r].as_py()))
                    cached += len(cache[reps[r]])
                held.append((reps[r], weights[r], sides[r], flat[offsets[r] : offsets[r + 1]], cache[reps[r]]))
            if len(out) > 50_000:
                yield table_of(out)
                out = []
        out += done(last, held) if held else []
        yield table_of(out)

    def table_of(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["rep", "links", "root"])

    return rows.mapInArrow(tidied(run), "rep bigint, links bigint, root bigint")


def components(edges: DataFrame, by_number: int = 2) -> DataFrame:
    """``node, label``: the least node of each component, for every node in ``edges`` (a, b).

    Each round every node goes to the first of itself and the nodes next to it,
    and the graph is contracted, until no edge is left. The first rounds go by
    number, which settles forests that already point to least nodes; the others
    by a hash that is new in each round, which takes away a share of the nodes
    whatever their numbers, so rounds grow with the logarithm of the nodes.
    """
    maps: list[DataFrame] = []
    written: list[DataFrame] = []
    both = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    turn = 0
    while not both.isEmpty():
        first = (lambda c: F.struct(F.col(c).alias("node"))) if turn < by_number else (lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("at"), F.col(c).alias("node")))  # noqa: B023, E731
        ends = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("near"))
        to = materialise(best.select("node", F.least(first("node"), "near")["node"].alias("label")), "labels")
        maps.append(to)
        written.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("label").alias("la")), to.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = both.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        left = materialise(moved, "edges")
        forget(both)
        both, turn = left, turn + 1
    if not maps:
        forget(both)
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    out = maps.pop()
    while maps:  # from the last, smallest map to the first; written now and then, so that the plan stays small
        to = maps.pop()
        nxt = out.select(F.col("node").alias("label"), F.col("label").alias("after"))
        out = to.join(nxt, "label", "left").select("node", F.coalesce("after", "label").alias("label"))
        if len(maps) % 8 == 7:
            out = materialise(out, "labels")
            written.append(out)
    if turn > by_number:
        least = out.groupBy("label").agg(F.min("node").alias("least"))
        out = out.join(least, "label").select("node", F.least("least", "label").alias("label"))
    result = materialise(out, "labels")
    forget(both, *written)
    return result


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row: ``id, class_id, n_links, group_size``. ``how`` goes to :func:`groups`.

    ``class_id`` is the least key of the rows that links join, directly or not;
    ``n_links`` counts the other rows whose set has Jaccard similarity
    ``similar`` or more with this one's, copies included. Words are runs of
    characters that are not ASCII white space, letters as they are. Texts with
    one to four words have one shingle, all of them. Null texts and texts
    without words have no shingles, no links and are classes of their own.
    Repeated rows are linked like other copies; null keys count as rows, and a
    class of null keys has a null class_id. Columns besides these two are not
    read. An empty table gives no rows.
    """
    made = sketched(docs, key, text, [], **how)
    out = groups(made, **how).drop("row", "label")
    forget(made)
    return out


def sketched(docs: DataFrame, key: str, text: str, keep: list[str], similar: float = SIMILAR, recall: float = RECALL, depth: int = DEPTH, **_: int) -> DataFrame:
    """The written :func:`sketch` of ``docs`` with a number for each ``row``."""
    return materialise(sketch(docs, key, text, keep, runs_for(recall, similar, depth)).withColumn("row", F.monotonically_increasing_id()), "sketch")


def groups(made: DataFrame, similar: float = SIMILAR, recall: float = RECALL, limit: int = LIMIT, block: int = BLOCK, depth: int = DEPTH, shingle_block: int = SHINGLES) -> DataFrame:
    """``id, row, label, class_id, n_links, group_size`` for the rows of a written :func:`sketch` with numbers ``row``.

    ``label`` is the number of a row of the class, the same for all of its rows; unlike ``class_id`` no other class has it.
    """
    full = made.where("n > 0")
    reps = full.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("weight"), F.min("id").alias("least"))
    reps = materialise(reps.join(full.select("row", "sig", "n"), F.col("rep") == F.col("row")).drop("row"), "reps")
    leaves = buckets(reps, runs_for(recall, similar, depth), limit, depth)
    hist = leaves.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("hist"))
    members = materialise(leaves.join(hist, "rep").join(reps.select("rep", "weight", "n"), "rep"), "members")
    # A bucket whose members all met before in one other bucket has nothing new.
    earlier = members.select("leaf", "size", F.explode_outer(F.filter("hist", lambda u: u < F.col("leaf"))).alias("u")).where("u is not null")
    useless = materialise(earlier.groupBy("leaf", "u").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n = size").select("leaf").distinct(), "useless")
    work = members.join(useless, "leaf", "left_anti")
    # Blocks follow rows and shingles, so that a few long texts don't make a block that is too large to hold.
    large = work.groupBy(F.col("leaf").alias("l")).agg(F.sum("n").alias("all")).where(F.col("all") > shingle_block)
    work = work.join(large, F.col("leaf") == F.col("l"), "left")
    work = work.withColumn("cut", F.greatest(F.ceil(F.col("size") / block), F.ceil(F.coalesce("all", F.lit(0)) / shingle_block)).cast("int"))
    work = work.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cut").cast("bigint")).cast("int"))
    work = work.select("leaf", "rep", "weight", "hist", "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("with"))
    i, j = F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")
    work = work.select("leaf", "rep", "weight", "hist", i, j, (F.col("own") > F.col("with")).cast("int").alias("side"))
    work = work.join(full.select(F.col("row").alias("rep"), "z"), "rep").repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    found = materialise(verify(work, similar), "links")
    forget(leaves, members, useless)
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    marked = reps.drop("sig", "n").join(degree, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    marked = marked.withColumn("label", F.coalesce("label", "rep"))
    least = marked.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("weight").alias("group_size"))
    links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    marked = materialise(marked.join(least, "label").select(F.col("digest").alias("d"), "label", "class_id", "group_size", links), "classes")
    forget(reps, found, label)
    some = full.select("id", "row", "digest").join(marked, F.col("digest") == F.col("d")).select("id", "row", "label", "class_id", "n_links", "group_size")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    none = made.where("n = 0").select("id", "row", F.col("row").alias("label"), F.col("id").alias("class_id"), zero.alias("n_links"), one.alias("group_size"))
    out = materialise(some.unionByName(none), "groups")
    forget(marked)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = 8 << 20, **how) -> DataFrame:
    """One row of each class of :func:`near_groups`, with its columns as they are: that of the least key (of equal keys, one of them).

    The texts are held compressed. Where the list of rows that go is within
    ``broadcast_bytes`` it goes to every executor and the texts don't move;
    else they move once.
    """
    names = docs.columns
    other = [n for n in names if n != text]
    made = sketched(docs, key, text, other, **how)
    every = groups(made, **how)
    out = every.where("group_size > 1")
    stay = out.where("id <=> class_id").groupBy("label").agg(F.min("row").alias("stay")).select("stay")
    gone = materialise(out.join(stay, F.col("row") == F.col("stay"), "left_anti").select(F.col("row").alias("gone")), "gone")
    forget(every)
    few = F.broadcast(gone) if gone.count() * 32 <= broadcast_bytes else gone
    kept = made.select("row", "z", *[f"c{i}" for i in range(len(other))]).join(few, F.col("row") == F.col("gone"), "left_anti")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [None if z is None else unpack.decompress(z).decode("utf-8", "replace") for z in batch.column("z").to_pylist()]
            columns = {n: batch.column(f"c{i}") for i, n in enumerate(other)} | {text: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return kept.mapInArrow(tidied(run), schema)
