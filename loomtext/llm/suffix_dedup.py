"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A string of ``L`` bytes counts as repeated in a document if it also starts in
a document with a smaller id. Of the suffixes only a sample is indexed: of the
``L - K + 1`` strings of ``K`` bytes inside a window of ``L`` bytes the one
with the least hash is the window's anchor, so equal windows have equal
anchors, and each anchor stands for a run of neighbouring windows. An entry of
the index is such a run: the suffix from the anchor on, as far as its windows
reach (at most ``L`` bytes), and the bytes before the anchor, read backwards
(at most ``L - K``).

Three steps, each a shuffle:

1. Sift. Starts (hashes of the first ``K`` bytes) are dealt to ranges. A suffix
   whose start occurs once in all documents can't match and goes no further.
2. Index. Each range holds a family of suffix arrays (levels) in byte order.
   A batch of entries is sorted and merge-scanned against all levels: of equal
   entries the least document covers the others, and for entries with a common
   prefix of ``K`` bytes and more the lengths of common prefixes, forward and
   backward, say which windows they share. What is new becomes a level; levels
   of equal size are merged, so that an entry is merged a logarithmic number of
   times. Hashes only propose; bytes decide.
3. Finish. Each pack of documents gets the windows that are covered.

A start that more than ``HOT`` entries share would be one task's work. Its
windows are taken one by one instead and grouped by their ``L`` bytes, which
spreads them; equal ones are counted with partial sums.

:class:`SuffixIndex` keeps packs and levels, in a folder if one is given, and
batches that are added later are scanned against the levels there. :func:`remove_repeats` is an
index of one batch.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.bytehash import BYTES, mixed, powers, prefix_sums, substring_hashes
from loomtext.llm.common import forget, materialise, tidied, with_cleanup
from loomtext.sources.ledger import Ledger

L, K = 50, 20
BEFORE = L - K
#: Text bytes of a pack; long texts are hashed in pieces of so many windows.
PACK, PIECE = 800_000, 1 << 21
#: Entries in a batch of the index, and for one range of it.
BATCH, RANGE = 1 << 15, 1 << 17
#: Text bytes whose starts make up one range of the sift.
SIFT_BYTES = 16 << 20
#: Anchors that a task holds before it deals them to the ranges.
FLUSH = 1 << 18
#: Entries with the same start above which windows are compared one by one: half of what a task's range holds on average.
HOT = RANGE // 2
#: Tasks of a shuffle; beyond, a task gets several ranges, one after the other.
TASKS = 20_000
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
NULL_ID = np.iinfo(np.int64).min


# --- packs and anchors --------------------------------------------------------------------------


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the documents laid end to end in ``data``: first and last window of each anchor, its place, its start's hash, its span's hash."""
    out = [_anchors(data, ends, at, min(at + PIECE, len(data) - L + 1)) for at in range(0, max(0, len(data) - L + 1), PIECE)]
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(data: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    part = data[lo : hi + L - 1]
    sums = prefix_sums(part)
    at = np.arange(len(part) - K + 1)
    grams = substring_hashes(sums, at, at + K)
    v = (grams & HIGH) | at.astype(np.uint64)
    width, have = L - K + 1, 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    inside = np.ones(hi - lo, bool)
    for end in ends[np.searchsorted(ends, lo, "right") :]:
        if end - L + 1 >= hi:
            break
        inside[max(0, end - L + 1 - lo) : max(0, end - lo)] = False
    window = np.flatnonzero(inside)
    if not len(window):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    anchor = (v[window] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    first, last = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1]
    span = mixed(substring_hashes(sums, first, last + L) + (last - first).astype(np.uint64))
    # Anchors have low hashes, so their start's hash is a second one, which spreads them evenly over the ranges.
    return first + lo, last + lo, anchor[new] + lo, mixed(~grams[anchor[new]]), span


class Pack:
    """A pack with its anchors: first window, number of windows, bytes before the anchor.

    Of anchors with equal spans only the one in the least document (the leader)
    is in the index. Anchors are looked for once, when a pack is made, and kept
    with it as :meth:`marks`.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, marks: bytes | None = None):
        self.ids, self.ends, self.data = ids, ends, data
        if marks is None:
            self.first, last, at, start, span = anchors(data, ends)
            self.n, self.x = last - self.first + 1, at - self.first
        else:
            raw = zstandard.ZstdDecompressor().decompress(marks)
            m, led = np.frombuffer(raw, np.uint64, 2).tolist()
            parts = np.split(np.frombuffer(raw, np.uint8, offset=16), np.cumsum([4 * m, m, m, 4 * led]))
            self.first = np.cumsum(parts[0].view(np.uint32), dtype=np.int64)
            self.n, self.x = parts[1].astype(np.int64), parts[2].astype(np.int64)
        self.id = ids[np.searchsorted(ends, self.first, "right")]
        self.leader = np.arange(len(self.first))
        if marks is None:
            self.lead(mixed(start + span * np.uint64(0x9E3779B97F4A7C15)))
        else:
            self.leader[parts[3].view(np.uint32)] = parts[4].view(np.uint32)
        self.leaders = np.flatnonzero(self.leader == np.arange(len(self.leader)))

    def lead(self, key: np.ndarray) -> None:
        """Find the leaders. Keys propose, bytes decide: an anchor that differs from its leader stands for itself."""
        order = np.argsort(self.id, kind="stable")
        order = order[np.argsort(key[order], kind="stable")]
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
        self.leader[order] = order[new][np.cumsum(new) - 1]
        led = np.flatnonzero(self.leader != np.arange(len(order)))
        other = led[~self.equal(led, self.leader[led])]
        self.leader[other] = other

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are the spans of anchors ``a`` and ``b`` equal, byte by byte?"""
        out = (self.n[a] == self.n[b]) & (self.x[a] == self.x[b])
        for j in range(0, len(a), 1 << 13):
            x, y, at = a[j : j + (1 << 13)], b[j : j + (1 << 13)], np.arange(L + BEFORE)[None, :]
            beyond = at >= self.n[x][:, None] + L - 1
            left, right = (self.data[np.minimum(self.first[o][:, None] + at, len(self.data) - 1)] for o in (x, y))
            out[j : j + (1 << 13)] &= ((left == right) | beyond).all(axis=1)
        return out

    def marks(self) -> bytes:
        led = np.flatnonzero(self.leader != np.arange(len(self.leader)))
        gaps = np.diff(self.first, prepend=0).astype(np.uint32)
        parts = [np.array([len(self.first), len(led)], np.uint64), gaps, self.n.astype(np.uint8), self.x.astype(np.uint8), led.astype(np.uint32), self.leader[led].astype(np.uint32)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))

    def start(self, which: np.ndarray) -> np.ndarray:
        """The hash of the first ``K`` bytes from an anchor on; the same that :func:`anchors` gives."""
        at, power, h = self.first[which] + self.x[which], powers(K)[0], np.zeros(len(which), np.uint64)
        for k in range(K):
            h += BYTES[self.data[at + k]] * power[k]
        return mixed(~mixed(h))

    def expand(self, marked: np.ndarray) -> np.ndarray:
        """Marks of leaders to all anchors they stand for."""
        return marked[self.leader]

    def later(self) -> np.ndarray:
        """Anchors with an equal one in a smaller document of this pack."""
        return self.id > self.id[self.leader]


def packs(docs: DataFrame, key: str, text: str, batch: int = 0) -> DataFrame:
    """``pack, n_bytes, ids, ends, marks, z``: whole documents in packs, as arrays in binary."""
    rows = docs.select(docs[f"`{key}`"].cast("bigint").alias("id"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, size = (batch << 52) + (TaskContext.get().partitionId() << 28), [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def done() -> pa.RecordBatch:
            ends, raw = np.cumsum([len(p) for p in parts], dtype=np.int64), b"".join(parts)
            p = Pack(np.array(ids, np.int64), ends, np.frombuffer(raw, np.uint8))
            return table_of([(number, size, p.ids.tobytes(), ends.tobytes(), p.marks(), squeeze.compress(raw))], PACKS)

        for rows_ in batches:
            for i, t in zip(rows_.column("id").to_pylist(), rows_.column("text"), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if parts and size + len(raw) > PACK:
                    yield done()
                    number, ids, parts, size = number + 1, [], [], 0
                ids.append(NULL_ID if i is None else i)
                parts.append(raw)
                size += len(raw)
        if parts:
            yield done()

    return rows.mapInArrow(tidied(run), ddl(PACKS))


def opened(batch: pa.RecordBatch, r: int) -> Pack:
    ids, ends, marks, z = (batch.column(c)[r].as_py() for c in ("ids", "ends", "marks", "z"))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return Pack(np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), data, marks)


# --- arrays as binary columns -------------------------------------------------------------------


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct values, and for each value its place among them, in two or four bytes."""
    names, codes = np.unique(values, return_inverse=True)
    return names.tobytes(), small(codes)


def small(codes: np.ndarray) -> bytes:
    return codes.astype(np.uint16 if not len(codes) or codes.max() < 1 << 16 else np.uint32).tobytes()


def unsmall(raw: pa.Buffer | bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(memoryview(raw)) == 2 * n else np.uint32)


def uncoded(names: pa.Buffer, codes: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(names, np.int64)[unsmall(codes, n)]


def joined(parts: pa.Scalar, kind: type = np.uint32) -> np.ndarray:
    got = [np.frombuffer(x, kind) for x in parts.as_py() or [] if x]
    return np.concatenate(got) if got else np.empty(0, kind)


def by_range(start: np.ndarray, ranges: int, splits: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """The ranges of starts that occur, each with the rows in it, ordered by start. The upper half of a start's bits names one of ``ranges``, the lower half one of its ``splits``."""
    order = np.argsort(start, kind="stable")
    to = ((start[order] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    yield from runs_of(to * np.uint64(splits) + part_of(start[order] & LOW, splits), order)


def part_of(low: np.ndarray, splits: int) -> np.ndarray:
    return (low.astype(np.uint64) * np.uint64(splits)) >> np.uint64(32)


def runs_of(to: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in ``to`` with its rows, in the order given."""
    again = np.argsort(to, kind="stable")
    names, cuts = np.unique(to[again], return_index=True)
    yield from zip(names.tolist(), np.split(order[again], cuts[1:]), strict=False)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def arrow(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {dict(int32='int', int64='bigint', binary='binary', bool='boolean').get(str(f.type))}" for f in schema)


def dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows of a range together in a task, ranges one after the other."""
    tasks = min(ranges, TASKS)
    return rows.repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[pa.RecordBatch, int]]]]:
    """Each range with its rows, as they come."""
    cells = ((b, r, key) for b in batches for r, key in enumerate(b.column("range").to_pylist()))
    held = next(cells, None)

    def rows(key: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        nonlocal held
        while held is not None and held[2] == key:
            yield held[:2]
            held = next(cells, None)

    while held is not None:
        key = held[2]
        group = rows(key)
        yield key, group
        for _ in group:
            pass


PACKS = arrow(pack=pa.int64(), n_bytes=pa.int64(), ids=pa.binary(), ends=pa.binary(), marks=pa.binary(), z=pa.binary())


# --- 1: sift ------------------------------------------------------------------------------------

STARTS = arrow(range=pa.int32(), fresh=pa.bool_(), starts=pa.binary(), ords=pa.binary(), packs=pa.binary(), pcodes=pa.binary())
ASKED = arrow(pack=pa.int64(), shared=pa.binary(), hot=pa.binary(), n=pa.int64(), n_hot=pa.int64())


def starts_of(made: DataFrame, ranges: int, splits: int = 1) -> DataFrame:
    """For each range the starts (32 bits of their hashes) of all leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            start, ords, pack = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = [(k, True, (start[o] & LOW).astype(np.uint32).tobytes(), small(ords[o]), *coded(pack[o])) for k, o in by_range(start, ranges, splits)]
            return table_of(rows, STARTS)

        for batch in batches:
            for r, number in enumerate(batch.column("pack").to_pylist()):
                p = opened(batch, r)
                if not len(p.leaders):
                    continue
                held.append((p.start(p.leaders), p.leaders, np.full(len(p.leaders), number, np.int64)))
                size += len(p.leaders)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return made.mapInArrow(tidied(run), ddl(STARTS))


def sift(rows: DataFrame, hot: int) -> DataFrame:
    """``pack, shared, hot`` (ordinals of anchors in binary) and their numbers: of ``fresh`` entries those whose start is shared,
    of older ones those whose start was not shared, or not hot, until now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_group(batches):
            held = []
            for batch, r in group:
                starts, ords, packs_, pcodes = (batch.column(c)[r].as_buffer() for c in ("starts", "ords", "packs", "pcodes"))
                starts = np.frombuffer(starts, np.uint32)
                n = len(starts)
                held.append((starts, unsmall(ords, n).astype(np.uint32), uncoded(packs_, pcodes, n), np.full(n, batch.column("fresh")[r].as_py())))
            start, ords, pack, fresh = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            order = np.argsort(start)
            new = np.concatenate([[True], start[order][1:] != start[order][:-1]])
            group_of = np.empty(len(order), np.int64)
            group_of[order] = np.cumsum(new) - 1
            state = lambda n: (n > 1).astype(np.int8) + (n > hot)
            after = state(np.bincount(group_of))
            before = state(np.bincount(group_of, weights=~fresh, minlength=len(after)))
            wanted = np.flatnonzero((after[group_of] > 0) & (fresh | (after != before)[group_of]))
            wanted = wanted[np.argsort(pack[wanted], kind="stable")]
            names, cuts = np.unique(pack[wanted], return_index=True)
            rows_ = []
            for name, w in zip(names.tolist(), np.split(wanted, cuts[1:]), strict=False):
                is_hot = after[group_of[w]] == 2
                rows_.append((name, ords[w[~is_hot]].tobytes(), ords[w[is_hot]].tobytes(), int((~is_hot).sum()), int(is_hot.sum())))
            if rows_:
                yield table_of(rows_, ASKED)

    return rows.mapInArrow(tidied(run), ddl(ASKED))


# --- 2: index -----------------------------------------------------------------------------------

ENTRIES = arrow(
    range=pa.int32(), fixed=pa.bool_(), spans=pa.binary(), n=pa.binary(), x=pa.binary(), ords=pa.binary(), ids=pa.binary(), codes=pa.binary(), packs=pa.binary(), pcodes=pa.binary()
)
FOUND = arrow(range=pa.int32(), pack=pa.int64(), ord=pa.binary(), mask=pa.binary(), **{f.name: f.type for f in ENTRIES if f.name not in ("range", "fixed")})


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings of ``size`` bytes at ``begin``, one after the other."""
    return data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]


def packed(spans: np.ndarray, n: np.ndarray, x: np.ndarray, ident: np.ndarray, pack: np.ndarray, ords: np.ndarray) -> tuple[bytes, ...]:
    squeezed = zstandard.ZstdCompressor(level=1).compress(spans.tobytes())
    return squeezed, n.astype(np.uint8).tobytes(), x.astype(np.uint8).tobytes(), small(ords), *coded(ident), *coded(pack)


def suffixes(asked: DataFrame, ranges: int, splits: int = 1) -> DataFrame:
    """The entries for each range: spans of the anchors asked for, number of windows ``n``, bytes before the anchor ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            start, n, x, ident, pack, ords = (np.concatenate([h[i] for h in held]) for i in range(6))
            data = np.concatenate([h[6] for h in held])
            begin = np.cumsum(n + L - 1) - (n + L - 1)
            rows = [(k, False, *packed(gather(data, begin[o], n[o] + L - 1), n[o], x[o], ident[o], pack[o], ords[o])) for k, o in by_range(start, ranges, splits)]
            return table_of(rows, ENTRIES)

        for batch in batches:
            for r, number in enumerate(batch.column("pack").to_pylist()):
                ords = np.sort(joined(batch.column("shared")[r]))
                if not len(ords):
                    continue
                p = opened(batch, r)
                n = p.n[ords]
                held.append((p.start(ords), n, p.x[ords], p.id[ords], np.full(len(ords), number, np.int64), ords, gather(p.data, p.first[ords], n + L - 1)))
                size += len(ords)
                if size >= FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return asked.mapInArrow(tidied(run), ddl(ENTRIES))


# --- ranges that fill ---------------------------------------------------------------------------


def split_starts(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of :func:`starts_of` in ``after`` splits of each range in place of ``before``; each old one falls apart into new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                starts, ords, packs_, pcodes = (batch.column(c)[r].as_buffer() for c in ("starts", "ords", "packs", "pcodes"))
                starts = np.frombuffer(starts, np.uint32)
                n, base = len(starts), batch.column("range")[r].as_py() // before
                ords, pack = unsmall(ords, n), uncoded(packs_, pcodes, n)
                out = [(base * after + k, True, starts[o].tobytes(), small(ords[o]), *coded(pack[o])) for k, o in runs_of(part_of(starts, after), np.arange(n))]
                if out:
                    yield table_of(out, STARTS)

    return rows.mapInArrow(tidied(run), ddl(STARTS))


def split_level(rows: DataFrame, before: int, after: int) -> DataFrame:
    """A stored level in ``after`` splits of each range. Entries keep their order; verdicts, which belong to no range, stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = [batch.column(c)[r].as_py() for c in FOUND.names]
                if row[FOUND.names.index("spans")] is None:
                    yield table_of([tuple(row)], FOUND)
                    continue
                e = Entries.read(batch, r)
                to = part_of(e.starts() & LOW, after)
                for k, o in runs_of(to, np.arange(len(e.n))):
                    part = e.take(o)
                    yield table_of([(row[0] // before * after + k, None, None, None, *packed(part.spans(), part.n, part.x, part.id, part.pack, part.ord))], FOUND)

    return rows.mapInArrow(tidied(run), ddl(FOUND))


class Entries:
    """Entries as arrays: ``ahead`` (bytes from the anchor on) and ``back`` (bytes before it, backwards), both filled up with zeros."""

    FIELDS = ("ahead", "back", "n", "x", "id", "pack", "ord")

    def __init__(self, *arrays: np.ndarray):
        self.ahead, self.back, self.n, self.x, self.id, self.pack, self.ord = arrays

    @staticmethod
    def read(batch: pa.RecordBatch, r: int) -> Entries:
        raw = {c: batch.column(c)[r].as_buffer() for c in ("spans", "n", "x", "ords", "ids", "codes", "packs", "pcodes")}
        n, x = (np.frombuffer(raw[c], np.uint8).astype(np.int64) for c in ("n", "x"))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw["spans"]), np.uint8)
        size, count = n + L - 1, len(n)
        anchor = (np.cumsum(size) - size + x)[:, None]
        k = np.arange(L)[None, :]
        ahead = np.where(k < (size - x)[:, None], data[np.minimum(anchor + k, len(data) - 1)], 0).astype(np.uint8)
        k = k[:, :BEFORE]
        back = np.where(k < x[:, None], data[np.maximum(anchor - 1 - k, 0)], 0).astype(np.uint8)
        return Entries(ahead, back, n, x, uncoded(raw["ids"], raw["codes"], count), uncoded(raw["packs"], raw["pcodes"], count), unsmall(raw["ords"], count).astype(np.int64))

    def __len__(self) -> int:
        return len(self.n)

    def take(self, which: np.ndarray) -> Entries:
        return Entries(*(getattr(self, f)[which] for f in self.FIELDS))

    @staticmethod
    def concat(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(p, f) for p in parts]) for f in Entries.FIELDS))

    def order(self) -> np.ndarray:
        """Suffix order: by the bytes ahead, then those behind. Two sorted arrays one after the other are merged."""
        return np.argsort(strings(np.concatenate([self.ahead, self.back], axis=1)), kind="stable")

    def starts(self) -> np.ndarray:
        """The hash of the first ``K`` bytes ahead, as :meth:`Pack.start` gives it."""
        h = np.zeros(len(self.n), np.uint64)
        for k in range(K):
            h += BYTES[self.ahead[:, k]] * powers(K)[0][k]
        return mixed(~mixed(h))

    def spans(self) -> np.ndarray:
        """The spans one after the other, as :meth:`read` takes them."""
        whole = np.concatenate([self.back[:, ::-1], self.ahead], axis=1)
        at = np.arange(BEFORE + L)[None, :]
        return whole[(at >= (BEFORE - self.x)[:, None]) & (at < (BEFORE - self.x + self.n + L - 1)[:, None])]


def strings(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1]}").ravel()


def common(rows: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring rows."""
    other = rows[1:] != rows[:-1]
    return np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])


class Levels:
    """The logarithmic family of one range: sorted arrays, each about twice as large as the next at least. ``fixed`` ones are scanned, but not merged."""

    def __init__(self, fixed: list[Entries], levels: list[Entries]):
        self.fixed, self.levels = fixed, levels
        self.masks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: Entries) -> None:
        batch = batch.take(batch.order())
        own = [batch, *(x.take(shares_start(x, batch)) for x in (*self.fixed, *self.levels))]
        fresh = np.concatenate([np.full(len(x), i == 0) for i, x in enumerate(own)])
        merged = Entries.concat(own)
        order = merged.order()
        merged, fresh = merged.take(order), fresh[order]
        keep = self.equals(merged)
        self.shared(merged.take(keep))
        batch = merged.take(keep & fresh)
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.merge()

    def merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        both = Entries.concat([b, a])
        self.levels.append(both.take(both.order()))

    def equals(self, e: Entries) -> np.ndarray:
        """Of equal entries the least document covers the others, which are not kept."""
        if not len(e):
            return np.empty(0, bool)
        same = (common(e.ahead) == L) & (common(e.back) == BEFORE) & (e.n[1:] == e.n[:-1]) & (e.x[1:] == e.x[:-1])
        new = np.concatenate([[True], ~same])
        keep = e.id == np.minimum.reduceat(e.id, np.flatnonzero(new))[np.cumsum(new) - 1]
        self.found(e.take(~keep), (np.uint32(1) << e.n[~keep].astype(np.uint32)) - np.uint32(1))
        return keep

    def shared(self, e: Entries) -> None:
        """Windows of entries that a smaller document has too: those for which the common bytes ahead and behind reach far enough."""
        if len(e) < 2:
            return
        ahead = common(e.ahead)
        some = np.concatenate([[False], ahead >= K, [False]])
        some = np.flatnonzero(some[1:] | some[:-1])
        if not len(some):
            return
        e = e.take(some)
        ahead, by_back = common(e.ahead), np.argsort(strings(e.back), kind="stable")
        back = common(e.back[by_back])
        by_id = np.argsort(e.id, kind="stable")
        mask = np.zeros(len(e), np.uint32)
        for x in range(BEFORE + 1):  # the window that begins x bytes before the anchor
            near = np.zeros(len(e), np.int64)
            near[1:] = np.cumsum(ahead < L - x)
            far = np.zeros(len(e), np.int64)
            far[by_back[1:]] = np.cumsum(back < x)
            has = by_id[((e.x >= x) & (e.x - x < e.n))[by_id]]
            key = near[has] * len(e) + far[has]
            order = np.argsort(key, kind="stable")
            key, who = key[order], has[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            covered = who[e.id[who] > e.id[who[new]][np.cumsum(new) - 1]] if len(who) else who
            mask[covered] |= np.uint32(1) << (e.x[covered] - x).astype(np.uint32)
        hit = np.flatnonzero(mask)
        self.found(e.take(hit), mask[hit])

    def found(self, e: Entries, mask: np.ndarray) -> None:
        if len(e):
            self.masks.append((e.pack, e.ord, mask))

    def verdicts(self) -> list[tuple[int, bytes, bytes]]:
        """Pack, ordinals and masks (bit k for the k-th window of the anchor)."""
        if not self.masks:
            return []
        pack, ords, mask = (np.concatenate(x) for x in zip(*self.masks, strict=True))
        order = np.argsort(pack, kind="stable")
        names, cuts = np.unique(pack[order], return_index=True)
        return [(int(n), ords[o].astype(np.uint32).tobytes(), mask[o].tobytes()) for n, o in zip(names, np.split(order, cuts[1:]), strict=False)]


def shares_start(level: Entries, batch: Entries) -> np.ndarray:
    """Which entries of a level begin like one of the sorted batch."""
    if not len(level) or not len(batch):
        return np.zeros(len(level), bool)
    have, want = strings(batch.ahead[:, :K]), strings(level.ahead[:, :K])
    return have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want


def scan(rows: DataFrame, keep: bool) -> DataFrame:
    """Verdicts (``pack, ord, mask``) from the entries, which lie together by range, and with ``keep`` the level that they became, as entries.

    Rows that are ``fixed`` are levels that stay as they are; other rows are a
    batch of new entries, or a level that is merged with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in by_group(batches):
            levels, held, size = Levels([], []), [], 0
            for batch, r in group:
                fixed, e = batch.column("fixed")[r].as_py(), Entries.read(batch, r)
                if fixed is not None and fixed:
                    levels.fixed.append(e.take(e.order()))
                    continue
                held.append(e)
                size += len(e)
                if size >= BATCH:
                    levels.add(Entries.concat(held))
                    held, size = [], 0
            if held:
                levels.add(Entries.concat(held))
            none = (None,) * 8
            out = [(key, *v, *none) for v in levels.verdicts()]
            if keep:
                while len(levels.levels) > 1:
                    levels.merge()
                for x in levels.levels:
                    out.append((key, None, None, None, *packed(x.spans(), x.n, x.x, x.id, x.pack, x.ord)))
            if out:
                yield table_of(out, FOUND)

    return rows.mapInArrow(tidied(run), ddl(FOUND))


# --- hot starts ---------------------------------------------------------------------------------

WINDOWS = arrow(window=pa.binary(), id=pa.int64(), pack=pa.int64(), ord=pa.int64(), bit=pa.int32())


def hot_windows(asked: DataFrame) -> DataFrame:
    """``window`` (its bytes), ``id, pack, ord, bit`` for the anchors whose start is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, number in enumerate(batch.column("pack").to_pylist()):
                ords = np.sort(joined(batch.column("hot")[r])).astype(np.int64)
                if not len(ords):
                    continue
                p = opened(batch, r)
                n = p.n[ords]
                bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(ords, n)
                data = gather(p.data, p.first[own] + bit, np.full(len(own), L))
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(L), len(own), [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([column, pa.array(p.id[own]), pa.array(np.full(len(own), number)), pa.array(own), pa.array(bit.astype(np.int32))], schema=WINDOWS)

    return asked.mapInArrow(tidied(run), ddl(WINDOWS))


def judge_windows(windows: DataFrame) -> DataFrame:
    """``pack, ord, mask``: windows that a smaller document has too. The least document of a window is found with partial sums."""
    least = materialise(windows.groupBy(F.col("window").alias("w")).agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    hit = windows.join(least, F.col("window") == F.col("w")).where("id > least")
    out = materialise(hit.groupBy("pack", "ord").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bit"))).alias("mask")), "masks")
    forget(least)
    return out


# --- 3: finish ----------------------------------------------------------------------------------

RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def finish(rows: DataFrame, with_kept: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p = opened(batch, r)
                bits = np.zeros(len(p.first), np.uint32)
                np.bitwise_or.at(bits, joined(batch.column("ord")[r]), joined(batch.column("mask")[r]))
                for x in batch.column("hot")[r].as_py() or []:
                    bits[x["ord"]] |= np.uint32(x["mask"])
                yield finished(p, bits, with_kept)

    return rows.mapInArrow(tidied(run), RESULT)


def removed_bytes(p: Pack, bits: np.ndarray) -> np.ndarray:
    """Which bytes go, from the covered windows of the leaders."""
    whole = p.later() | (p.expand(bits) == (np.uint32(1) << p.n.astype(np.uint32)) - np.uint32(1))
    bits = np.where(whole, 0, p.expand(bits))
    change = np.zeros(len(p.data) + 1, np.int32)
    np.add.at(change, p.first[whole], 1)
    np.add.at(change, p.first[whole] + p.n[whole] - 1 + L, -1)
    some = np.flatnonzero(bits)
    for k in range(BEFORE + 1):
        at = p.first[some[(bits[some] >> np.uint32(k)) & np.uint32(1) > 0]] + k
        np.add.at(change, at, 1)
        np.add.at(change, at + L, -1)
    return np.cumsum(change[:-1]) > 0


def finished(p: Pack, bits: np.ndarray, with_kept: bool) -> pa.RecordBatch:
    gone = removed_bytes(p, bits)
    begins = np.concatenate([[0], p.ends[:-1]])
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[p.ends] - sums[begins]
    starts, stops, offsets, digests, kept = [], [], [0], [], []
    raw = p.data.tobytes()
    for b, e, n in zip(begins.tolist(), p.ends.tolist(), removed.tolist(), strict=True):
        if n:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[b:e], [False]]).astype(np.int8)))
            starts += edge[::2].tolist()
            stops += edge[1::2].tolist()
            rest = p.data[b:e][~gone[b:e]].tobytes()
        else:
            rest = raw[b:e]
        offsets.append(len(starts))
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest if with_kept else None)
    pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["start", "stop"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(p.ids, pa.int64(), mask=p.ids == NULL_ID), pa.array(p.ends - begins, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(offsets), pa.int64()),
            pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs), pa.array(kept, pa.binary()),
        ],
        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
    )


# --- the index as a whole -----------------------------------------------------------------------


class SuffixIndex:
    """Batches of documents with their levels. :meth:`add` a batch, or several one after the other; :meth:`results` are those of all documents so far.

    After ``n`` batches there is a level for each bit of ``n``: a new batch is
    merged with the levels of the last 1, 2, 4... batches, as a carry goes
    through a binary number, so that each level holds as many batches as it is
    made of equal ones. The other levels stay as they are and are only scanned.
    With ``last`` no further batch is to come, and no level is written.

    Ranges are set by the first batch and split as they fill: when they hold
    twice what a task should, each falls into as many parts as it takes, and so
    do the stored levels. That happens a logarithmic number of times.

    With a ``folder`` the tables and the index's state are kept there, a version
    for each batch, and another program goes on with :meth:`open`. Without one
    they are deleted when the program ends.
    """

    TABLES = ("packs", "starts", "windows", "verdicts", "masks")

    def __init__(self, spark: SparkSession, ranges: int | None = None, sift_ranges: int | None = None, hot: int = HOT, folder: str | None = None, range_entries: int = RANGE, sift_bytes: int = SIFT_BYTES):
        self.spark, self.ranges, self.sift_ranges, self.hot, self.folder = spark, ranges, sift_ranges, hot, folder
        self.range_entries, self.sift_bytes = range_entries, sift_bytes
        self.splits = self.sift_splits = 1
        self.batches = self.entries = self.bytes = 0
        self.packs: list[DataFrame] = []
        self.starts: list[DataFrame] = []
        self.levels: list[tuple[int, DataFrame]] = []  # number of batches, table
        self.windows: list[DataFrame] = []
        self.verdicts: list[DataFrame] = []
        self.masks: list[DataFrame] = []

    STATE = ("ranges", "sift_ranges", "hot", "range_entries", "sift_bytes", "splits", "sift_splits", "batches", "entries", "bytes")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SuffixIndex:
        """The index that was kept in a folder, after its last whole batch."""
        version, state = Ledger(spark, folder).read()
        if not version:
            raise LookupError(f"no index in {folder}")
        index = cls(spark, folder=folder)
        for name in cls.STATE:
            setattr(index, name, state[name])
        for name in cls.TABLES:
            setattr(index, name, [index._read(p) for p in state[name]])
        index.levels = [(size, index._read(p)) for size, p in state["levels"]]
        return index

    def _read(self, path: str) -> DataFrame:
        out = self.spark.read.parquet(path)
        out._loomtext_path = path
        return out

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.folder is None:
            return materialise(df, name)
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        with_cleanup(self.spark, lambda: df.write.parquet(path))
        return self._read(path)

    def _save(self) -> None:
        if self.folder is not None:
            path = lambda df: df._loomtext_path
            state = {n: getattr(self, n) for n in self.STATE} | {n: [path(x) for x in getattr(self, n)] for n in self.TABLES} | {"levels": [(n, path(x)) for n, x in self.levels]}
            Ledger(self.spark, self.folder).commit(lambda version, before: state)

    def _grow(self) -> None:
        """Split ranges that hold twice what they should."""
        need = lambda total, each: 1 << max(0, -(-total // each) - 1).bit_length()
        if self.bytes > 2 * self.sift_bytes * self.sift_ranges * self.sift_splits:
            after = need(-(-self.bytes // self.sift_ranges), self.sift_bytes)
            self.starts = [self._keep(split_starts(x, self.sift_splits, after), "starts") for x in self.starts]
            self.sift_splits = after
        if self.entries > 2 * self.range_entries * self.ranges * self.splits:
            after = need(-(-self.entries // self.ranges), self.range_entries)
            old = {id(x): self._keep(split_level(x, self.splits, after), "index") for _, x in self.levels}
            self.verdicts = [old.get(id(x), x) for x in self.verdicts]
            self.levels = [(size, old[id(x)]) for size, x in self.levels]
            self.splits = after

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", last: bool = False) -> None:
        self.batches += 1
        made = self._keep(packs(docs, key, text, self.batches), "packs")
        self.packs.append(made)
        self.bytes += made.agg(F.sum("n_bytes")).first()[0] or 0
        if self.sift_ranges is None:
            self.sift_ranges = max(1, -(-self.bytes // self.sift_bytes))
        if self.ranges is not None:
            self._grow()
        starts = starts_of(made, self.sift_ranges, self.sift_splits)
        if not last:
            starts = self._keep(starts, "starts")
        every = functools.reduce(DataFrame.unionByName, [x.withColumn("fresh", F.lit(False)) for x in self.starts], starts)
        self.starts.append(starts)
        asked = materialise(sift(dealt(every, self.sift_ranges * self.sift_splits), self.hot), "asked")
        n = asked.agg(F.sum("n").alias("n"), F.sum("n_hot").alias("hot")).first()
        self.entries += n["n"] or 0
        if self.ranges is None:
            self.ranges = max(1, -(-(n["n"] or 0) // self.range_entries))
        self._grow()
        told = asked.groupBy("pack").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot"))
        held = functools.reduce(DataFrame.unionByName, self.packs).join(told, "pack")
        merged = [size for size, _ in self.levels]
        carry, size = [], 1
        while merged and merged[-1] == size:
            carry.append(merged.pop())
            size *= 2
        fixed, carried = self.levels[: len(merged)], self.levels[len(merged) :]
        entries = suffixes(held, self.ranges, self.splits)
        for tables, stays in ((fixed, True), (carried, False)):
            for _, x in tables:
                entries = entries.unionByName(x.where("spans IS NOT NULL").select("range", F.lit(stays).alias("fixed"), *[f.name for f in ENTRIES if f.name not in ("range", "fixed")]))
        found = self._keep(scan(dealt(entries, self.ranges * self.splits), keep=not last), "index")
        self.verdicts.append(found)
        self.levels = [*fixed, (size, found)]
        if n["hot"]:
            windows = self._keep(hot_windows(held), "windows")
            self.windows.append(windows)
            masks = judge_windows(functools.reduce(DataFrame.unionByName, self.windows))
            self.masks.append(masks if self.folder is None else self._keep(masks, "masks"))
        forget(asked)
        if not last:
            self._save()

    def results(self, with_kept: bool = False) -> DataFrame:
        verdicts = functools.reduce(DataFrame.unionByName, [x.where("pack IS NOT NULL").select("pack", "ord", "mask") for x in self.verdicts])
        parts = verdicts.groupBy("pack").agg(F.collect_list("ord").alias("ord"), F.collect_list("mask").alias("mask"))
        masks = functools.reduce(DataFrame.unionByName, self.masks) if self.masks else self.spark.createDataFrame([], "pack bigint, ord bigint, mask int")
        hot = masks.groupBy("pack").agg(F.collect_list(F.struct("ord", "mask")).alias("hot"))
        return finish(functools.reduce(DataFrame.unionByName, self.packs).join(parts, "pack", "left").join(hot, "pack", "left"), with_kept)

    def drop(self) -> None:
        """Delete the tables of the index."""
        forget(*self.packs, *self.starts, *self.windows, *self.verdicts, *self.masks)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False, **how: int) -> DataFrame:
    """One row per row: ``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed runs, byte offsets) and ``kept`` (bytes, on demand).

    A byte goes if a string of 50 bytes over it also starts in a row with a
    smaller id. Texts are taken as UTF-8 and whole; null counts as empty. Texts
    under 50 bytes lose nothing. A null id is smaller than all others. Rows
    that share an id are compared with rows of smaller ids only, not with each
    other. Columns besides these two are not read. An empty table gives no rows.
    """
    index = SuffixIndex(docs.sparkSession, **how)
    index.add(docs, key, text, last=True)
    out = materialise(index.results(with_kept), "repeats")
    index.drop()
    return out
