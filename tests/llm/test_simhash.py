"""SimHash against plain Python and all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import entries, simhash
from loomtext.llm.common import table
from tests.test_catalog import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    found = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, most=3):
    """The least place of each component, over all pairs."""
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= most
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return label
        label = new


TEXTS = [None, "", " \n", "one", "One  TWO", "one two three", "a b c d " * 50, "É é   x y z", "x" * 5000, "w1 w2 w3 w4 w1 w2 w3"]


def test_fingerprints(spark, monkeypatch):
    assert [simhash.fingerprint((t or "").encode()) for t in TEXTS] == [by_hand(t) for t in TEXTS]
    long = " ".join(f"W{i * i % 977}" for i in range(3000))
    assert simhash.fingerprint(long.encode()) == by_hand(long)
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert [simhash.fingerprint((t or "").encode()) for t in [*TEXTS, long]] == [by_hand(t) for t in [*TEXTS, long]]
    assert simhash.fingerprint(b"a b c d", words=1) == by_hand("a b c d", 1)
    # Spark's own function is the same hash with the same seed.
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] % (1 << 64) == by_hand("one two three")


def test_groups(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (3, "one"), (None, "alone by itself here"), (99, "a b c d " * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"mine {c}") for c in ("id", "print", "label", "a", "b", "component_id")})
    prints = [by_hand(t) for _, t in rows]
    label = components_by_hand(prints)
    least = {c: min((rows[i][0] for i in np.flatnonzero(label == c) if rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted(str((k, p, least[c])) for (k, _), p, c in zip(rows, prints, label, strict=True))
    got = simhash.near_groups(df).collect()
    assert sorted(str((r.id, r.print % (1 << 64), r.component_id)) for r in got) == want
    assert simhash.near_groups(df.limit(0)).count() == 0


def family(n, seed):
    """Fingerprints in chains, clusters and by chance, some of few bits."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 64, n, dtype=np.uint64)]
    for start in out[:20] + [0]:
        x = start
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    hub = out[0]
    out += [hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    return sorted(set(out))


@pytest.mark.parametrize(("most", "tile"), [(3, 2048), (3, 7), (1, 50), (0, 5)])
def test_links_against_all_pairs(spark, most, tile):
    prints = family(400, most)
    label = components_by_hand(prints, most)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long").repartition(3)
    edges = simhash.links(df, most, tile=tile).collect()
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = find(place[e.a % (1 << 64)]), find(place[e.b % (1 << 64)])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == label.tolist()


def test_distances_bound_differences():
    pivots = simhash.Pivots()
    x = np.array(family(300, 5), np.uint64)
    table = pivots.distances(x)
    assert table.shape == (len(x), 48) and np.array_equal(table, [[bin(int(a) ^ int(p)).count("1") for p in pivots.all] for a in x])
    i, j = np.triu_indices(len(x), 1)
    d = np.bitwise_count(x[i] ^ x[j])
    assert (np.abs(table[i].astype(int) - table[j]).max(axis=1) <= d).all()
    same = (pivots.keys(x)[i] == pivots.keys(x)[j]).any(axis=1)
    assert same[d <= 3].all() and same[d > 20].mean() < 0.01


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, str(DATA), "documents").collect()]
    prints = [by_hand(t) for _, t in docs]
    label = components_by_hand(prints)
    least = {c: min(docs[i][0] for i in np.flatnonzero(label == c)) for c in set(label)}
    want = {d: (f"{p:016x}", least[c]) for (d, _), p, c in zip(docs, prints, label, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entries.op13_simhash(spark, str(DATA)).collect()}
    assert got == want
