"""Importance resampling against plain Python, and its hard cases."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomtext.llm import importance as im

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def by_hand(rows, target, most, buckets, seed, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(map(bucket, features(x, most)[1]))
    for x in target:
        t.update(map(bucket, features(x, most)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, fit = [], []
    for i, (key, x) in enumerate(rows):
        n, found = features(x, most)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None])
        if n >= least:
            fit.append((-score, key is None, key or 0, i))
    for r, (*_, i) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        out[i][4] = r
    return sorted(map(str, out))


def corpus():
    words = "The cat_sat ON a-mat; Ünder 7 bÄume über 12abc été   x\x7fy 😀 zz".split(" ")
    pick = lambda i, n: " ".join(words[zlib.crc32(f"{i}.{j}".encode()) % len(words)] for j in range(n))
    rows = [(i, pick(i, i % 50)) for i in range(400)] + [(None, pick(1, 30)), (None, None), (900, None), (901, ""), (902, "!!! \n"), (903, "word " * 4000), (903, "word " * 4000), (904, "A" * 3000)]
    return rows, [pick(i, 12) for i in range(1000, 1030)] + [None, "", "été été"]


@pytest.mark.parametrize(("most", "block", "piece"), [(1, 1 << 18, 1 << 20), (1, 5, 64), (3, 40, 16)])
def test_against_plain_python(spark, monkeypatch, most, block, piece):
    monkeypatch.setattr(im, "PIECE", piece)
    rows, target = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"mine {c}") for c in ("row", "id", "n", "rank", "score", "block", "__row")}).repartition(5)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    how = {"most": most, "buckets": 97, "seed": 7, "least_words": 9, "percent": 30}
    got = im.importance(docs, wanted, block=block, **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == by_hand(rows, target, *how.values())
    assert im.importance(docs.limit(0), wanted).count() == 0
    assert im.importance(docs.limit(9), wanted.limit(0), block=block).count() == 9


def test_pieces(monkeypatch):
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(im, "PIECE", size)
        for _, text in corpus()[0]:
            for most in (1, 2, 4):
                got = list(im.pieces((text or "").encode(), most))
                n, want = features(text, most)
                assert sum(k for k, _ in got) == n and collections.Counter(f.decode() for _, x in got for f in x) == collections.Counter(want)


def test_drawn_documents_keep_their_columns(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, rank string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = im.resample(docs, wanted, percent=25)
    scored = im.importance(docs, wanted, percent=25).where("rank is not null")
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in scored.collect())


def test_ties_go_by_key_and_equal_rows_each_have_a_rank(spark):
    docs = spark.range(100).select(F.when(F.col("id") % 2 == 0, 5).otherwise(7).alias("doc_id"), F.lit("a b c").alias("text"))
    got = im.importance(docs, docs.select("text"), least_words=1, percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 101)) and len({r.score for r in got}) == 2
