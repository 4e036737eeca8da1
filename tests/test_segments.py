"""The index of segments against scoring every posting, and the commit log."""

import threading
import zlib

import pytest
from pyspark.sql import functions as F

from loomtext.operators import lexical, segments
from loomtext.sources.ledger import Ledger

WORDS = [f"w{i}" for i in range(40)] + ["the", "of", "a"] * 12


def text(i, n):
    return " ".join(WORDS[zlib.crc32(f"{i}.{j}".encode()) % len(WORDS)] for j in range(n)) + " the of" * (i % 4)


def chunks(spark, ids):
    return spark.createDataFrame([(f"c{i:04}", i, text(i, 3 + i * 7 % 60)) for i in ids], "chunk_id string, ord long, text string")


def asked(spark, n=12):
    rows = [(i, text(1000 + i, 6)) for i in range(n)] + [(100, "the of a"), (101, "the the the"), (102, "nothing known"), (103, None), (104, "w3"), (105, "the w1 w2 w1 of")]
    return spark.createDataFrame(rows, "query_id int, query string")


def listed(df):
    return sorted((r.query_id, r.lexical_rank, r.chunk_id, r.score) for r in df.collect())


def statistics(index):
    c = index.corpus_stats.first()
    return sorted((r.term, r.df, round(r.idf, 9)) for r in index.term_stats.collect()), (c.n, round(c.avgdl, 9), round(c.avg_idf, 9)), sorted((r.chunk_id, r.dl) for r in index.doc_stats.collect())


@pytest.mark.parametrize("k", [3, 24])
def test_topk_equals_scoring_everything(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(segments, "BLOCK", 16)
    rows = chunks(spark, range(400)).unionByName(spark.createDataFrame([("empty", 900, ""), ("null", 901, None)], "chunk_id string, ord long, text string"))
    whole = lexical.build_index(rows)
    index = segments.put(spark, f"file://{tmp_path}/i", rows)
    qs = asked(spark)
    assert listed(lexical.bm25_topk(qs, index, k)) == listed(lexical.bm25_topk(qs, whole, k))
    assert statistics(index) == statistics(whole)
    monkeypatch.setattr(segments, "WORTH", 0.0)
    assert listed(lexical.bm25_topk(qs, index, k)) == listed(lexical.bm25_topk(qs, whole, k))
    w = segments.work(qs, index, k).first()
    assert w.scored < w["all"] * (0.75 if k == 3 else 1)


def test_terms_that_count_against_a_chunk(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", i, "x y z " * (i % 3 + 1) + ("q" if i == 3 else "")) for i in range(8)], "chunk_id string, ord long, text string")
    qs = spark.createDataFrame([(1, "x q"), (2, "x y")], "query_id int, query string")
    assert listed(segments.put(spark, f"file://{tmp_path}/i", rows).topk(qs, 2)) == listed(lexical.bm25_topk(qs, lexical.build_index(rows), 2))


def test_changes_equal_a_rebuild_and_segments_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LIKE", 4)
    path, have = f"file://{tmp_path}/i", {i: i for i in range(60)}
    rows = lambda ids: spark.createDataFrame([(f"c{i:04}", i, text(t, 3 + t * 7 % 60)) for i, t in ids], "chunk_id string, ord long, text string")
    index = segments.put(spark, path, rows(have.items()))
    counts = []
    for step in range(7):
        new = [(200 + step * 3 + j, 300 + step * 5 + j) for j in range(2)] + [(step, 500 + step)]  # two more, one that changes
        old = [(i, have[i]) for i, _ in new if i in have] + [(40 + step, have[40 + step])]  # its old text, and one that goes
        index = segments.put(spark, path, rows(new), rows(old))
        have = {i: t for i, t in have.items() if i not in dict(old)} | dict(new)
        counts.append(len(index.content["segments"]))
    whole = lexical.build_index(rows(have.items()))
    assert statistics(index) == statistics(whole) and max(counts) <= 5 and min(counts[3:]) < max(counts)
    assert listed(index.topk(asked(spark), 5)) == listed(lexical.bm25_topk(asked(spark), whole, 5))
    old = segments.open_segments(spark, path, 1)
    assert old.content["n"] == 60 and old.doc_stats.count() == 60


def test_no_index(spark, tmp_path):
    with pytest.raises(lexical.LexicalIndexError, match="no index"):
        segments.open_segments(spark, f"file://{tmp_path}/none")

    with pytest.raises(lexical.LexicalIndexError, match="empty"):
        segments.put(spark, f"file://{tmp_path}/empty", chunks(spark, [1]).limit(0))


def test_racing_writers_both_stay(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.read() == (0, {}) and ledger.create(1, {"a": 1}) and not ledger.create(1, {"a": 2}) and ledger.read() == (1, {"a": 1})

    def write(i):
        Ledger(spark, f"file://{tmp_path}/l").commit(lambda version, content: content | {f"w{i}": version})

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, content = ledger.read()
    assert version == 9 and set(content) == {"a", *(f"w{i}" for i in range(8))} and ledger.versions() == list(range(1, 10))
