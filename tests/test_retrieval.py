import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.operators import dense, fusion, identity, lexical, policy
from loomtext.operators.filters import FilterError, compile_filter
from loomtext.plans.search import search
from loomtext.settings import Retrieval


def ranks(spark, name, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], f"query_id int, chunk_id string, {name} long")


def test_fusion_by_hand(spark):
    got = fusion.fuse(ranks(spark, "dense_rank", ["a", "b"]), ranks(spark, "lexical_rank", ["b", "c"])).orderBy("rank").collect()
    assert [(r.chunk_id, r.found_by) for r in got] == [("b", "both"), ("a", "dense"), ("c", "lexical")]
    assert [r.score for r in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61, 1 / 62], abs=1e-9)
    none = ranks(spark, "dense_rank", ["a"]).limit(0)
    assert fusion.fuse(none, ranks(spark, "lexical_rank", ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(none, none, k=0)


def test_bm25_by_hand(spark):
    texts = ["H* L-L% tone tone", "tone plain", "tone other words"]
    chunks = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, ord long, text string")
    index = lexical.build_index(chunks)
    q = spark.createDataFrame([(1, "H*"), (2, "tone tone plain"), (3, "absent"), (4, None)], "query_id int, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_topk(q, index).collect()}
    tokens = [["H*", "h*", "L-L%", "l-l%", "tone", "tone"], ["tone", "plain"], ["tone", "other", "words"]]
    df = {t: sum(t in x for x in tokens) for t in {y for x in tokens for y in x}}
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    avg = sum(map(len, tokens)) / 3
    part = lambda t, x: idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg))
    want = {(1, "c0"): part("H*", tokens[0]) + part("h*", tokens[0])}
    for i, x in enumerate(tokens):
        want[(2, f"c{i}")] = 2 * part("tone", x) + part("plain", x)
    assert got == pytest.approx({k: round(v, 6) for k, v in want.items() if v > 0})


def test_index_round_trip_and_refusals(spark, tmp_path):
    chunks = spark.createDataFrame([("c", 0, "a b")], "chunk_id string, ord long, text string")
    lexical.save_index(lexical.build_index(chunks), f"file://{tmp_path}/i")
    assert lexical.load_index(spark, f"file://{tmp_path}/i").postings.count() == 2
    with pytest.raises(lexical.LexicalIndexError):
        lexical.save_index(lexical.build_index(chunks.limit(0)), f"file://{tmp_path}/j")
    with pytest.raises(lexical.LexicalIndexError):
        lexical.load_index(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_matches_numpy(spark, parts):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(60, 8)), rng.normal(size=(5, 8))
    x[10] = x[11] = x[12]
    vec = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(x)] + [("null", None)], "chunk_id string, embedding array<double>").repartition(parts)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    got = {(r.query_id, r.dense_rank): (r.chunk_id, r.distance) for r in dense.dense_topk(qs, vec, 13).collect()}
    d = np.round(1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
    for i in range(5):
        order = sorted(range(60), key=lambda j: (d[i, j], f"c{j:02}"))[:13]
        assert [got[(i, k + 1)][0] for k in range(13)] == [f"c{j:02}" for j in order]
    assert dense.dense_topk(qs.limit(0), vec, 3).count() == 0 and dense.dense_topk(qs, vec.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        dense.check_dimension(vec, 9).collect()


def test_dense_with_exclusion_for_some_queries(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0], "bad"), ("b", [0.9, 0.1], "ok"), ("c", [0.0, 1.0], None)], "chunk_id string, embedding array<double>, doc_type string")
    qs = spark.createDataFrame([(1, [1.0, 0.0], True), (2, [1.0, 0.0], False), (3, [1.0, 0.0], None)], "query_id int, embedding array<double>, exclude boolean")
    ok = F.coalesce(F.col("doc_type") != "bad", F.lit(True))
    got = {q: [r.chunk_id for r in sorted(rows, key=lambda r: r.dense_rank)] for q in (1, 2, 3) if (rows := [r for r in dense.dense_topk(qs, vec, 2, ok, "exclude").collect() if r.query_id == q])}
    assert got == {1: ["b", "c"], 2: ["a", "b"], 3: ["a", "b"]}
    assert {r.chunk_id for r in dense.dense_topk(qs, vec, 5, F.lit(False)).collect()} == set()


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank long, doc_type string, source_path string, source_id string, fingerprint string, token_count long")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from("xyz"), st.sampled_from("pq"), st.integers(0, 60)), min_size=1, max_size=25))
def test_policy_invariants(spark, items):
    rows = [(q, f"c{i}", i + 1, "style_rule", p, "s", f, t) for i, (q, p, f, t) in enumerate(items)]
    df = hits(spark, rows)
    capped = policy.cap_per_document(df, 3).groupBy("query_id", "source_path").count()
    assert all(r["count"] <= 3 for r in capped.collect())
    kept = policy.dedup(df).collect()
    assert len({(r.query_id, r.fingerprint) for r in kept}) == len(kept)
    placed = policy.demote(df, ("x",))
    cut = policy.trim_budget(placed, 100).collect()
    for q in {r[0] for r in rows}:
        costs, spent, want = [r[7] for r in rows if r[0] == q], 0, 0
        for c in costs:
            spent += c
            if spent > 100:
                break
            want += 1
        assert sum(r.query_id == q for r in cut) == want


def test_demote_and_exclude(spark):
    df = hits(spark, [(1, "a", 1, "evaluation_case", "p", "s", "f", 1), (1, "b", 2, None, "p", "s", "g", 1), (1, "c", 3, "negative_pattern", "p", "s", "h", 1)])
    assert [r.chunk_id for r in policy.demote(policy.exclude(df, ("negative_pattern",)), ("evaluation_case",)).orderBy("position").collect()] == ["b", "a"]


def test_filters(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "source_id string, doc_type string")
    ids = lambda w: [r.source_id for r in df.where(compile_filter(w)).orderBy("source_id").collect()]
    assert ids({"doc_type": {"$ne": "x"}}) == ["b"] and ids({"doc_type": {"$nin": ["x"]}}) == ["b"] and ids(None) == ["a", "b"]
    assert ids({"$or": [{"source_id": "a"}, {"doc_type": {"$in": ["y"]}}]}) == ["a"] and ids({"source_id": {"$gt": "a"}}) == ["b"]
    for bad in ({"x": 1}, {"$and": [{"x": 1}]}, {"doc_type": {"$like": 1}}, {"$or": []}):
        with pytest.raises(FilterError):
            compile_filter(bad)


def chain(spark):
    words = ["alpha beta", "beta gamma", "gamma delta", "delta alpha", "robotic tone"]
    rows = [(f"{i:016x}_{i}", w, "s", "s/f", i, 5, "negative_pattern" if i == 4 else "style_rule", w, 2, i) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "id string, text string, source_id string, source_path string, chunk_index long, chunk_total int, doc_type string, fingerprint string, token_count long, ord long")
    df = identity.link_neighbors(df).withColumn("dialect", F.lit("en"))
    vec = spark.createDataFrame([(r[0], [1.0, float(i)]) for i, r in enumerate(rows)], "chunk_id string, embedding array<double>")
    return df, vec, lexical.build_index(df.select(F.col("id").alias("chunk_id"), "ord", "text"))


def test_search_end_to_end(spark):
    df, vec, index = chain(spark)
    q = spark.createDataFrame([(1, "beta", [1.0, 1.0]), (2, "what sounds robotic", [1.0, 4.0]), (3, " ", [1.0, 0.0]), (4, "x" * 2001, [1.0, 0.0]), (5, "nothing here", None)], "query_id int, query string, embedding array<double>")
    got = search(q, df, vec, index, config=Retrieval(final_k=2))
    rows = got.results.collect()
    assert {r.query_id for r in got.rejected.collect()} == {3, 4}
    per = {i: sorted((r for r in rows if r.query_id == i), key=lambda r: r.position) for i in (1, 2, 5)}
    assert per[1][0].chunk_id.endswith("_1") and sum(not r.is_neighbor for r in per[1]) == 2
    assert all(r.score == 0 and r.found_by == "neighbor" for r in per[1] if r.is_neighbor)
    assert not any(r.chunk_id.endswith("_4") for r in per[1]) and any(r.chunk_id.endswith("_4") for r in per[2])
    stats = {r.query_id: r for r in got.stats.collect()}
    assert stats[5].dense_n == stats[5].ranked_n == 0 and stats[1].negative_excluded and not stats[2].negative_excluded
    filtered = search(q, df, vec, index, where={"source_id": "none"}).results
    assert filtered.count() == 0
