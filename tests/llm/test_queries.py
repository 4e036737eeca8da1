"""The queries against their SQL, and the pipeline stage by stage."""

import ast
import collections
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from loomtext.llm import entries, near_dup, quality
from loomtext.llm.common import table
from tests.llm.test_ops import base_by_hand, brute_links
from tests.test_catalog import DATA, TABLES, rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_against_sql(spark, duck, name):
    got = entries.QUERIES[name](spark, str(DATA))
    want = duck.sql(entries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_near_and_quality_on_driver_rows(spark):
    docs = table(spark, str(DATA), "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    links, root = brute_links(texts)
    got = {r.doc_id: r for r in entries.op2_near_dup(spark, str(DATA)).collect()}
    assert all((got[d].n_links, got[d].class_id) == (links[i], texts[root[i]][0]) for i, (d, _) in enumerate(texts))
    labels = {r.doc_id: r for r in table(spark, str(DATA), "labels").collect()}
    for r in entries.op9_quality_llr(spark, str(DATA)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(dict(texts)[r.doc_id])
        if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed:
            assert r.kept


def test_pipeline(spark):
    d = str(DATA)
    docs = table(spark, d, "documents")
    names = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, d)
    verdict = quality.judge(docs, entries.trusted_ids(table(spark, d, "labels")))
    assert good.columns == names and {r.doc_id for r in good.collect()} == {r.doc_id for r in verdict.where("kept").collect()}
    once = stages[1](spark, good, d)
    by = collections.defaultdict(list)
    for r in good.collect():
        by[r.text].append(r.doc_id)
    kept = {r.doc_id for r in once.collect()}
    assert once.columns == names and kept == {max(v) for v in by.values()}
    near = stages[2](spark, once, d)
    left = sorted(kept)
    _, root = brute_links([(i, texts[i]) for i in left])
    ids = {r.doc_id for r in near.collect()}
    assert near.columns == names and ids == {left[r] for r in root}
    mixed = stages[3](spark, near, d)
    assert mixed.columns == names and {r.doc_id for r in mixed.collect()} == ids
    packed = stages[4](spark, mixed, d).collect()
    assert len(packed) == mixed.count() and all(r.padding >= 0 for r in packed)
    out = corpus_pipeline.run(spark, d)
    assert out.count() == len(packed)
    assert near_dup.near_groups(near).where("n_links > 0").count() == 0


def imports_of(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (f"{node.module or ''}.{a.name}" for a in node.names)


def test_library_does_not_need_this_subpackage():
    root = Path(entries.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if root / "llm" not in p.parents:
            assert not [name for name in imports_of(p) if "llm" in name.split(".")], p
