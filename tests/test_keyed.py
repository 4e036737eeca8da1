"""Collections in key buckets: touched buckets only, racing writers, snapshots by content, commits that embed only what is new."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.operators import lifecycle, segments
from loomtext.operators.keyed import KeyedStore, bucket, bucket_of
from loomtext.plans import engine
from loomtext.plans.commit import commit
from loomtext.settings import Settings, WriteRefused
from loomtext.sources.ledger import Ledger

OPEN = Settings(dimension=2, writes_enabled=True, disk_floor_gb=0.0)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, t string")


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_buckets_agree(spark):
    ids = ["a", "", "ü 😀", "x" * 50]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", bucket(F.col("id"), 7).alias("b")).collect()
    assert {r.id: r.b for r in got} == {i: bucket_of(i, 7) for i in ids}


def test_touched_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", OPEN, buckets=8)
    with pytest.raises(LookupError):
        store.read("chunks")
    store.create("chunks", rows(spark, *[(f"k{i}", "old") for i in range(100)], (None, "null key")))
    with pytest.raises(WriteRefused):
        store.create("chunks", rows(spark, ("a", "b")))
    before = store.ledger("chunks").read()[1]["folders"]
    store.add("chunks", rows(spark, ("k3", "new"), ("k3", "newer"), ("n1", "new")))
    after = store.ledger("chunks").read()[1]["folders"]
    assert {int(b) for b in after if after[b] != before.get(b)} == {bucket_of("k3", 8), bucket_of("n1", 8)}
    want = {f"k{i}": "old" for i in range(100)} | {"k3": "newer", "n1": "new", None: "null key"}
    assert dict(listed(store.read("chunks"))) == want
    folders = store._rows("chunks", store.ledger("chunks").read()[1], {bucket_of("k3", 8)}).inputFiles()
    assert listed(store.fetch("chunks", ["k3", "zz"])) == [("k3", "newer")] and all(f"__b={bucket_of('k3', 8)}/" in f for f in folders)
    store.remove("chunks", ["k1", "k2"])
    last = store.ledger("chunks").read()[1]["folders"]
    assert {int(b) for b in after if last.get(b) != after[b]} == {bucket_of("k1", 8), bucket_of("k2", 8)}
    del want["k1"], want["k2"]
    assert dict(listed(store.read("chunks"))) == want and store.read("chunks", 1).count() == 101 and store.versions("chunks") == [1, 2, 3]
    for gone in ([], ["k1"]):
        with pytest.raises(WriteRefused):
            store.remove("chunks", gone)
    store.merge("chunks", rows(spark, ("k5", "merged")), rows(spark, ("k6", "")).select("id"))
    assert {r.id for r in store.read("chunks").collect()} == set(want) - {"k6"}


def test_deltas_lie_on_top_and_are_folded_in(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomtext.operators.keyed.MOST_DELTAS", 2)
    store = KeyedStore(spark, f"file://{tmp_path}/s", OPEN, buckets=2)
    want = {}
    for step in range(6):
        part = {f"k{i}": f"{step}" for i in range(step, step + 4)}
        store.delta("chunks", rows(spark, *part.items()))
        want |= part
        assert dict(listed(store.read("chunks"))) == want
    assert max(len(w) for w in store.ledger("chunks").read()[1]["folders"].values()) <= 4
    wider = rows(spark, ("k0", "w")).withColumn("extra", F.lit(1))
    store.delta("chunks", wider)
    assert store.read("chunks").where("extra = 1").count() == 1 and store.read("chunks").count() == len(want)


def test_racing_writers(spark, tmp_path):
    path, errors = f"file://{tmp_path}/s", []
    KeyedStore(spark, path, OPEN, buckets=2).create("chunks", rows(spark, ("a", "0")))

    def write(i):
        try:
            store = KeyedStore(spark, path, OPEN)
            store.add("chunks", rows(spark, (f"w{i}", str(i))))
            store.delta("chunks", rows(spark, (f"d{i}", str(i))))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = {r.id for r in KeyedStore(spark, path, OPEN).read("chunks").collect()}
    assert not errors and got == {"a", *(f"{k}{i}" for k in "wd" for i in range(3))}
    assert len(Ledger(spark, f"{path}/chunks").versions()) == 7


def test_snapshots_are_checked_by_content(spark, tmp_path):
    df = rows(spark, *[(f"k{i}", "x" * i) for i in range(50)]).repartition(3)
    about = lifecycle.snapshot(df, f"file://{tmp_path}/a")
    assert about["rows"] == 50 and listed(lifecycle.restore(spark, f"file://{tmp_path}/a")) == listed(df)
    # A pair of equal rows more changes the digest, which sums forgive nothing.
    assert lifecycle.digest(df)[1] != lifecycle.digest(df.unionByName(rows(spark, ("k", "k"), ("k", "k"))))[1]
    files = sorted(p for p in (Path(tmp_path) / "a" / "rows").iterdir() if p.name.endswith(".parquet"))
    first, second = files[0].read_bytes(), files[1].read_bytes()
    bad = lambda: sorted(r.error for r in lifecycle.damaged(spark, f"file://{tmp_path}/a").collect())
    drop = lambda p: (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    [drop(p) for p in files]
    files[0].write_bytes(first[:40] + bytes([first[40] ^ 1]) + first[41:])
    assert bad() == ["altered"]
    files[0].write_bytes(second)
    files[1].write_bytes(first)
    assert bad() == ["altered", "altered"]
    files[1].unlink()
    files[0].write_bytes(first)
    assert bad() == ["missing"]
    with pytest.raises(RuntimeError, match="BACKUP_FAILED"):
        lifecycle.restore(spark, f"file://{tmp_path}/a")


def counting(folder):
    def embedder(texts):
        with open(folder, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    return embedder


def chunk(i, text, title="t"):
    return (f"{i:016x}_{i}", text, "s", "s/f.md", "style_rule", i, text[:20], None, None, len(text), "MIT", title)


CHUNK = "id string, text string, source_id string, source_path string, doc_type string, chunk_index long, fingerprint string, chunk_prev_id string, chunk_next_id string, token_count int, license string, source_title string"


def test_commit_embeds_and_indexes_only_what_is_new(spark, tmp_path):
    store, folder, log = KeyedStore(spark, f"file://{tmp_path}/s", OPEN, buckets=8), f"file://{tmp_path}/runs", tmp_path / "seen"
    make = lambda *r: spark.createDataFrame([chunk(*x) for x in r], CHUNK)
    first = [(i, f"text number {i} of many") for i in range(40)]
    done = commit(store, make(*first), OPEN, counting(log), folder, confirm=True)
    assert (done.written, done.changed, done.embedded, done.lexical_count) == (40, 40, 40, 40) and len(log.read_text().splitlines()) == 40
    second = [*first[2:], (7, "seven is new", "t"), (50, "fifty is new"), (8, first[8][1], "renamed")]
    second = [x for x in second if x not in (first[7], first[8])]
    done = commit(store, make(*second), OPEN, counting(log), folder, confirm=True, delete_stale=True)
    assert (done.written, done.changed, done.embedded, done.deleted, done.collection_count, done.lexical_count) == (39, 3, 2, 2, 39, 39)
    assert sorted(log.read_text().splitlines()[40:]) == ["fifty is new", "seven is new"]
    kept = {r.id: r for r in store.read("chunks").collect()}
    assert kept[chunk(8, "")[0]].source_title == "renamed" and kept[chunk(8, "")[0]].embedding == [float(len(first[8][1])), 1.0] and kept[chunk(7, "")[0]].embedding == [12.0, 1.0]
    index, error = segments.open_index(spark, done.index_path)
    df = {r.term: r.df for r in index.term_stats.collect()}
    assert error is None and df["fifty"] == df["seven"] == 1 and df["number"] == 37 and "0" not in df
    q = spark.createDataFrame([(1, "new seven")], "query_id int, query string")
    assert index.topk(q, 3).orderBy("lexical_rank").first().chunk_id == chunk(7, "")[0]
    assert done.backup["rows"] == 40 and commit(store, make(*second), OPEN, counting(log), folder, confirm=True).changed == 0


def test_feedback_and_rewrite_with_context(spark, tmp_path):
    store, folder = KeyedStore(spark, f"file://{tmp_path}/s", OPEN, buckets=4), f"file://{tmp_path}/runs"
    wanted = spark.createDataFrame([chunk(i, f"sentence rhythm number {i}") for i in range(6)], CHUNK)
    e = engine.Engine(spark, wanted.limit(0), spark.createDataFrame([], "chunk_id string, embedding array<float>"), None, OPEN, store, counting(tmp_path / "seen"), folder)
    engine.call(e, "reindex", wanted=wanted, dry_run=False, confirm=True)
    asked = spark.createDataFrame([(chunk(1, "")[0], "useful", "good"), (chunk(2, "")[0], "odd", ""), ("x", "wrong", "")], "chunk_id string, verdict string, note string").withColumn("recorded_at", F.lit("2024-01-02").cast("timestamp"))
    assert engine.call(e, "feedback", requests=asked, confirm=True).where("error is null").count() == 1
    assert [(r.about_chunk_id, r.verdict) for r in store.read("feedback").collect()] == [(chunk(1, "")[0], "useful")] and store.read("chunks").count() == 6
    pairs = spark.createDataFrame([(1, "Pay $5 on May 5th.", "Pay $5 on May 5th, please."), (2, "Pay $5.", "Pay $6."), (3, " ", "x"), (4, "y" * 8001, "z")], "query_id long, source string, rewrite string")
    got = engine.call(e, "rewrite", pairs=pairs, context=True, target="warm")
    assert {r.query_id: r.error for r in got.pairs.collect()} == {1: None, 2: None, 3: "INVALID_PARAMS", 4: "TEXT_TOO_LONG"}
    assert {r.query_id for r in got.guidance.context.collect()} == {1, 2} and got.guidance.citations.count() > 0
