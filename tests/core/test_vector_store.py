"""The table of vectors: which files an upsert touches, which record stays, and what a stopped upsert leaves."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import scratch, vector_store as store

SCHEMA = "id string, document string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def put(spark, path, rows, version=0, **how):
    store.upsert(frame(spark, rows), path, version, SCHEMA, 64, **how)


def all_rows(spark, path):
    return sorted((r.id, r.document, r.version) for r in store.read(spark, path, SCHEMA).collect())


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_changed_buckets_are_touched(spark, tmp_path):
    path = tmp_path / "v"
    rows = [(f"doc{i // 4}#{i % 4}", f"text {i}") for i in range(1000)]
    put(spark, str(path), rows)
    before = files(path)
    assert len({p.parent for p in before}) > 55
    changed = [(f"doc{i}#{k}", "new") for i in (3, 70) for k in range(4)] + [("doc9999#0", "added")]  # of a hundredth of the documents
    put(spark, str(path), changed, 1)
    after = files(path)
    own = {f"bucket={r[0]}" for r in frame(spark, changed).select(store._bucket(F.col("id"), 64)).distinct().collect()}
    assert len(own) <= 3
    assert {p for p in before if p.parent.name not in own} == {p for p in after if p.parent.name not in own}
    assert all(after[p] == before[p] for p in before if p.parent.name not in own)
    want = dict(rows) | dict(changed)
    assert {i: d for i, d, _ in all_rows(spark, str(path))} == want


def test_the_largest_version_stays(spark, tmp_path):
    path = str(tmp_path / "v")
    put(spark, path, [("a#0", "one"), ("b#0", "one"), ("c#0", "x"), ("c#0", "y")], 5)
    put(spark, path, [("a#0", "late"), ("b#0", "late")], 4)
    put(spark, path, [("b#0", "again")], 5)
    assert all_rows(spark, path) == [("a#0", "one", 5), ("b#0", "again", 5), ("c#0", "y", 5)]
    store.upsert(frame(spark, [("a#0", "own"), ("d#0", "own")]), path, F.length("id") + 4, SCHEMA, 64)
    assert [r for r in all_rows(spark, path) if r[1] == "own"] == [("a#0", "own", 7), ("d#0", "own", 7)]
    put(spark, path, [], 9)
    assert len(all_rows(spark, path)) == 4


def test_stamps(spark, tmp_path):
    path = str(tmp_path / "v")
    day = lambda n: F.lit(datetime.datetime(2024, 1, n))
    put(spark, path, [("a#0", "x"), ("b#0", "x")], 1, at=day(1))
    put(spark, path, [("a#0", "y")], 2, at=day(2))
    got = {r.id: (r.created_at.day, r.updated_at.day) for r in store.read(spark, path, SCHEMA).collect()}
    assert got == {"a#0": (1, 2), "b#0": (1, 1)}


@pytest.mark.parametrize("when", ["while beside", "while in place"])
def test_a_stopped_upsert_loses_nothing(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path / "v")
    put(spark, path, [(f"doc{i}#0", "old") for i in range(50)])
    keep = store._apply

    def stopped(spark_, path_, schema):
        if when == "while in place":  # the old bucket is gone, the new one not there
            for p in list((tmp_path / "v").glob("bucket=*"))[:5]:
                scratch.discard(spark_, str(p))
        else:
            (tmp_path / "v__pending" / "_SUCCESS").unlink()
        raise InterruptedError

    monkeypatch.setattr(store, "_apply", stopped)
    with pytest.raises(InterruptedError):
        put(spark, path, [(f"doc{i}#0", "new") for i in range(50)], 1)
    monkeypatch.setattr(store, "_apply", keep)
    assert {r[1] for r in all_rows(spark, path)} == {"old" if when == "while beside" else "new"} and len(all_rows(spark, path)) == 50
    assert not (tmp_path / "v__pending").exists()


def test_lookup_and_delete(spark, tmp_path):
    path = tmp_path / "v"
    put(spark, str(path), [(f"doc{i // 2}#{i % 2}", str(i)) for i in range(200)])
    found = store.lookup(spark, str(path), ["doc7#1", "doc9#0", "no#0"], SCHEMA, 64)
    assert sorted(r.id for r in found.collect()) == ["doc7#1", "doc9#0"]
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    gone = spark.createDataFrame([("doc7",), ("doc8",), ("nothing",)], "document string")
    store.delete(spark, str(path), gone, SCHEMA, 64)
    assert len(all_rows(spark, str(path))) == 196
    store.delete(spark, str(path), spark.createDataFrame([(f"doc{i}",) for i in range(100)], "document string"), SCHEMA, 64)
    assert all_rows(spark, str(path)) == []


def test_reading_shuffles_nothing(spark, tmp_path):
    put(spark, str(tmp_path / "v"), [("a#0", "x")])
    assert "Exchange" not in store.read(spark, str(tmp_path / "v"), SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert store.read(spark, str(tmp_path / "none"), SCHEMA).collect() == []
