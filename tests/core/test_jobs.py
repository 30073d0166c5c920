"""Streams with state, text files, batched models and observed metrics: what is stopped, replayed, loaded and padded."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import conversion, inference, retrieval
from corpusloom.sources import files, page_files
from corpusloom.streaming import conversations, ingest

LOG = "k long, seq long, title string"


def put(spark, path, rows):
    spark.createDataFrame(rows, f"{LOG}, deleted boolean").coalesce(1).write.mode("append").parquet(path)


def kept(spark, path):
    return sorted(tuple(r) for r in conversations.latest(spark, path, LOG).collect())


def test_stream_keeps_the_latest(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    take = lambda **how: conversations.keep_latest(spark, source, target, marks, LOG, "k", files=1, **how)
    put(spark, source, [(1, 1, "a", None), (1, 3, "c", None), (1, 2, "b", None), (2, 1, "x", False), (3, 1, "z", False)])
    take()
    assert kept(spark, target) == [(1, 3, "c"), (2, 1, "x"), (3, 1, "z")]
    # A deletion clears, a later entry starts anew, an older one changes nothing.
    put(spark, source, [(2, 2, None, True), (3, 2, None, True), (3, 3, "again", False), (1, 2, "late", False)])
    take()
    assert kept(spark, target) == [(1, 3, "c"), (3, 3, "again")]
    take()
    assert kept(spark, target) == [(1, 3, "c"), (3, 3, "again")]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    r, want, seq = random.Random(2), {}, 0
    for _ in range(4):
        rows = []
        for _ in range(60):
            seq += 1
            k, gone = r.randrange(20), r.random() < 0.15
            rows.append((k, seq, None if gone else f"t{seq}", gone))
            if gone:
                want.pop(k, None)
            else:
                want[k] = (k, seq, f"t{seq}")
        put(spark, source, rows)
    with pytest.raises(Exception, match="stopped before batch 2"):
        conversations.keep_latest(spark, source, target, marks, LOG, "k", files=1, batches=2)
    some = kept(spark, target)
    assert some and some != sorted(want.values())
    conversations.keep_latest(spark, source, target, marks, LOG, "k", files=1)
    assert kept(spark, target) == sorted(want.values())


def test_pages_are_written_whole(spark, tmp_path):
    texts = {"a/b/One.md": "# ä😀\n", "a/Two.md": "", "Three.md": "x" * 70_000, "b/One.md": "\r\nnot the other"}
    df = spark.createDataFrame(list(texts.items()), "name string, markdown string").repartition(3)
    page_files.write_pages(df, f"{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*.md")}
    assert found == texts
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["Three.md", "_SUCCESS", "a", "b"]
    back = files.read_texts(spark, f"{tmp_path}/out", ("md",), recursive=True)
    assert sorted(r.text for r in back.collect()) == sorted(t for t in texts.values() if t)
    with pytest.raises(FileExistsError):
        page_files.write_pages(df, f"{tmp_path}/out")


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    good = spark.range(40).select(F.concat(F.lit("p"), "id", F.lit(".md")).alias("name"), F.lit("x").alias("markdown"))
    for bad in ("../out.md", "", None):
        df = good.union(spark.createDataFrame([(bad, "x")], "name string, markdown string"))
        with pytest.raises(Exception, match="no file can be written"):
            page_files.write_pages(df, f"{tmp_path}/out")
        assert not (tmp_path / "out").exists() and not (tmp_path / "out.md").exists()


def test_a_killed_task_leaves_no_file(spark, tmp_path):
    """A task that dies between two files has moved none to its place."""
    import pyarrow as pa

    writer = page_files.PageWriter(str(tmp_path / "out"))

    def dying():
        yield pa.RecordBatch.from_arrays([pa.array(["a.md", "b.md"]), pa.array(["x", "y"])], ["name", "markdown"])
        raise InterruptedError

    with pytest.raises(InterruptedError):
        writer.write(dying())
    assert not list((tmp_path / "out").glob("*.md"))
    # Its second attempt writes all; the first one's leftovers go with the job's end.
    done = writer.write(iter([pa.RecordBatch.from_arrays([pa.array(["a.md", "b.md"]), pa.array(["x", "y"])], ["name", "markdown"])]))
    writer.commit([done, None])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "a.md", "b.md"]


def counted(path):
    """A model that notes when it is loaded and what it is given: the length of each text, in tenths."""

    def make():
        with open(f"{path}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(rows):
            lengths = [len(t or "") for (t,) in rows]
            with open(f"{path}/runs", "a") as f:
                f.write(f"{len(rows)} {max(lengths) * len(lengths) - sum(lengths)} {sum(lengths)}\n")
            return [[n / 10, 1.0] for n in lengths]

        return model

    return make


def test_models_are_loaded_once_and_pad_little(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, None if i % 50 == 0 else "x" * r.choice((1, 5, 40, 300, 900)), i * 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, content string, other long").repartition(16).persist()
    order = [x.id for x in df.collect()]
    out = inference.predict(df, counted(tmp_path), ["content"], "e", "array<float>", key=str(tmp_path), batch=32, rows_at_once=500)
    got = out.collect()
    assert [x.id for x in got] == order and out.columns == ["id", "content", "other", "e"]
    assert all(x.e == pytest.approx([len(x.content or "") / 10, 1.0]) and x.other == 2 * x.id for x in got)
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) <= 8  # one a worker process, though there are sixteen tasks
    runs = [tuple(map(int, line.split())) for line in (tmp_path / "runs").read_text().splitlines()]
    assert max(n for n, *_ in runs) == 32 and sum(n for n, *_ in runs) == 2000
    assert sum(pad for _, pad, _ in runs) < 0.35 * sum(size for *_, size in runs)


def test_ingestion_and_reranking_by_a_model(spark, tmp_path):
    docs = spark.createDataFrame([("d1", " ".join(f"w{i}" for i in range(900))), ("d2", "few words " * 40)], "source_file string, text string")
    records = ingest.embedded(docs, model=counted(tmp_path), key=f"{tmp_path}/e").collect()
    assert records and all(x.embedding == pytest.approx([len(x.document) / 10, 1.0]) for x in records)
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two"), ("c", None)], "id string, content string")
    asked = spark.createDataFrame([(1, "two"), (2, "one")], "query_id long, query string")
    ranks = spark.createDataFrame([(q, i, n) for q in (1, 2) for n, i in enumerate("abc")], "query_id long, id string, rank long")

    def overlap():
        return lambda rows: [float(len({*(q or "").split()} & {*(c or "").split()})) - len(c or "") / 100 for q, c in rows]

    got = retrieval.rerank_with(ranks, chunks, asked, overlap, 2, key=f"{tmp_path}/r").collect()
    assert sorted((x.query_id, x["rank"], x.id) for x in got) == [(1, 0, "b"), (1, 1, "a"), (2, 0, "a"), (2, 1, "c")]


def test_no_texts_and_bad_models(spark):
    none = spark.createDataFrame([], "id long, content string")
    assert inference.predict(none, lambda: len, ["content"], "e", "int", key="none").collect() == []
    with pytest.raises(Exception, match="one result for each text"):
        inference.predict(none.union(spark.createDataFrame([(1, "x")], none.schema)), lambda: (lambda rows: []), ["content"], "e", "int", key="bad").collect()


def test_metrics_come_from_the_job_that_writes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "---++ Oak\n"), (2, None), (3, "x %A_B{%"), (4, "<nop x")], "doc_id long, text string")
    got = conversion.write_observed(docs, f"{tmp_path}/out")
    want = conversion.summary(conversion.convert_all(docs)).first().asDict()
    assert {k: got[k] for k in want} == want
    assert got["rule:Headings converted"] == 1 and got["seconds"] > 0 and got["per_second"] > 0
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 4 and got["output_bytes"] == back.agg(F.sum("output_size")).first()[0]
    assert conversion.write_observed(docs.where("false"), f"{tmp_path}/none")["success_rate"] is None
