"""Retrieval, logs, files and ingestion on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import logs, retrieval as r, tiles
from corpusloom.sources import files
from corpusloom.streaming import ingest

CHUNKS = "id string, seq long, source_file string, chunk_index long, page_title string, section_heading string, date string, author string, content string"


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["alpha beta", "beta gamma", "gamma delta", "delta alpha_beta", "other words", "alpha alpha alpha"]
    return spark.createDataFrame([(f"chunk_{i}", i, f"f{i // 3}", i % 3, f"P{i}", "S" if i % 2 else "", "2020" if i == 0 else "", "", t) for i, t in enumerate(texts)], CHUNKS)


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, rank long")


def test_bm25(spark, chunks):
    q = spark.createDataFrame([(1, "gamma"), (2, "nothing here"), (3, "alpha_beta")], "query_id long, query string")
    got = {}
    for x in sorted(r.bm25(chunks, q).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.id)
    assert 2 not in got and got[3][0] == "chunk_3"
    assert set(got[1]) == {"chunk_1", "chunk_2"}


def test_rrf(spark):
    a, b = ranks(spark, [(1, "x", 0), (1, "y", 1)]), ranks(spark, [(1, "y", 0), (1, "z", 1)])
    got = [(x.id, x.score) for x in sorted(r.rrf(a, b).collect(), key=lambda x: x.rank)]
    assert [g[0] for g in got] == ["y", "x", "z"] and got[0][1] == pytest.approx(1 / 61 + 1 / 62)
    same = ranks(spark, [(1, "p", 0)]), ranks(spark, [(1, "q", 0)])
    assert [x.id for x in sorted(r.rrf(*same).collect(), key=lambda x: x.rank)] == ["p", "q"]
    assert [x.id for x in sorted(r.rrf(*reversed(same)).collect(), key=lambda x: x.rank)] == ["q", "p"]


def test_expand(spark, chunks):
    hits = spark.createDataFrame([(1, "chunk_1", 0, 1.0), (1, "chunk_2", 1, 0.5), (1, "chunk_3", 2, 0.1)], "query_id long, id string, rank long, score double")
    got = {x.id: x.text for x in r.expand(chunks, hits).collect()}
    # chunk_2 is spliced by the better hit and still stands itself; its own neighbour is a better hit, so it is not spliced.
    assert got == {"chunk_1": "alpha beta\nbeta gamma\ngamma delta", "chunk_2": "gamma delta", "chunk_3": "other words\ndelta alpha_beta"}


def test_context(spark):
    shape = "query_id long, rank long, id string, score double, text string, page_title string, section_heading string, source_file string, date string, author string"
    rows = [(1, 0, "a", 1.0, "x" * 9000, "T", "H", "f", "2020", ""), (1, 1, "b", 0.5, "y" * 6000, "U", "", "f", "", ""), (1, 2, "c", 0.2, "z", "V", "", "f", "", ""), (2, 0, "d", 1.0, "w" * 15000, "T", "", "f", "", ""), (3, 0, "e", 1.0, "one", "T", "", "f", "", ""), (3, 1, "f", 0.9, "two", "U", "", "f", "", "")]
    got = {x.query_id: x for x in r.build_context(spark.createDataFrame(rows, shape)).collect()}
    assert got[1].context == "[1] T - H (last modified 2020)\n" + "x" * 9000 and [s.id for s in got[1].sources] == ["a"]
    assert got[2].context == "" and got[2].sources == []
    assert got[3].context == "[1] T\none\n\n---\n\n[2] U\ntwo"
    asked = r.prompts(r.build_context(spark.createDataFrame(rows, shape)), spark.createDataFrame([(3, "why?")], "query_id long, query string"), "Be brief.").first()
    assert asked.messages[0].content == "Be brief."
    assert asked.messages[1].content == "Sources:\n\n[1] T\none\n\n---\n\n[2] U\ntwo\n\nQuestion: why?"
    assert r.answer(spark.createDataFrame([asked]), lambda m: F.upper(m[1]["content"])).first().answer.startswith("SOURCES")
    with pytest.raises(ValueError):
        r.prompts(None, None, "", temperature=3)


def test_hash_embed(spark):
    v = spark.createDataFrame([("a b c",), ("",), ("a b c",)], "t string").select(r.hash_embed(F.col("t")).alias("v")).collect()
    assert v[0].v == v[2].v and sum(x * x for x in v[0].v) == pytest.approx(1) and set(v[1].v) == {0.0}


def test_dense_of_few_and_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 7)
    rows = [(f"v{i}", i, [float((i * k) % 11 - 5) for k in (1, 3, 7)]) for i in range(60)] + [("null", 60, None), ("zero", 61, [0.0] * 3), ("hole", 62, [1.0, None, 2.0]), ("long", 63, [1.0] * 4), ("none", 64, [])]
    v = spark.createDataFrame(rows, "id string, seq long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, -1.0, 0.5]), (3, [1.0] * 4), (4, None)], "query_id long, embedding array<double>")
    few, many = (sorted(tuple(x) for x in r.dense(v, q, k=5, is_few=f).collect()) for f in (True, False))
    assert few == many and {x[0] for x in few} == {1, 2, 3} and [x[1] for x in few if x[0] == 3] == ["long"]
    assert all(sum(x[0] == n for x in few) == 5 for n in (1, 2))


def test_search_follows_a_conversation(spark, chunks):
    q = spark.createDataFrame([(1, "more", [("user", "gamma")]), (2, "more", None)], "query_id long, query string, history array<struct<role:string,content:string>>")
    asked = r.with_history(q)
    assert {x.query_id: x.query for x in asked.collect()} == {1: "[Previous conversation]\nUser: gamma\n\n[Current question]\nmore", 2: "more"}
    found = {x.query_id: x.id for x in r.bm25(chunks, asked).where("rank = 0").collect()}
    assert found[1] in ("chunk_1", "chunk_2") and 2 not in found


def test_postings(spark, chunks):
    got = {(x.id, x.term): (x.tf, x.len) for x in r.postings(chunks).collect()}
    assert got["chunk_5", "alpha"] == (3, 3) and got["chunk_3", "alpha_beta"] == (1, 4) and ("chunk_0", "gamma") not in got
    assert r.postings(chunks.withColumn("content", F.lit(""))).count() == 0


def test_contextual_query(spark):
    df = spark.createDataFrame([(1, [("user", "a" * 301), ("bot", "b")] * 4), (2, []), (3, None)], "k long, h array<struct<role:string,content:string>>")
    got = {x.k: x.q for x in df.select("k", logs.contextual_query(F.lit("now"), F.col("h")).alias("q")).collect()}
    turn = "User: " + "a" * 300 + "...\nAssistant: b"
    assert got[1] == "[Previous conversation]\n" + "\n".join([turn] * 3) + "\n\n[Current question]\nnow"
    assert got[2] == got[3] == "now"


def test_logs(spark):
    log = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "seq long, k string, v long")
    assert {(x.k, x.v) for x in logs.latest(log, "k").collect()} == {("a", 3), ("b", 2)}
    assert {(x.k, x.v) for x in logs.earliest(log, "k").collect()} == {("a", 1), ("b", 2)}
    changed = logs.upsert(log, spark.createDataFrame([(3, "a", 8), (4, "a", 9), (5, "c", 7)], "seq long, k string, v long"), "k")
    assert sorted((x.k, x.v) for x in changed.collect()) == [("a", 9), ("a", 9), ("b", 2), ("c", 7)]
    assert [x.k for x in logs.delete(log, spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
    assert logs.lookup(log, "k", "a").first().v == 1
    empty = logs.feedback_stats(spark.createDataFrame([], "rating string")).first()
    assert (empty.total, empty.up, empty.up_percent) == (0, 0, None)
    times = spark.sql("SELECT timestamp'2020-01-02 12:00:00' n, explode(array(timestamp'2020-01-02 11:59:30', timestamp'2020-01-02 11:30:00', timestamp'2020-01-02 02:00:00', timestamp'2019-12-30 02:00:00')) t")
    assert [x.s for x in times.select(logs.relative_time(F.col("n"), F.col("t")).alias("s")).collect()] == ["Just now", "30 min ago", "10h ago", "2019-12-30"]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "in" / "a.twiki").write_text("x")
    (tmp_path / "in" / "sub" / "C.txt").write_text("y")
    got = files.read_texts(spark, str(tmp_path / "in")).orderBy(*files.page_order()).collect()
    assert [(x.name, x.stem) for x in got] == [("b.txt", "b"), ("a.twiki", "a")] and got[0].text == "caf�"
    assert [x.name for x in files.read_texts(spark, str(tmp_path / "in"), ("txt",), recursive=True).orderBy(*files.name_order()).collect()] == ["b.txt", "C.txt"]
    out = str(tmp_path / "log")
    files.write_jsonl(spark.createDataFrame([("ä", None)], "k string, v string"), out)
    files.write_jsonl(spark.createDataFrame([("b", "1")], "k string, v string"), out, append=True)
    back = files.read_jsonl(spark, out, "k string, v string")
    assert sorted((x.k, x.v) for x in back.collect()) == [("b", "1"), ("ä", None)]
    assert any(json.loads(line) == {"k": "ä", "v": None} for p in (tmp_path / "log").glob("part*") for line in p.read_text().splitlines())
    files.rewrite_jsonl(back.where("k = 'b'"), out)
    assert files.read_jsonl(spark, out, "k string, v string").count() == 1
    # Stopped after the old table went aside, and before the new one took its place: reading settles it.
    (tmp_path / "log").rename(tmp_path / "log__new")
    assert files.read_jsonl(spark, out, "k string, v string").count() == 1 and not (tmp_path / "log__new").exists()


def test_ingest(spark, tmp_path):
    shape = "source_file string, text string"
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    text = " ".join(f"w{i}" for i in range(400))
    spark.createDataFrame([("d1", text)], shape).write.parquet(src)
    ingest.ingest(spark, src, out, mark, shape)
    first = ingest.stored(spark, out).count()
    ingest.ingest(spark, src, out, mark, shape)
    assert ingest.stored(spark, out).count() == first
    spark.createDataFrame([("d2", text), ("d1", "new " + text)], shape).write.mode("append").parquet(src)
    ingest.ingest(spark, src, out, mark, shape)
    rows = {x.id: x for x in ingest.stored(spark, out).collect()}
    assert len(rows) == 2 * first and rows["d1#0"].document.startswith("new ") and rows["d2#0"].metadata.source_file == "d2"
