"""Cleaning, splitting, merging and numbering, against values worked out by hand, and what must always hold."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import clean, split
from corpusloom.functions.text import estimate_tokens, lexical_tokens
from corpusloom.operators import chunking

RED, GREEN = "\U0001f534", "\U0001f7e2"


def words(n, w="w"):
    return " ".join(f"{w}{i}" for i in range(n))


def one(spark, text, how):
    return spark.createDataFrame([(text,)], "t string").select(how(F.col("t")).alias("x")).first().x


def pairs(found):
    return [(s.heading, s.content) for s in found]


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (38, 49), (39, 50), (308, 400), (309, 401)])
def test_tokens(spark, n, want):
    assert one(spark, words(n), estimate_tokens) == want


def test_lexical(spark):
    assert one(spark, "CMSSW_14_0_X é __a Run", lexical_tokens) == ["cmssw_14_0_x", "cmssw", "14", "0", "x", "__a", "a", "run"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\r\nb\rc", "a\nb\nc"), ("x<br/>y", "x\ny"), ("<p class='a'>in</p> <SPAN>s</SPAN> <a href=x>l</a>", "in s l"), ("<!-- gone\n -->k", "k"), ("a &lt;b&gt; &amp;lt; &#12;c", "a <b> &lt; c"),
        ("a\n\n\n\nb  \n", "a\n\nb"), ("a < b and c > d", "a  d"), ('x " hideimgleft="" }% y', "x y"), ("<center>m</center><img src=q>", "m"),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, text, clean.clean_text) == want


def test_signature(spark):
    text = "Body\n-- Ann Lee, 23 Jul 2009\nmore\n— Bob - 2023\n"
    got = one(spark, text, clean.signature)
    assert (got.author, got.date) == ("Bob", "2023")
    assert one(spark, text, clean.without_signatures).split() == ["Body", "more"]
    assert tuple(one(spark, "none", clean.signature)) == ("", "")


def test_filter_and_type(spark):
    rows = [("short", "tiny"), ("links", "\n".join(["https://e.org/x see"] * 12) + "\n" + words(40)), ("kept", words(60)), ("table", "\n".join(["| a | b |"] * 4)), ("qa", f"{RED}{GREEN}{RED}{GREEN} " + words(60)), ("log", "\n".join(["long enough text with words https://e.org/x and more words here"] * 12))]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("c", clean.clean_text(F.col("t"))).withColumn("p", clean.plain_text(F.col("c")))
    got = {r.k: (r.reason, r.kind) for r in df.select("k", clean.filter_reason(F.col("t"), F.col("p")).alias("reason"), clean.content_type(F.col("c"), F.col("p")).alias("kind")).collect()}
    assert got["short"] == ("insufficient_content (4 chars)", "minimal")
    assert got["links"][0] == "mostly_links (92% link-only lines)"
    assert got["kept"] == (None, "technical") and got["table"][1] == "table" and got["qa"][1] == "qa" and got["log"] == (None, "meeting_log")


def test_headings(spark):
    assert pairs(one(spark, "intro\n# A\n\nbody\n## B\n### C\nend", split.split_by_headings)) == [("", "intro"), ("A", "body"), ("B", ""), ("C", "end")]
    assert pairs(one(spark, "no heading", split.split_by_headings)) == [("", "no heading")]
    assert pairs(one(spark, "", split.split_by_headings)) == [("", "")]


def test_questions(spark):
    text = f"before\n{RED} q1\n{GREEN} a1\n{RED} q2\n# H\n# I\n{RED} q3\nx\n{RED} q4"
    assert pairs(one(spark, text, split.split_qa)) == [("", f"before\n{RED} q1\n{GREEN} a1"), ("", f"{RED} q2"), ("I", f"{RED} q3\nx"), ("I", f"{RED} q4")]


def test_paragraphs(spark):
    a, b, c = words(200, "a"), words(100, "b"), words(50, "c")
    assert one(spark, f"{a}\n\n{b}\n\n{c}", split.split_paragraphs) == [f"{a}\n\n{b}", c]
    lines = "\n".join([a, b, c])
    assert one(spark, f"{c}\n\n{lines}\n\n{c}", split.split_paragraphs) == [c, f"{a}\n\n{b}", c, c]
    long = words(700)
    w = long.split()
    assert one(spark, long, split.split_paragraphs) == [" ".join(w[:307]), " ".join(w[307:614]), " ".join(w[614:])]
    said = words(200, "s") + ". " + words(200, "t") + "."
    assert one(spark, said, split.split_paragraphs) == [words(200, "s") + ".", words(200, "t") + "."]
    assert one(spark, " ", split.split_paragraphs) == []
    # A large part stands alone: nothing is joined to its last piece.
    assert one(spark, f"{long}\n\n{c}", split.split_paragraphs) == [" ".join(w[:307]), " ".join(w[307:614]), " ".join(w[614:]), c]


def merged(spark, items):
    df = spark.createDataFrame([([{"heading": h, "content": c} for h, c in items],)], split.SECTIONS.join(["x ", ""]))
    return pairs(df.select(split.merge_tiny(F.col("x")).alias("m")).first().m)


def test_merge_tiny(spark):
    t, m, f = words(10), words(100), words(305)
    assert merged(spark, [("A", m), ("B", t), ("C", m)]) == [("A", f"{m}\n\n{t}"), ("C", m)]
    assert merged(spark, [("A", t), ("B", m)]) == [("A", f"{t}\n\n{m}")]
    assert merged(spark, [("", t), ("B", m)]) == [("B", f"{t}\n\n{m}")]
    assert merged(spark, [("A", f), ("B", t), ("C", f)]) == [("A", f), ("B", t), ("C", f)]
    assert merged(spark, [("A", f), ("B", t), ("C", m)]) == [("A", f), ("B", f"{t}\n\n{m}")]
    assert merged(spark, [("A", t), ("B", " "), ("C", t)]) == [("A", f"{t}\n\n{t}")]
    assert merged(spark, []) == []


def test_overlap_and_cap(spark):
    a, b = words(50, "a"), words(38, "b")
    df = spark.createDataFrame([([{"heading": "A", "content": a}, {"heading": "B", "content": b}, {"heading": "C", "content": "c"}],)], split.SECTIONS.join(["x ", ""]))
    got = df.select(split.add_overlap(F.col("x")).alias("o"), split.hard_cap(F.array(F.struct(F.lit("H").alias("heading"), F.lit(words(800)).alias("content")))).alias("h")).first()
    assert pairs(got.o) == [("A", a), ("B", " ".join(a.split()[-38:]) + "\n\n" + b), ("C", "c")]
    assert [(s.heading, len(s.content.split())) for s in got.h] == [("H", 393), ("H (cont.)", 393), ("H (cont.)", 14)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("source_file"), "text")


def test_chunks_hold(spark, documents):
    prepared = chunking.prepare(documents)
    chunks = chunking.chunk(prepared).cache()
    rows = chunks.collect()
    assert rows and all(0 < r.estimated_tokens <= 449 and r.char_count == len(r.content) and r.content == r.content.strip() for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source_file, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own))) and {r.total_chunks for r in own} == {len(own)}
    ids = chunking.with_ids(chunks).collect()
    assert [r.id for r in sorted(ids, key=lambda r: (r.source_file, r.chunk_index))] == [f"chunk_{i}" for i in range(len(rows))]
    kept = {r.source_file for r in prepared.where("reason is null").collect()}
    assert kept == set(by)
    stats = chunking.size_stats(chunks).first()
    sizes = sorted(r.estimated_tokens for r in rows)
    assert (stats.n, stats.min_tokens, stats.median_tokens, stats.max_tokens, stats.over_limit) == (len(sizes), sizes[0], sizes[len(sizes) // 2], sizes[-1], 0)
    assert {r.bucket: r.n for r in chunking.size_histogram(chunks).collect()}["512+"] == 0
    assert sum(r.num_chunks for r in chunking.file_summary(prepared, chunks).collect()) == len(rows)
    counts = chunking.corpus_counts(prepared, chunks).first()
    assert counts.n_chunks == len(rows) and counts.n_files == documents.count() and counts.n_chunked == len(kept)
    kinds = {r.issue_type for r in chunking.issues(prepared, chunks).collect()}
    assert "no_headings" in kinds and "large_chunk" not in kinds
    assert all(len(r.preview) <= 200 and "\n" not in r.preview for r in chunking.chunk_report(chunks).collect())
    assert chunking.largest_document(chunks).first().n == max(map(len, by.values()))


def test_nothing_moves(documents):
    plan = chunking.chunks_of(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "<b></b>" * 30), (4, words(50_000)), (5, "-- Ann, 2020\n" + words(60))]
    got = {r.source_file: r for r in chunking.prepare(spark.createDataFrame(rows, "source_file long, text string")).collect()}
    assert got["1"].reason == "insufficient_content (0 chars)" and got["2"].reason and got["3"].reason
    assert got["5"].author == "Ann" and got["5"].date == "2020"
    chunks = chunking.chunks_of(spark.createDataFrame(rows, "source_file long, text string"))
    assert chunks.where("source_file = '4'").count() == -(-50_000 // 307)
    assert chunking.chunks_of(spark.createDataFrame(rows[:3], "source_file long, text string"), no_filter=True).count() == 0
    assert chunking.chunks_of(spark.createDataFrame([], "source_file long, text string")).count() == 0
