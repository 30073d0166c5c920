"""SentencePiece, fill-in-the-middle and the audit of filters: odd rows, generated texts, other orders and numbers of filters."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import audit, fim, pieces, queries

SHAPE = "doc_id long, text string, source string"
CLASH = ("id", "ids", "n", "form", "output", "digest", "words", "part", "first", "good", "toxic", "A", "state", "k", "a.b")
LONG = "word éß😀 <P " * 40_000
ROWS = [(1, None, None), (2, "", ""), (None, "a  b\n", "s"), (None, "a  b\n", "s"), (3, LONG, "s"), (3, LONG, "s"), (4, " \n\t ", None), (5, "ÀÉ 😀 <S> word", "s"), (6, "a  b\n", "t"), (7, "a  b\n", "s"), (7, "other <M text", "t"), (8, "Ü" + " AB" * 300 + "  x\x1c", "t"), (9, "#", "s"), (10, "</s> <0x0A> \x00", "u")]


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return pieces.Pieces(f.read())


def odd(spark, rows=ROWS):
    return spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in CLASH})


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_odd_rows(spark):
    docs = [r[:2] for r in ROWS]
    path = queries.tokenizer_path("piece_bpe_32k.model")
    same(pieces.encode_digests(odd(spark), path).collect(), brute.op11(docs, path))
    back = pieces.decode(pieces.encode(odd(spark), path).withColumn("text", F.lit(0)), path)
    same(back.collect(), [(i, t or "") for i, t in docs])
    made = fim.transform(odd(spark))
    same(made.select("*", fim.restored(F.col("output"), F.col("form"))).collect(), brute.op12(docs))
    labels = [(3, 1, 0), (3, 0, 1), (7, None, None), (None, 1, 1), (6, 0, 1), (99, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(3)).withColumn("good", F.lit("x"))
    same(audit.filter_audit(odd(spark), told).collect(), brute.op13([(i, t, s) for i, t, s in ROWS], [r for r in labels if r[0] is not None]))


def test_empty_tables(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = odd(spark, [])
    for df in (pieces.encode(none, path), pieces.encode_digests(none, path), fim.transform(none), audit.filter_audit(none, labels)):
        assert df.collect() == []
    # Documents without any label.
    same(audit.filter_audit(odd(spark), labels).collect(), brute.op13(ROWS, []))


def test_null_ids_decode(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 40_000, -3, 264, 2])], "doc_id long, ids array<int>")
    same(pieces.decode(df, queries.tokenizer_path("piece_bpe_32k.model")).collect(), [(1, ""), (2, ""), (3, "a")])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" ▁ab\n\t\x00é日😀<s>0x​eTh"), max_size=60), max_size=8))
def test_pieces_are_the_librarys(model, texts):
    ids, sizes, same = model.encode(texts, check=True)
    each = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
    assert each == [model.library.encode(t, add_eos=True) for t in texts]
    assert model.decode(ids, sizes) == [model.library.decode(x) for x in each]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31_999), st.sampled_from([259, 28705])), max_size=12), max_size=6))
def test_any_ids_decode_as_in_the_library(model, lists):
    flat = np.array([i for x in lists for i in x], np.int64)
    assert model.decode(flat, np.array([len(x) for x in lists], np.int64)) == [model.library.decode(x) for x in lists]


def test_one_long_part_and_a_full_memory(model, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefg") for _ in range(30_000)), "x" * 20_000, " " * 3_000 + "y"]
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    for _ in range(3):
        ids, sizes, same = model.encode(texts, check=True)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == model.library.encode(texts, add_eos=True)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces._supported(b"")


def units_of(data):
    """What the table emits, one byte after another from the start state."""
    state, out = 0, []
    for b in data:
        out.append(int(fim.EMIT[state | b]))
        state = int(fim.NEXT[state | b])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n<PSM>aéß日😀 "), max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_lanes_emit_as_one_run(texts, lane):
    data = b"\xff".join(t.encode() for t in texts) + b"\xff"
    before, fim.LANE = fim.LANE, lane
    try:
        got = fim.scan(np.frombuffer(data, np.uint8))
    finally:
        fim.LANE = before
    assert got.tolist() == units_of(data)
    assert int((got & fim.CHAR).sum()) == sum(map(len, texts))
    assert int((got & fim.SENTINEL > 0).sum()) == sum(t.count(m) for t in texts for m in ("<P>", "<S>", "<M>"))


def test_rates_and_forms(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    got = {r["form"]: r["count"] for r in fim.transform(docs, rate=100, suffix_first=0).groupBy("form").count().collect()}
    assert got == {"psm": 2_000}
    got = {r["form"]: r["count"] for r in fim.transform(docs, seed=7).groupBy("form").count().collect()}
    assert 850 < got["plain"] < 1150 and 700 < got["spm"] < 900


def test_edges_are_counted_once(spark, monkeypatch):
    """31 sets of five filters are walked, one each; a child's rows are its parent's less the removed ones."""
    r = random.Random(5)
    rows = [("p" if r.random() < 0.7 else "q", r.random() < 0.5, r.random() < 0.2, *(r.random() < 0.3 for _ in range(5))) for _ in range(500)]
    judged = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, A boolean, B boolean, C boolean, D boolean, E boolean")
    edges = audit._edges(judged, "ABCDE").collect()
    assert len({(e.state, e.k) for e in edges}) == 80 and len(edges) == 160
    alive = {(e.part, e.state): e.alive for e in edges}
    assert all(alive[e.part, e.state | 1 << e.k] == e.alive - e.removed for e in edges if (e.state | 1 << e.k) < 31)
    out = audit.interactions(judged).collect()
    by = {(o.part, o.filter_order, o.step): o for o in out}
    # What all filters remove together is shared out among them.
    for part in "pq":
        total = sum(x[0] == part for x in rows)
        last = by[part, "ABCDE", 5].kept
        assert sum(by[part, "ABCDE", s].shapley for s in range(1, 6)) == 120 * (total - last)
        assert {by[part, "".join(o), 5].kept for o in ("ABCDE", "EDCBA", "CADBE")} == {last}


def test_other_numbers_of_filters(spark):
    judged = spark.createDataFrame([("p", True, False, True), ("p", False, True, False)], "part string, good boolean, toxic boolean, X boolean")
    assert [tuple(r) for r in audit.interactions(judged, "X").collect()] == [("p", "X", 1, 1, 1, 0, 1, 1, 0, 1)]
    with pytest.raises(ValueError):
        audit.interactions(judged, "ABCDEFG")
