"""Scores are added up where the postings are: sums in pieces, and no row for a posting and a query moves."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import lexical_index, retrieval, scoring

WANTED = [(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0), (3, "c", -1.0), (3, "a", 0.5)]


@pytest.mark.parametrize("at_once", [1, 4, 1000])
def test_sums_in_pieces(monkeypatch, at_once):
    monkeypatch.setattr(scoring, "AT_ONCE", at_once)
    asked = scoring.Asked.of(pa.table({"query_id": [w[0] for w in WANTED], "term": [w[1] for w in WANTED], "weight": [w[2] for w in WANTED]}))
    posts = [(0, "a", 1.0), (0, "b", 0.5), (1, "x", 9.0), (2, "c", 1.0), (2, "b", 2.0), (3, "a", 1.0)]
    row, code = np.array([p[0] for p in posts]), asked.codes(pa.array([p[1] for p in posts]))
    assert list(code >= 0) == [True, True, False, True, True, True]
    found = [r for b in asked.hits(pa.array("pqrst"), pa.array([7, 8, 9, 6, 5]), row, code, np.array([p[2] for p in posts]), 5) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(found) == [(1, "p", 7, 2.0), (1, "r", 9, 4.0), (1, "s", 6, 1.0), (2, "p", 7, 1.5), (2, "r", 9, 6.0), (3, "p", 7, 0.5), (3, "s", 6, 0.5)]


def test_nothing_is_asked():
    none = scoring.Asked.of(pa.schema([("query_id", pa.int64()), ("term", pa.string()), ("weight", pa.float64())]).empty_table())
    assert [len(b) for b in none.hits(pa.array(["p"]), pa.array([1]), np.array([0]), none.codes(pa.array(["a"])), np.array([1.0]), 3)] == [0]


def test_blocks_move_not_their_products(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i, f"all w{i % 7}") for i in range(300)], "id long, seq long, content string")
    lexical_index.build(chunks, f"{tmp_path}/i")
    found = lexical_index.search(spark, f"{tmp_path}/i", spark.createDataFrame([(1, "w1 all"), (2, "w2")], "query_id long, query string"), 4, is_few=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "arrays_zip" not in plan and "keys=[query_id" not in plan
    assert sorted((r.query_id, r.rank, r.id) for r in found.collect()) == [(1, 0, 1), (1, 1, 8), (1, 2, 15), (1, 3, 22), (2, 0, 2), (2, 1, 9), (2, 2, 16), (2, 3, 23)]


@pytest.mark.parametrize("few", [True, False])
def test_chunks_are_scored_in_their_rows(spark, few, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(retrieval, "TOKENS", 7)
    chunks = spark.createDataFrame([(i, i, f"all w{i % 7} w{i % 7}" if i % 5 else None) for i in range(60)], "id long, seq long, content string")
    found = retrieval.bm25(chunks, spark.createDataFrame([(1, "w1 w1"), (2, "w2"), (3, "?"), (4, "none")], "query_id long, query string"), 3, is_few=few)
    assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.rank, r.id) for r in found.collect()) == [(1, 0, 1), (1, 1, 8), (1, 2, 22), (2, 0, 2), (2, 1, 9), (2, 2, 16)]


def test_equal_products_tie_in_any_order():
    weights = [6.2402, 34.0499, 30.7872, 28.92270000005]
    left = lambda w: float(np.round(((w[0] + w[1]) + w[2]) + w[3], 10))
    assert {left(weights), left(weights[1:] + weights[:1]), left(weights[2:] + weights[:2])} == {100.0, 100.0000000001}
    asked = scoring.Asked.of(pa.table({"query_id": [1] * 4, "term": list("abcd"), "weight": weights}))
    orders = ["abcd", "dcba", "bcda", "cdab", "dabc"]
    row, code = np.repeat(np.arange(5), 4), asked.codes(pa.array([t for o in orders for t in o]))
    (found,) = asked.hits(pa.array(range(5)), pa.array([4, 3, 2, 1, 0]), row, code, np.ones(20), 5)
    assert found.column(1).to_pylist() == [4, 3, 2, 1, 0] and len(set(found.column(3).to_pylist())) == 1


def test_sums_are_exact():
    r = np.random.default_rng(5)
    cell, value = r.integers(0, 9, 5000), r.normal(0, 1, 5000) * 10.0 ** r.integers(-9, 4, 5000)
    got = scoring.exact_sums(cell, value, 10)
    assert got.tolist() == pytest.approx([math.fsum(value[cell == c]) for c in range(10)], rel=1e-15, abs=1e-16)
    for _ in range(20):
        order = r.permutation(5000)
        assert (scoring.exact_sums(cell[order], value[order], 10) == got).all()
    assert scoring.exact_sums(np.zeros(0, np.int64), np.zeros(0), 2).tolist() == [0, 0]


def ranked(df):
    return [(r.id, r.score) for r in sorted(df.collect(), key=lambda r: r.rank)]


@pytest.mark.parametrize("how", ["few", "tiles", "index"])
def test_copies_in_other_orders_tie(spark, how, monkeypatch, tmp_path):
    """Scores that are not rounded: chunks of the same words are as good as each other, wherever their words and rows stand."""
    monkeypatch.setattr(scoring, "DIGITS", 15)
    monkeypatch.setattr(retrieval, "TOKENS", 100)
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.sample(words, 40)) for _ in range(60)]
    chunks = spark.createDataFrame([(i, 59 - i if i < 60 else i, t) for i, t in enumerate([*texts, *(" ".join(words[:n]) for n in range(40)), *(f"all {i}" for i in range(60))])], "id long, seq long, content string")
    asked = spark.createDataFrame([(1, " ".join(words) + " all")], "query_id long, query string")
    if how == "index":
        lexical_index.build(chunks, f"{tmp_path}/i")
        found = ranked(lexical_index.search(spark, f"{tmp_path}/i", asked, 160))
    else:
        found = ranked(retrieval.bm25(chunks, asked, 160, is_few=how == "few"))
    copies = [f for f in found if f[0] < 60]
    assert [f[0] for f in copies] == [*range(59, -1, -1)] and len({f[1] for f in copies}) == 1


def test_the_mean_idf_has_no_order(spark):
    r = random.Random(4)
    terms = [(f"t{i}", r.randrange(1, 5000)) for i in range(3000)] + [("all", 9000)]
    stats = spark.createDataFrame([(10_000, 20.0)], "n long, avgdl double")
    got = set()
    for n in (1, 2, 7):
        r.shuffle(terms)
        rows = {x.term: x.idf for x in retrieval.idf(spark.createDataFrame(terms, "term string, df long").repartition(n), stats).collect()}
        got.add(rows["all"])
    mean = math.fsum(math.log(10_000 - df + 0.5) - math.log(df + 0.5) for _, df in terms) / len(terms)
    assert len(got) == 1 and got.pop() == pytest.approx(0.25 * mean, rel=1e-15)
    none = spark.createDataFrame([], "term string, df long")
    assert retrieval.idf(none, stats).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_neighbours_of_copies_go_by_seq(spark, few, monkeypatch):
    """Of copies that all score alike the first in seq are hits, whose neighbours are found; unrounded scores show what rounding hides."""
    monkeypatch.setattr(scoring, "DIGITS", 15)
    monkeypatch.setattr(retrieval, "TOKENS", 100)
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.sample(words, 40)) if i % 3 == 1 else " ".join(["other", *words[i % 40 : i % 40 + i % 7]]) for i in range(120)]
    shape = "id string, seq long, source_file string, chunk_index long, content string"
    chunks = spark.createDataFrame([(f"c{i}", i, f"f{i // 3}", i % 3, t) for i, t in enumerate(texts)], shape)
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, query string")
    found = retrieval.rerank(retrieval.rrf(retrieval.bm25(chunks, asked, 30, is_few=few)), chunks, asked, 6)
    got = sorted((x.rank, x.side, x.id) for x in retrieval.neighbours(chunks, found).collect())
    assert got == [(rank, side, f"c{3 * rank + 1 + side}") for rank in range(6) for side in (-1, 1)]
