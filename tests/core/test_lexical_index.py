"""The kept lexical index against BM25 over all postings: same hits, blocks left out, other terms' files left shut."""

import random

import pytest

from corpusloom.operators import lexical_index, retrieval


def corpus(n=400, seed=1):
    """Chunks in which one word is everywhere, some are frequent and most rare; a third are one text."""
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.8)), 500)}"
    same = "all " + " ".join(word() for _ in range(30))
    return [(i, i, same if i % 3 == 0 else "all " * r.randrange(1, 4) + " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(n)] + [(n, n, ""), (n + 1, n + 1, None), (n + 2, n + 2, "?!")]


QUERIES = [(1, "all"), (2, "w1 w2 w3"), (3, "w300 w77 w1"), (4, "nothing_here"), (5, ""), (6, "w9 w9 w9 w2 all"), (7, " ".join(f"w{i}" for i in range(1, 80)))]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), "id long, seq long, content string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in df.select("query_id", "rank", "id", "score").collect())


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("size", [3, 128])
def test_same_hits(spark, chunks, queries, tmp_path, monkeypatch, few, size):
    monkeypatch.setattr(lexical_index, "RANGE", size)
    lexical_index.build(chunks, f"{tmp_path}/i")
    for k in (1, 5, 30):
        assert rows(lexical_index.search(spark, f"{tmp_path}/i", queries, k, is_few=few)) == rows(retrieval.bm25(chunks, queries, k, is_few=True))


def test_other_constants(spark, chunks, queries, tmp_path):
    how = {"k1": 0.9, "b": 0.3, "epsilon": 0.5}
    lexical_index.build(chunks, f"{tmp_path}/i", **how)
    assert rows(lexical_index.search(spark, f"{tmp_path}/i", queries, 9)) == rows(retrieval.bm25(chunks, queries, 9, is_few=True, **how))


def test_blocks_hold_all_postings(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE", 10)
    lexical_index.build(chunks, f"{tmp_path}/i")
    post = {(r.term, r.id) for r in retrieval.postings(chunks).collect()}
    blocks = spark.read.parquet(f"{tmp_path}/i/blocks").collect()
    assert {(b.term, i) for b in blocks for i in b.ids} == post and sum(len(b.ids) for b in blocks) == len(post)
    assert len({b.block for b in blocks}) == len(blocks)
    for b in blocks:
        assert len(b.ids) == len(b.seqs) == len(b.impacts) <= 10
        assert b.most == max(b.impacts) and {s // 10 for s in b.seqs} == {b.range}


def test_ranges_without_hits_are_left_out(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE", 4)
    lexical_index.build(chunks, f"{tmp_path}/i")
    seen = []
    keep = lexical_index.worth
    monkeypatch.setattr(lexical_index, "worth", lambda *args: seen.append((args[0], keep(*args))) or seen[-1][1])
    asked = spark.createDataFrame([(2, "all w2 w20 w30")], "query_id long, query string")
    found = rows(lexical_index.search(spark, f"{tmp_path}/i", asked, 3, is_few=True))
    assert found == rows(retrieval.bm25(chunks, asked, 3, is_few=True))
    before, after = (df.count() for df in seen[0])
    assert before == 100 and after < before / 3


def test_other_buckets_are_not_opened(spark, chunks, tmp_path):
    lexical_index.build(chunks, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "w2")], "query_id long, query string")
    # A damaged file of another bucket does no harm.
    own = {spark.createDataFrame([("w2",)], "term string").select(lexical_index._bucket(lexical_index.LEAST_BUCKETS)).first()[0]}
    hurt = 0
    for file in (tmp_path / "i" / "blocks").rglob("*.parquet"):
        if file.parent.name not in {f"bucket={b}" for b in own}:
            file.write_bytes(b"no parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            hurt += 1
    assert hurt > 5
    assert rows(lexical_index.search(spark, f"{tmp_path}/i", asked, 5, is_few=True)) == rows(retrieval.bm25(chunks, asked, 5, is_few=True))


def test_nothing_to_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, seq long, content string")
    lexical_index.build(none, f"{tmp_path}/i")
    assert lexical_index.search(spark, f"{tmp_path}/i", spark.createDataFrame(QUERIES, "query_id long, query string")).collect() == []


def test_counts_in_the_row(spark, monkeypatch):
    """Long rows and many rows, with few tokens at a time."""
    monkeypatch.setattr(retrieval, "TOKENS", 5)
    df = spark.createDataFrame([(1, 1, "a b a a_b"), (2, 2, "x " * 40), (3, 3, None), (4, 4, "")], "id long, seq long, content string")
    got = {(r.id, r.term): (r.tf, r.len) for r in retrieval.postings(df).collect()}
    assert got == {(1, "a"): (3, 6), (1, "b"): (2, 6), (1, "a_b"): (1, 6), (2, "x"): (40, 40)}


def test_frequent_terms_are_dealt_into_parts(spark, chunks, queries, monkeypatch):
    few = rows(retrieval.bm25(chunks, queries, 9, is_few=True))
    assert rows(retrieval.bm25(chunks, queries, 9)) == few
    monkeypatch.setattr(retrieval, "PART", 20)
    assert rows(retrieval.bm25(chunks, queries, 9)) == few
