"""Each query of the folder against a plain version, on the small tables."""

import hashlib

import brute
import duckdb
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import pii, queries, secrets

SF = "/root/testdata/sf0.001"


def rows(name, *cols):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(cols))
    return list(zip(*(t.column(c).to_pylist() for c in cols), strict=True))


@pytest.fixture(scope="module")
def docs():
    return rows("documents", "doc_id", "text")


def run(spark, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).collect())


def test_near_dedup(spark, docs):
    assert run(spark, "op1_minhash_near_dedup") == brute.op1(docs)


def test_warc(spark):
    assert run(spark, "op2_warc") == brute.op2(rows("pages", "page_id", "html"))


def test_bpe(spark, docs):
    assert run(spark, "op3_bpe") == brute.op3(docs, queries.tokenizer_path())


def test_html_text(spark):
    import re
    from html import unescape

    htmls = dict(rows("pages", "page_id", "html"))
    squeezed = lambda s: re.sub(r"\s+", "", s)
    got = run(spark, "op4_html_text")
    assert len(got) == len(htmls)
    for page, _, text, n in got:
        body = re.search(r"<article.*?>(.*?)(</article>|$)", htmls[page], re.S)
        assert n == len(text)
        if body:
            assert squeezed(text) == squeezed(unescape(re.sub("<[^>]*>", "", body[1])))


def test_mixing(spark):
    want = brute.op5(rows("documents", "doc_id", "text", "source"))
    assert run(spark, "op5_mixing") == want == run(spark, "op5_mixing")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    asked = con.execute(queries.ORACLES[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(asked.fetchall(), key=repr)


def test_substring(spark, docs):
    assert run(spark, "op6_substring_dedup") == brute.op6(docs)


def test_embeddings(spark):
    assert run(spark, "op7_embedding_near_dedup") == brute.op7(rows("embeddings", "vec_id", "embedding"))


def test_personal_data(spark, docs):
    spans = dict(brute.op8_spans(docs, brute.PII, pii.ROUNDS, pii.MIN_SURE, pii.MIN_SEEDS))
    assert run(spark, "op8_pii") == [(*r[:-1], spans[r[0]]) for r in brute.base(docs, brute.PII, True)]


def test_secrets(spark, docs):
    spans = dict(brute.op10_spans(docs, brute.SECRETS, [(k, getattr(secrets, k.upper())) for k in secrets.WEAK_KINDS], brute.mixed, secrets.SCOPE))
    assert run(spark, "op10_secret_scan") == [(*r[:-1], spans[r[0]]) for r in brute.base(docs, brute.SECRETS, False)]


def test_quality(spark, docs):
    assert run(spark, "op9_quality_rules") == brute.op9(docs)


def test_sentencepiece(spark, docs):
    assert run(spark, "op11_sentencepiece") == brute.op11(docs, queries.tokenizer_path("piece_bpe_32k.model"))


def test_fill_in_middle(spark, docs):
    assert run(spark, "op12_fill_in_middle") == [(*r[:5], *(hashlib.sha256(t.encode()).hexdigest() for t in r[5:])) for r in brute.op12(docs)]


def test_filter_audit(spark):
    assert run(spark, "op13_filter_audit") == brute.op13(rows("documents", "doc_id", "text", "source"), rows("labels", "doc_id", "quality", "toxic"))


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows_ = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality"](spark, rows_, SF)
    want = {r[0] for r in brute.op9(docs) if r[-1]}
    assert kept.columns == rows_.columns
    assert {r.doc_id for r in kept.collect()} == want
    alone = stage["near_dedup"](spark, kept, SF)
    want = {r[0] for r in brute.op1([d for d in docs if d[0] in want]) if r[3]}
    assert {r.doc_id for r in alone.collect()} == want
    clean = stage["pii"](spark, alone, SF)
    texts = dict(docs)
    found = {r[0]: r[-1] for r in brute.base([d for d in docs if d[0] in want], brute.PII, True)}
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        if not found[r.doc_id]:
            assert r.text == texts[r.doc_id]
        else:
            assert "<" in r.text and r.text != texts[r.doc_id]
    mixed = stage["mixing"](spark, clean, SF).cache()
    assert mixed.columns == rows_.columns
    times = {r[0]: r[4] // r[1] for r in brute.op5([(r.doc_id, r.text, r.source) for r in clean.collect()]) if r[1]}
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == sorted(i for i, n in times.items() for _ in range(n))
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, done.collect())) == brute.op3([(r.doc_id, r.text) for r in mixed.collect()], queries.tokenizer_path())
