"""The pipeline's stages over nulls, empty and long texts, ties, repeated rows, an empty table and columns with clashing names."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F
from test_edges import CLASH

import corpus_pipeline
from corpusloom.llm import queries

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(3 + k % 5)) for k in range(n))


GOOD = words(300, 1)
NEAR = GOOD.replace(" ", "  ", 3) + " end"
ROWS = [
    (1, None, None, None, None), (2, "", "", "", 0), (None, words(120, 2), "x", "s", 3), (3, GOOD, "x", "s", 1), (3, GOOD, "x", "s", 1), (4, NEAR, "x", None, 1),
    (5, words(90, 3) + " mail ann@site.org now", "x", "s", 1), (5, words(80, 4), "x", "t", 1), (6, words(60_000, 5), "x", "t", 1), (7, "a b c", "x", "t", 1), (8, " \n\t", "x", "t", 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("x") for c in CLASH})


def run(spark, rows, upto):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "nowhere")
        if name == upto:
            return docs


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def good():
    """What the base conditions keep; the other rules say nothing against these texts."""
    return [(i, t) for i, t, *_ in ROWS if len(brute.words(t)) >= 10]


def test_quality(spark):
    kept = run(spark, ROWS, "quality")
    assert kept.columns == frame(spark, []).columns
    failed = {r[0]: r[-1] for r in brute.op9([(k, t) for k, (_, t) in enumerate(good())])}
    assert pairs(kept) == sorted((x for k, x in enumerate(good()) if failed[k]), key=repr)


def test_near_dedup(spark):
    kept = pairs(run(spark, ROWS, "near_dedup"))
    before = pairs(run(spark, ROWS, "quality"))
    # 4 is a near copy of 3; rows of one id count as one document, a null id links with nothing.
    assert [i for i, _ in before if i == 4] and not [i for i, _ in kept if i == 4]
    assert kept == [(i, t) for i, t in before if i != 4]


def test_personal_data(spark):
    clean = run(spark, ROWS, "pii")
    got = pairs(clean)
    want = [(i, t.replace("ann@site.org", "<EMAIL>")) for i, t in pairs(run(spark, ROWS, "near_dedup"))]
    assert got == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in clean.collect())


def test_mixing(spark):
    clean = [(k, r.text, r.source) for k, r in enumerate(sorted(run(spark, ROWS, "pii").collect(), key=lambda r: (str(r.doc_id), r.text)))]
    mixed = run(spark, ROWS, "mixing")
    assert mixed.columns == frame(spark, []).columns
    size = sum(len(brute.words(t)) for _, t, _ in clean)
    taken = sum(len(brute.words(r.text)) for r in mixed.collect())
    # One source holds one document of most words: a source ends within half its boundary document of its target.
    assert abs(taken - 1.5 * size) <= 0.5 * max(len(brute.words(t)) for _, t, _ in clean) * 3
    assert {r.text for r in mixed.collect()} <= {t for _, t, _ in clean}


def test_encoding(spark):
    mixed = run(spark, ROWS, "mixing")
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    done = dict(corpus_pipeline.STAGES)["bpe"](spark, mixed, "nowhere")
    want = [(rows[k][0], *x) for k, *x in brute.op3([(k, t) for k, (_, t) in enumerate(rows)], queries.tokenizer_path())]
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    assert run(spark, [], name).collect() == []
    # As does a table of which nothing is kept.
    assert run(spark, [(1, None, None, None, None), (2, "a b", "x", "s", 3)], name).collect() == []


def test_odd_rows_of_single_operators(spark):
    """Values, not counts, of what encodes and scans odd rows."""
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "call +1 555 123 4567 or 10.0.0.1", "x", "s", 3), (3, "tie a@b.co a@b.co", "x", "s", 1), (3, "tie a@b.co a@b.co", "x", "s", 1)]
    found = queries.pii.personal_data(frame(spark, rows)).collect()
    spans = sorted((str(r.doc_id), [(s["kind"], s["start"], s["end"]) for s in r.base]) for r in found)
    mails = [("email", 4, 10), ("email", 11, 17)]
    assert spans == sorted([("1", []), ("2", []), ("None", [("ip", 24, 32), ("phone", 5, 20)]), ("3", mails), ("3", mails)])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    none = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe.encode_digests(frame(spark, rows[:2]), queries.tokenizer_path()).collect()}
    assert none == {(1, 0, sha(b""), sha(b"")), (2, 0, sha(b""), sha(b""))}
