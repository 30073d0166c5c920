"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; hot groups; learned and linked spans."""

import random
import sys
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, embedding, html_text, mixing, near_dedup, pii, quality, queries, secrets, substring, warc
from corpusloom.llm.components import components

#: Columns that operators use inside, as columns of the input.
CLASH = ("id", "h", "n", "cls", "key", "text_", "size", "base", "spans", "kept", "component_id", "lo", "u", "v", "bucket", "row", "more", "taken", "target", "digest", "a.b")
OPERATORS = {
    "near_dedup": near_dedup.near_duplicates,
    "bpe": lambda d: bpe.encode_digests(d, queries.tokenizer_path()),
    "mixing": mixing.mixture,
    "mix_rows": mixing.mix_rows,
    "substring": substring.without_repeats,
    "pii": pii.personal_data,
    "redact": pii.redact,
    "quality": quality.quality,
    "keep_good": quality.keep_good,
    "secrets": secrets.secrets,
}
KEEPS_ROWS = set(OPERATORS) - {"mix_rows", "keep_good"}


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def words(n, seed=0, of=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}" for _ in range(n))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    long = words(60_000) + " " + "9" * 20_000 + " " + "a@" * 5_000 + " +1" + "(" * 5_000
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "a b", "x", "s", 3), (3, long, "x", "s", 1), (3, long, "x", "s", 1), (4, " \n\t ", "x", None, 1), (5, "ÀÉ 😀 word " * 20, "x", "s", 1), (5, "other text", "x", "t", 1)]
    got = OPERATORS[name](frame(spark, rows)).collect()
    if name in KEEPS_ROWS:
        assert len(got) == len(rows)
        assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_empty_pages_and_vectors(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(pages).collect() == []
    assert warc.read_records(warc.write_archives(pages)).collect() == []
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u\nv", ""), (3, "u", "<article>A &amp; B<p>c  d</article>"), (3, "u", "<article>A &amp; B<p>c  d</article>"), (None, "w", "x" * 300_000), (4, "w", "x" * 300_000), (5, "u", "<p>cut <b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("archive", "offset", "first", "key", "digest")})
    got = {(r.page_id, r.text) for r in html_text.extract_text(pages).collect()}
    assert {(1, ""), (2, ""), (3, "A & B\nc d")} <= got
    back = warc.read_records(warc.write_archives(pages)).collect()
    assert len(back) == len(rows)
    assert sorted((str(r.page_id), r.payload_bytes) for r in back) == sorted((str(p), len((h or "").encode())) for p, _, h in rows)
    assert {r.refers_to for r in back if r.page_id is None} == {4}
    payloads = {r.page_id: bytes(r.payload) for r in back if r.record_type == "response"}
    assert payloads[4] == b"x" * 300_000


def test_clusters_choose_regions():
    long = "A long sentence of the page's own text that goes on for a while. " * 4
    body = f"<h2>Title</h2><p>{long}</p><p>short</p><p>{long}</p>"
    want = "\n".join(["Title", long.strip(), "short", long.strip()])
    cards = "".join(f"<article><a href='/{i}'><b>Card</b> <i>{i}</i></a></article>" for i in range(3))
    # Without article or main, with cards beside the article, with cards and a heading inside main.
    assert html_text.main_text(f"<div><a>One</a> <a>two</a></div><nav>menu</nav><div>{body}</div><nav>menu</nav>") == want
    assert html_text.main_text(f"{cards}<article>{body}</article>{cards}") == want
    assert html_text.main_text(f"<main><h1>Head</h1><article>{body}</article>{cards}</main>") == f"Head\n{want}"
    # An article next to long text outside keeps that text; one of short lines is not lost for it.
    assert html_text.main_text(f"<article>{body}</article><nav>menu</nav><div><p>{long}</p></div>") == f"{want}\n{long.strip()}"
    assert html_text.main_text(f"<article><ul><li>egg</li><li>salt</li></ul></article><nav>menu</nav><div><p>{long}</p><p>{long}</p></div>").startswith("egg\nsalt\n")


def test_many_archives_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 4_000)
    monkeypatch.setattr(warc, "GAP", 200)
    monkeypatch.setattr(warc, "RANGE", 1_500)
    monkeypatch.setattr(warc, "TASK", 3_000)
    r = random.Random(2)
    html = [None if i % 17 == 0 else f"same {i % 5}" * 40 if i % 3 == 0 else words(r.randrange(1, 400), i, 10**6) for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages)
    assert index.select("archive").distinct().count() > 6
    back = warc.read_records(index)
    assert back.rdd.getNumPartitions() >= index.agg(F.sum("length")).first()[0] // 3_000
    assert sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in back.collect()) == brute.op2(list(enumerate(html)))
    some = {x.page_id: x.payload for x in warc.read_records(index.where("page_id % 7 = 1")).collect()}
    assert some.keys() == set(range(1, 200, 7)) and all(p is None or bytes(p).decode() == (html[i] or "") for i, p in some.items())


def test_fetch_coalesces_neighbours(tmp_path, monkeypatch):
    members = [__import__("gzip").compress(warc.record(i, "u", b"x" * 50, None)) for i in range(30)]
    path = str(tmp_path / "a.warc.gz")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    ends = np.cumsum([len(m) for m in members]).tolist()
    rows = [(path, e - len(m), len(m)) for e, m in zip(ends, members, strict=True)]
    opened = []
    real = warc.open_file
    monkeypatch.setattr(warc, "open_file", lambda uri, mode: opened.append(uri) or real(uri, mode))
    monkeypatch.setattr(warc, "GAP", 10)
    for picked, fetches in ((rows, 1), (rows[::2], 15), (rows[:10] + rows[20:], 2)):
        opened.clear()
        assert [warc.parse(raw)[0]["warc-record-id"] for _, raw in warc._fetch(picked)] == [f"<urn:page:{rows.index(x)}>" for x in picked]
        assert len(opened) == fetches


def made_page(r):
    """A page of blocks with and without article and main elements, and the text that is its content."""
    sentence = lambda n: " ".join(f"{r.choice('the of wind river stone light old runs over and'.split())}{r.randrange(30)}" for _ in range(n))
    paragraph = lambda: sentence(r.randrange(30, 80))
    links = lambda: "".join(f"<li><a href='/{i}'><i>{sentence(1)}</i></a></li>" for i in range(r.randrange(2, 9)))
    blocks = [("h1", sentence(4))] + [("p", paragraph() if r.random() < 0.8 else sentence(3)) for _ in range(r.randrange(3, 9))] + [("p", paragraph())]
    body = "".join(f"<{tag}>{'<b>' + t + '</b>' if r.random() < 0.2 else t}</{tag}>" for tag, t in blocks)
    junk = [f"<nav><ul>{links()}</ul></nav>", f"<aside>{paragraph()}</aside>", f"<div class='ad'>{paragraph()}</div>", f"<form><p>{paragraph()}</p><input><button>go</button></form>", f"<div id='cookie-notice'><p>{paragraph()}</p></div>", f"<section class=comments><article><p>{paragraph()}</p></article></section>", f"<script>var a = '<p>{paragraph()}</p>';</script>", f"<footer>{paragraph()}</footer>"]
    cards = "".join(f"<article><a href='/{i}'><b>{sentence(1)}</b> <i>more</i> <u>{i}</u></a></article>" for i in range(r.randrange(3, 7)))
    inner = {"none": body, "div": f"<div class='post'>{body}</div>", "article": f"<article>{body}</article>", "main": f"<main><div>{body}</div></main>", "many": f"{cards}<article>{body}</article>{cards}", "both": f"<main><article>{body}</article></main>"}[r.choice("none div article main many both".split())]
    r.shuffle(junk)
    k = r.randrange(len(junk))
    return f"<html><head><title>{sentence(3)}</title></head><body>{''.join(junk[:k])}{inner}{''.join(junk[k:])}</body></html>", "\n".join(t for _, t in blocks)


def test_pages_with_none_one_and_many_articles():
    r = random.Random(11)
    pages = [made_page(r) for _ in range(300)]
    assert sum(html_text.main_text(html) == text for html, text in pages) == len(pages)
    # Without the clusters, whether by taking all articles or all that is no boilerplate, cards come along.
    every = lambda html: "\n".join(x[0] for x in parsed(html).lines if not x[4])
    assert sum(every(html) == text for html, text in pages) < len(pages) * 0.95


def parsed(html):
    p = html_text.Lines()
    p.feed(html)
    p.close()
    p.flush()
    return p


def test_hints_are_evidence():
    long = ("A long sentence of the page's own text that goes on for a while. " * 4).strip()
    assert html_text.main_text(f"<div class='search-results'><p>{long}</p></div>") == long
    assert html_text.main_text(f"<div class='page has-sidebar'><main><p>{long}</p></main><div class='sidebar'><p>{long} Aside.</p></div></div>") == long
    assert html_text.main_text(f"<article class='teaser'><p>teaser</p></article><div><p>{long}</p></div>") == long
    assert html_text.main_text(f"<article><p>{long}</p></article><div id='comments'><article><p>{long} I agree.</p></article></div>") == long


@pytest.mark.parametrize("tags", ["<div> <a> </a> x", "<div> x </div>", "<p> <article> <div> </p> x", "<button> </button> <p> x", "<li> x", "<article> x", "<div/class=ad> x </div>", "<span/class=ad> </span> x"])
def test_deep_pages_take_linear_time(tags):
    page = "".join(tag if tag == "x" else tag.replace("/class", " class") * 20_000 for tag in tags.split())
    began = time.perf_counter()
    assert html_text.main_text(page) == "x"
    assert time.perf_counter() - began < 10


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, []), (11, [-1.0, -2.0, -3.0]), (12, [1e200, 2e200, 3e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cls", "cell", "far", "copies", "v", "id")})
    got = {r.vec_id: tuple(r)[1:] for r in embedding.near_vectors(df).collect()}
    for i in (1, 2, 3, 12):
        assert got[i] == (3, 1, i == 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[i] == (0, i, True)


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "HOME_BYTES", 8 * 8 * 24)
    monkeypatch.setattr(embedding, "ROWS", 16)
    monkeypatch.setattr(embedding, "COLUMNS", 5)
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] + r.normal(scale=0.25, size=8)).tolist()) for i in range(240)]
    got = sorted(tuple(x) for x in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute.op7(rows)


def test_hot_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    docs = []
    for i in range(300):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(t)))
    docs += [(700, None), (701, ""), (702, "a"), (703, "A"), (704, "a b c"), (705, "a b c d e f"), (706, "a b c d e f g")]
    got = sorted(tuple(x)[:4] for x in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute.op1(docs)


def test_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(substring, "COMMON", 5)
    monkeypatch.setattr(substring, "SHARD_WORDS", 100)
    shared = [words(30, s) for s in range(4)]
    docs = [(i, " ".join([words(10, 100 + i), shared[i % 4], words(i % 17, 200 + i), shared[(i * 7) % 4][: 20 + i], "a a a a a a a a a a a a a a a a"])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(x) for x in substring.without_repeats(df, digest=True).collect())
    assert got == brute.op6(docs)
    texts = {r.doc_id: r.kept for r in substring.without_repeats(df).collect()}
    assert texts[0] == " ".join(docs[0][1].split())


def test_one_anchor_with_many_pieces(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(substring, "COMMON", 40)
    import pyarrow as pa

    r = random.Random(6)
    # Of many runs of six words the one with the smallest hash, which windows pick as their anchor.
    lines = [f"start{k} of entry of one log" for k in range(3000)]
    hashes = substring.windows(substring.Words(pa.array(lines)).hashes, substring.RUN)[:: substring.RUN]
    start = lines[int(hashes.argmin())]
    log = lambda seed: " ".join(f"{start} {random.Random(seed * 10**6 + k % 150).randrange(10**9)} {k % 50}" for k in range(400))
    docs = [(1, log(1)), (2, log(1)), (3, log(2)), (4, words(100, 3) + " " + log(2)[:3000] + " tail"), (5, log(1)[r.randrange(90) :])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(x) for x in substring.without_repeats(df, digest=True).collect()) == brute.op6(docs)
    texts = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], ["id", "text"])
    for batch in substring._anchors(iter([texts])):
        sizes += batch.column(2).to_pylist()
    assert max(sizes) > substring.COMMON  # one document alone makes its anchor common


def test_automaton_against_search():
    r = random.Random(3)
    texts = [[r.randrange(3) for _ in range(r.randrange(1, 40))] for _ in range(30)]
    m = substring.Automaton()
    for i, t in enumerate(texts):
        m.add(t, i)
    m.close()
    for t in [*texts, [r.randrange(3) for _ in range(60)]]:
        for size in (1, 3, 5):
            want = []
            for k in range(len(t) - size + 1):
                hits = [i for i, u in enumerate(texts) if any(u[j : j + size] == t[k : k + size] for j in range(len(u) - size + 1))]
                want.append(min(hits, default=int(substring._NO_ID)))
            assert m.stream(t, size) == want


@pytest.mark.parametrize("few", [None, 20])
def test_components(spark, monkeypatch, few):
    if few:  # most nodes by broadcast
        monkeypatch.setattr(sys.modules[components.__module__], "EDGES", 0)
        monkeypatch.setattr(sys.modules[components.__module__], "FEW", few)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(5, 5), (None, 3)] + [(300, i) for i in range(301, 350)]
    u = brute.Sets()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: u.find(x) for x in u.up if u.find(x) != x}


@pytest.mark.parametrize("small", [0, 8 << 20])
def test_learned_identifiers(spark, monkeypatch, small):
    monkeypatch.setattr(pii, "SMALL", small)
    rows = [(i, f"member reachphone +1 555 010 {1000 + i} says hi", "en", "s", 1) for i in range(20)] + [(100, "member reachphone 0155-4477881 says hi", "en", "s", 1), (101, "the year 2024 was fine", "en", "s", 1)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(frame(spark, rows, False)).collect()}
    assert got[3] == ["phone"] and got[100] == ["phone"] and got[101] == []
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows, False)).collect()}
    assert clean[3] == "member reachphone <PHONE> says hi" and clean[101] == rows[-1][1]
    assert "4477881" not in clean[100]


@pytest.mark.parametrize("small", [0, 8 << 20])
def test_identifiers_two_steps_from_a_seed(spark, monkeypatch, small):
    monkeypatch.setattr(pii, "SMALL", small)
    number = lambda i: f"0155-44778{10 + i}"
    texts = [f"callme a{i}@b.org w{i}" for i in range(30)] + [f"callme {number(i)} x{i}" for i in range(10)]
    texts += [f"reachphone {number(i)} y{i}" for i in range(10)] + ["reachphone 0199-7654321 z", "the year 2024 was fine"]
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], False)
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(df).collect()}
    assert got == {i: ["email"] for i in range(51)} | {51: []}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[50] == "reachphone <EMAIL> z" and clean[51] == texts[51]


def test_tied_kinds_agree(spark):
    seeds = [(i, f"reach him via a{i}@b.org now" if i % 2 else f"reach him via 10.0.0.{i} now", "en", "s", 1) for i in range(24)]
    rows = [*seeds, (100, "reach him via 99-1234-77 now", "en", "s", 1)]
    got = [{r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(frame(spark, part, False)).collect()} for part in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0][100]) == 1


def test_linked_parts(spark):
    key, secret = "AKIA" + "Q" * 16, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9a"
    rows = [(1, f"use {key} with {secret} at https://api.example.com/v1", "en", "s", 1), (2, f"only {secret} here", "en", "s", 1), (3, f"{key} " + "x " * 400 + secret, "en", "s", 1)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.secrets(frame(spark, rows, False)).collect()}
    assert got == {1: ["access", "weak_secret", "endpoint"], 2: [], 3: ["access"]}


def test_long_secrets_and_lone_identifiers(spark):
    key, long, secret = "AKIA" + "Q" * 16, "aB3" * 60, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9a"
    one, two, url = "client_id=Abc123XyzAbc123Xyz", "account_id=Def456XyzDef456Xyz", "https://api.example.com/v1"
    texts = [f"{key} session {long}", f"{one} at {url}", f"{one} and {two} at {url}", f"{one} with {secret} at {url}", f"{secret} " + "x " * 127 + one, f"{secret} " + "x " * 128 + one]
    got = {r.doc_id: [(s.kind, s.end - s.start) for s in r.spans] for r in secrets.secrets(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], False)).collect()}
    both = [("weak_id", 28), ("weak_secret", 40)]
    assert got == {0: [("access", 20), ("weak_secret", 180)], 1: [], 2: [], 3: [*both, ("endpoint", 26)], 4: both[::-1], 5: []}


def test_linked_parts_against_pairs(spark):
    r = random.Random(4)
    secret = lambda: "".join(r.choices("abcdefghijkABCDEFGHIJK0123456789+/", k=r.randrange(18, 60)))
    part = [lambda: "AKIA" + "Q" * 16, lambda: f"client_id={secret()[:12]}", lambda: f"Account-ID: '{secret()[:30]}'", secret, secret, lambda: f"token = {secret()}", lambda: secret().lower() and "0af" * 9, lambda: f"https://x.org/{secret()}", lambda: "ASIA" + "Z" * 16]
    docs = [(i, r.choice([" ", ", "]).join(r.choice(part)() if r.random() < 0.15 else "x" * r.randrange(1, 12) for _ in range(r.randrange(1, 150)))) for i in range(60)]
    want = brute.op10_spans(docs, brute.SECRETS, [(k, getattr(secrets, k.upper())) for k in secrets.WEAK_KINDS], brute.mixed, secrets.SCOPE)
    got = {x.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x.spans) for x in secrets.secrets(frame(spark, [(i, t, "en", "s", 1) for i, t in docs], False)).collect()}
    assert got == dict(want) and sum("weak_secret" in s for s in got.values()) > 10 and sum("endpoint" in s for s in got.values()) > 5


def test_bootstrap_against_dictionaries(spark):
    r = random.Random(12)
    number = lambda: f"{r.randrange(100):03}-{r.randrange(400)}-{r.randrange(10**3):04}"
    known = [number() for _ in range(40)]
    texts = []
    for i in range(250):
        seed = r.choice([f"a{r.randrange(60)}@b.org", f"10.0.{r.randrange(9)}.{r.randrange(9)}", f"+1 555 010 {1000 + r.randrange(90)}"])
        pairs = [(r.choice(["callme", "mail", "host"]), seed), (r.choice(["callme", "reachphone", "reachphone", "reachphone"]), r.choice(known)), (r.choice(["reachphone", "word"]), number()), ("the", "2024"), ("mail", "plain")]
        texts.append(" ".join(f"{w} {x} {r.choice(['now', 'thanks', 'ok,', 'or'])}" for w, x in pairs if r.random() < (0.9 if x == seed else 0.25)))
    docs = list(enumerate(texts)) + [(900, None), (901, "")]
    want = dict(brute.op8_spans(docs, brute.PII, pii.ROUNDS, pii.MIN_SURE, pii.MIN_SEEDS))
    got = {x.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x.spans) for x in pii.personal_data(frame(spark, [(i, t, "en", "s", 1) for i, t in docs], False)).collect()}
    assert got == want
    assert sum(len(got[b[0]]) > len(b[-1]) for b in brute.base(docs, brute.PII, True)) > 10


@pytest.mark.parametrize("sources", [["s"], [None], [None, "b", "a", "é"], list("abcdefg")])
def test_mixing_of_odd_sources(spark, sources):
    r = random.Random(len(sources))
    docs = [(i, r.choice([None, "", words(r.randrange(1, 60), i), " "]), r.choice(sources)) for i in range(80)] + [(100, None, "nothing"), (101, "", "nothing")]
    got = sorted(tuple(x) for x in mixing.mixture(frame(spark, [(i, t, "en", s, 1) for i, t, s in docs])).collect())
    assert got == [pytest.approx(w) for w in brute.op5(docs)]


def test_near_against_pairs(spark):
    r = random.Random(8)
    some = lambda n: sorted({(d, a, a + r.randrange(1, 60)) for d, a in ((r.randrange(3), r.randrange(900)) for _ in range(n))})
    parts, others = some(60), some(6)
    rows = lambda x: spark.createDataFrame([(d, 7, "k", a, b) for d, a, b in x], "id long, h long, kind string, start long, end long")
    got = {(x.id, x.start, x.end) for x in secrets.near(rows(parts), rows(others), 16).collect()}
    assert got == {p for p in parts if any(o[0] == p[0] and (0 <= p[1] - o[2] <= 16 or 0 <= o[1] - p[2] <= 16) for o in others)} != set()


def test_cascade_order_changes_no_verdict(spark):
    rows = [(i, words(5 + i, i, 30) + (" $$$" * (i % 9)), "en", "s", 1) for i in range(80)]
    df = frame(spark, rows, False)
    want = sorted((r[0], r[-1]) for r in brute.op9([(r[0], r[1]) for r in rows]))
    for rules in (quality.RULES, tuple(reversed(quality.RULES))):
        assert sorted((r.doc_id, r.kept) for r in quality.quality(df, rules=rules).collect()) == want
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, k in want if k}


def odd_quality(n=120):
    r = random.Random(9)
    some = lambda k: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(k))
    kinds = [lambda: some(r.randrange(1, 90)), lambda: " ".join(str(r.random()) for _ in range(30)), lambda: "\n".join("- " * (r.random() < 0.95) + some(4) for _ in range(9)), lambda: "\n".join(some(4) + "..." * (r.random() < 0.3) for _ in range(9)), lambda: " ".join(r.choice(["very", some(1)]) for _ in range(25)), lambda: " \n\t" + some(12) + " $#"]
    return [(i, r.choice(kinds)(), "en", "s", 1) for i in range(n)]


@pytest.mark.parametrize("complete", [False, True])
def test_cascade_stops_early(spark, complete):
    rows = odd_quality()
    want = {r[0]: r for r in brute.op9([(r[0], r[1]) for r in rows])}
    got = quality.quality(frame(spark, rows, False), complete=complete).collect()
    assert {r.doc_id: r.kept for r in got} == {i: w[-1] for i, w in want.items()}
    assert {r.failed_rule for r in got} >= {"digits", "marked_lines", "one_word", None}
    assert all(r.n_rules == len(quality.RULES) for r in got if r.kept)
    assert sum(r.n_rules for r in got) < 0.8 * len(quality.RULES) * len(rows)
    assert any(r.n_repeat_words is None for r in got) != complete
    if complete:
        assert [tuple(r)[1:5] + (r.n_repeat_words,) for r in sorted(got)] == [want[r.doc_id][1:6] for r in sorted(got)]


def test_same_rule_is_named_again(spark):
    df = frame(spark, odd_quality(), False)
    first = {(r.doc_id, r.failed_rule) for r in quality.quality(df).collect()}
    assert first == {(r.doc_id, r.failed_rule) for r in quality.quality(df.repartition(5)).collect()}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 20)
    same = frame(spark, [(1, "a b c", "en", "s", 1)] * 500, False)
    apart = frame(spark, [(i, "a b c", "en", "s", 1) for i in range(500)], False)
    assert len(quality.sample(same, "text")) <= 40 and 5 <= len(quality.sample(apart, "text")) <= 40


def test_texts_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 10)
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, words(200 + i, i, 5000).translate(letters), "en", "s", 1) for i in range(6)] + [(9, "a b " * 40, "en", "s", 1), (10, None, "en", "s", 1)]
    want = {r[0]: r[-1] for r in brute.op9([(r[0], r[1]) for r in rows])}
    df = frame(spark, rows, False)
    assert {r.doc_id: r.kept for r in quality.quality(df).collect()} == want
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, k in want.items() if k} != set()


def test_encode_then_decode(spark):
    df = frame(spark, [(1, "Hello  wörld 😀\n\n tabs\t'll <|endoftext|> 123", "en", "s", 1), (2, None, "en", "s", 1)], False)
    path = queries.tokenizer_path()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, path), path).collect()}
    assert back == {1: "Hello  wörld 😀\n\n tabs\t'll <|endoftext|> 123", 2: ""}


def test_long_runs_and_many_spans(spark):
    runs = ["a" * 1_000_000 + " 1", "1" * 1_000_000, "漢字" * 500_000 + " 5 x", "a@" * 500_000, "a." * 500_000, "password" + " " * 500_000 + "=x"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(runs)]
    assert [r.base for r in sorted(pii.personal_data(frame(spark, rows, False)).collect())] == [[]] * len(runs)
    hexes = [[("hex", 0, 1_000_000)], [("hex", 0, 1_000_000)], [], [], [], []]
    assert [[tuple(s) for s in r.base] for r in sorted(secrets.secrets(frame(spark, rows, False)).collect())] == hexes
    many = " ".join(f"a{i}@b.org, {i % 300}.1.1.1 +1 555 010 {1000 + i} 漢" for i in range(2_000))
    df = frame(spark, [(1, many, "en", "s", 1)], False)
    (got,) = pii.personal_data(df).collect()
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got.base) == brute.base([(1, many)], brute.PII, True)[0][-1]
    pos, out = 0, []
    for a, b, kind in sorted((s.start, -s.end, s.kind) for s in got.spans):
        if a >= pos:
            out += [many[pos:a], f"<{kind.upper()}>"]
        pos = max(pos, -b)
    assert pii.redact(df).first().text == "".join(out) + many[pos:]
