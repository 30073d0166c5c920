"""Every registered query with SQL against DuckDB, and the entry points without the optional folder."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans.queries import ORACLES, QUERIES
from corpusloom.plans.tables import MIXED, QUERY

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=2e-5))


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    asked = duck.execute(ORACLES[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in asked.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(near(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_queries_are_whole_texts(duck):
    cut = f"SELECT count(*), count_if(query <> text) FROM (SELECT text, {QUERY[1]} FROM benchmark)"
    assert duck.execute(cut).fetchone() == (40, 0)


def test_mixed_documents_are_whole(duck):
    cut = f"SELECT count(*), count_if(NOT contains(raw, coalesce(text, ''))) FROM (SELECT text, {MIXED} AS raw FROM documents)"
    assert duck.execute(cut).fetchone() == (200, 0)


def test_every_query_has_sql():
    # The index's own choice of cells is held to brute force in test_vector_index.
    assert set(QUERIES) == set(ORACLES) | {"ann_topk"}


def test_without_optional_folder(tmp_path):
    repo = Path(__file__).parents[2]
    for p in repo.iterdir():
        if p.name not in ("corpusloom", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "corpusloom").mkdir()
    for p in (repo / "corpusloom").iterdir():
        if p.name != "llm":
            (tmp_path / "corpusloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(importlib.util.find_spec("corpusloom.llm") is None, reason="optional")
def test_names():
    import __spark_entry__ as e

    q = e.queries()
    found = sorted(int(n[2:].split("_")[0]) for n in q if n.startswith("op"))
    assert found == (list(range(1, 14)) if e.llm else []) and ("pipeline" in q) == bool(e.llm)
    assert set(e.oracle_sql()) <= set(q)
