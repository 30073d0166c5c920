"""Dense search in tiles and by the written index, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, tiles, vector_index
from corpusloom.plans import queries as plans

SF = "/root/testdata/sf0.01"


def frame(spark, x, name="id", seq=True):
    rows = [(i, *([i] if seq else []), None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, {'seq long, ' if seq else ''}embedding array<double>")


def brute(x, q, k):
    """The k best rows of each query, ties by place; zero vectors are in no ranking."""
    with np.errstate(invalid="ignore", divide="ignore"):
        n = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
        s = np.round(n(q) @ n(x).T, 10)
    out = []
    for i, row in enumerate(s):
        order = [j for j in np.lexsort((np.arange(len(row)), -row)) if not np.isnan(row[j])]
        out += [(i, int(j), r) for r, j in enumerate(order[:k])]
    return out


def ranks(df):
    return sorted((r.query_id, r.id, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def hot():
    """A third of the rows are one vector, as is a third of the queries; some rows have no direction."""
    r = np.random.default_rng(1)
    x, q = r.normal(size=(900, 8)), r.normal(size=(120, 8))
    x[::3], q[::3], x[5], x[7] = x[0], x[0], 0, x[8] * 2
    return x, q


def test_tiles_are_exact(spark, hot, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_BYTES", 4_000)
    monkeypatch.setattr(tiles, "ROWS", 50)
    x, q = hot
    got = retrieval.dense(frame(spark, x), frame(spark, q, "query_id", False), 7)
    assert ranks(got) == sorted(brute(x, q, 7))


def test_no_tile_has_a_large_share(spark, hot, monkeypatch):
    """Numbers of tiles follow the data and the cores; one cell or one vector that many have gets no task of its own."""
    x, q = hot
    seen = lambda rows, asked: rows.select(["cell"]).slice(0, 1).append_column("n", [[len(rows)]]).append_column("m", [[len(asked)]])
    one = lambda df: df.withColumn("cell", F.lit(0))
    sides = one(frame(spark, x)), one(frame(spark, q, "query_id", False))
    met = tiles.tiled(*sides, seen, "cell int, n long, m long", 64, 64).collect()
    assert len(met) >= 2 * spark.sparkContext.defaultParallelism
    assert max(r.n for r in met) < 0.2 * len(x)
    monkeypatch.setattr(tiles, "TILE_BYTES", 2_000)
    met = tiles.tiled(*sides, seen, "cell int, n long, m long", 64, 64).collect()
    assert sum(r.n * r.m for r in met) == len(x) * len(q)
    assert max(r.n for r in met) < 60 and max(r.m for r in met) < 60


def test_recall_over_all_queries(spark):
    q = plans.questions(spark, SF)
    exact = {(r.query_id, r.id) for r in retrieval.dense(plans.vectors(spark, SF), q, is_few=True).collect()}
    found = {(r.query_id, r.id) for r in plans.ann_topk(spark, SF).collect()}
    assert len(found) == len(exact)
    assert len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("few", [True, False])
def test_probed_cells_are_searched_exactly(spark, hot, tmp_path, few):
    x, q = hot
    vector_index.build(frame(spark, x), f"{tmp_path}/i", cells=12)
    asked = frame(spark, q, "query_id", False)
    every = vector_index.nearest(spark, f"{tmp_path}/i", asked, 7, probes=12, is_few=few)
    assert ranks(every) == sorted(brute(x, q, 7))
    # With some of them probed: the best of what is in these.
    c, _, _ = vector_index.centroids(spark, f"{tmp_path}/i")
    cell = {r.id: r.cell for r in spark.read.parquet(f"{tmp_path}/i/codes").select("id", "cell").collect()}
    unit = q / np.sqrt((q * q).sum(1, keepdims=True))
    want = []
    for i, cells in enumerate(vector_index._first_cells(unit, c)[:, :3]):
        own = np.array(sorted(j for j in cell if cell[j] in cells))
        want += [(i, int(own[j]), r) for _, j, r in brute(x[own], q[i : i + 1], 7)]
    assert ranks(vector_index.nearest(spark, f"{tmp_path}/i", asked, 7, probes=3, is_few=few)) == sorted(want)


def test_only_probed_cells_are_read(spark, hot, tmp_path):
    x, q = hot
    vector_index.build(frame(spark, x), f"{tmp_path}/i", cells=12)
    found = vector_index.nearest(spark, f"{tmp_path}/i", frame(spark, q[1:2], "query_id", False), 3, probes=2, is_few=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "cell#" in line]
    assert scans and all("PartitionFilters: [cell" in line for line in scans)
    # The pass over the codes reads no vectors.
    assert any("code#" in line and "embedding#" not in line for line in scans)


def test_odd_vectors(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (2, 2, None), (3, 3, [0.0, 0.0]), (4, 4, [1.0, None]), (5, 5, [1.0, 2.0, 3.0]), (6, 6, [float("nan"), 1.0]), (7, 7, [0.5, 0.5]), (7, 7, [0.5, 0.5]), (8, 8, [])]
    df = spark.createDataFrame(rows, "id long, seq long, embedding array<double>")
    vector_index.build(df, f"{tmp_path}/i", keep=())
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id long, embedding array<double>")
    for few in (True, False):
        got = vector_index.nearest(spark, f"{tmp_path}/i", q, is_few=few).collect()
        assert sorted((r.query_id, r.id, r.score) for r in got) == [(1, 1, 1.0), (1, 7, 0.7071067812), (1, 7, 0.7071067812)]
    vector_index.build(df.where("id = 2"), f"{tmp_path}/none")
    assert vector_index.nearest(spark, f"{tmp_path}/none", q, is_few=True).collect() == []
