"""Chunks in buckets: the same neighbours, ranks and texts, and no exchange of chunks."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.sources import chunk_table


@pytest.fixture(scope="module")
def chunks(spark):
    rows, seq = [], 0
    for doc, n in (("a", 5), ("b", 1), ("c", 40), (None, 3)):
        for i in range(n):
            gap = doc == "c" and i >= 20  # a chunk fell out: places in the document jump, those in the corpus do not
            rows.append((f"chunk_{seq}", seq, doc, i + gap, "p", "h", "", "", f"text {seq} of {doc}"))
            seq += 1
    return spark.createDataFrame(rows, "id string, seq long, source_file string, chunk_index int, page_title string, section_heading string, date string, author string, content string").repartition(3)


@pytest.fixture(scope="module")
def kept(spark, chunks, tmp_path_factory):
    chunk_table.write(chunks, "kept_chunks", str(tmp_path_factory.mktemp("chunks") / "t"), 12)
    return chunk_table.read(spark, "kept_chunks")


@pytest.fixture(scope="module")
def hits(spark, chunks):
    return spark.createDataFrame([(q, f"chunk_{s}", r, 1.0 - r / 10) for q in (1, 2) for r, s in enumerate((0, 4, 5, 6, 25, 26, 46, 48))], "query_id long, id string, rank long, score double")


@pytest.mark.parametrize("few", [True, False])
def test_same_neighbours_and_texts(chunks, kept, hits, few):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(retrieval.neighbours(kept, hits, few)) == rows(retrieval.neighbours(chunks, hits, few))
    assert rows(retrieval.expand(kept, hits, few)) == rows(retrieval.expand(chunks, hits, few))
    links = {r.id: (r.prev_id, r.next_id) for r in kept.collect()}
    assert links["chunk_0"] == (None, "chunk_1") and links["chunk_5"] == (None, None) and links["chunk_25"] == ("chunk_24", None) and links["chunk_26"] == (None, "chunk_27")


def test_chunks_are_not_exchanged(spark, kept, hits):
    """Of what is not broadcast, only the search's side is dealt."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.createDataFrame([(1, "text"), (2, "of a")], "query_id long, query string")
        for df in (retrieval.neighbours(kept, hits), retrieval.rerank(hits, kept, asked)):
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            scans = [i for i, line in enumerate(plan) if "FileScan parquet" in line and "Bucketed: true" in line]
            assert scans
            for i in scans:
                depth, above = plan[i].index("FileScan"), []
                for line in reversed(plan[:i]):  # the nodes above the scan, up to the join
                    at = len(line) - len(line.lstrip(" :|+-*()0123456789"))
                    if at < depth:
                        depth = at
                        above.append(line)
                        if "SortMergeJoin" in line:
                            break
                assert above and "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert retrieval.neighbours(kept, hits).count() == retrieval.neighbours(kept, hits, True).count()


def test_a_table_is_replaced(spark, chunks, tmp_path):
    chunk_table.write(chunks, "twice", f"{tmp_path}/one", 4)
    chunk_table.write(chunks.where("source_file = 'a'").withColumn("content", F.lit("new")), "twice", f"{tmp_path}/two", 4)
    assert {r.content for r in chunk_table.read(spark, "twice").collect()} == {"new"}
