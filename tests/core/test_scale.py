"""Jobs that must do each piece of work once, and in few tasks."""

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunking, conversion
from corpusloom.plans.queries import QUERIES
from corpusloom.sources import page_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_counted_in_one_pass(spark, tmp_path):
    rows = [(1, "---++ Oak\n"), (2, None), (3, "plain"), (4, "---++ Elm\n-- Main.Ann - 2020"), (5, "x <nop> y")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    counted = conversion.rule_counts(conversion.convert_all(spark.read.parquet(f"{tmp_path}/docs")))
    assert plan(counted).count("FileScan") == 1
    assert [tuple(r) for r in counted.collect()] == [("Headings converted", 2, 40.0), ("No specific rules matched", 1, 20.0), ("Nop tags stripped", 1, 20.0), ("Signatures converted", 1, 20.0)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert conversion.rule_counts(conversion.convert_all(none)).collect() == []


def test_plain_ends_are_not_searched(spark):
    rows = [("a%b%c d", "A%B%c d", "A%B%C d"), ("no mark", "no mark", "no mark"), ("%", "%", "%"), ("x% ", "X% ", "X% "), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    got = df.select("a", "b", text.upto(df.t, "%", F.upper).alias("x"), text.upto(df.t, "%", F.upper, "^\\S+").alias("y")).collect()
    assert all(r.a == r.x and r.b == r.y for r in got)


def test_pages_are_read_in_few_tasks(spark, tmp_path):
    texts = {f"w{i % 3}/d/p{i}.md": f"tèxt {i}" for i in range(150)} | {"top.md": "", "w0/x.md": "y" * 9_000_000}
    page_files.write_pages(spark.createDataFrame(list(texts.items()), "name string, markdown string").repartition(3), f"{tmp_path}/out")
    back = page_files.read_pages(spark, f"{tmp_path}/out")
    assert {r.name: r.text for r in back.collect()} == texts and back.count() == len(texts)
    assert back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    (tmp_path / "none").mkdir()
    assert page_files.read_pages(spark, f"{tmp_path}/none").collect() == []


def test_reports_clean_texts_once(spark):
    """What reads documents and their chunks reads them from a table: no plan cleans a text."""
    for name in ("chunk_issues", "file_summary", "corpus_counts"):
        assert "hideimg" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
