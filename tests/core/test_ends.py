"""Chunking does not search whole texts where their ends or beginnings say enough, and says the same."""

from pyspark.sql import functions as F

from corpusloom.functions import clean, text
from corpusloom.operators import chunking

ENDS = ["", " ", "x", "\t x \n", "　x ", " \x85", "\x1cx\x1f", "é  ", "​x᠎", "a b", "ж", "\x7f "]


def test_ends(spark):
    df = spark.createDataFrame([(x,) for x in ENDS] + [(chr(c) + "m" + chr(c),) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + [(None,)], "t string")
    both = text.sub(text.sub(F.col("t"), r"(?U)^\s+", ""), r"(?U)\s+\z", "")
    assert df.where(~text.strip(F.col("t")).eqNullSafe(both) | ~text.rstrip(F.col("t")).eqNullSafe(text.sub(F.col("t"), r"(?U)\s+\z", ""))).count() == 0


def test_plain_starts(spark):
    rows = ["x" * 900, "# " * 500 + "word", "a" * 30 + "https://e.org/" + "b" * 2000, "y" * 795 + "https://e.org/z", " " * 3000 + "z" * 190, "", "#" * 5000, "k " * 120]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(F.length(clean.plain_text(F.col("t"))).alias("n"), F.length(clean.plain_start(F.col("t"), 200)).alias("m"))
    for r in df.collect():
        assert (r.n >= 200 and r.m >= 200) or r.n == r.m


def test_signature_by_itself(spark):
    rows = [("-- Ann Lee, 2 May\n\n\n", "Ann Lee", "2 May"), ("x\n-- A\n— Bo C - 2020 - x \n \nrest", "Bo C", "2020 - x"), ("--9\n-- Al", "Al", ""), ("no", "", "")]
    df = spark.createDataFrame(rows, "t string, a string, d string")
    assert df.select("a", "d", clean.signature(F.col("t")).alias("s")).where("s.author <> a or s.date <> d").count() == 0


def test_no_pattern_looks_for_ends(spark):
    docs = spark.createDataFrame([(1, "a")], "source_file long, text string")
    assert r"\s+\z" not in chunking.chunks_of(docs)._jdf.queryExecution().optimizedPlan().toString()
