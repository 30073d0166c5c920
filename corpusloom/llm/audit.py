"""How filters interact: what each removes at every place of every order, by part of the corpus.

A trie of all orders of the filters is walked depth-first. What survives a prefix of an order does not depend on the prefix's own
order, so the survivors of each set of filters are one DataFrame, persisted while its subtree is open; a set that was met before is
not walked again. Each edge of the trie, a set and the next filter, is counted on the survivors it starts from: five filters have 80 edges
and 31 sets that something follows. Counts go to a table in the shared folder, a few rows for each set and part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, new_path, save

#: More filters than this have more orders than anybody reads.
MOST = 6
#: The limits of the five filters: words, distinct words in hundredths of words, capitals in hundredths of code points, marks.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """What fails the filters that look at one text alone, by letter."""
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, good, toxic and A to E, true where the filter fails, for each row of docs.

    E fails a text that a smaller id has too: the smallest id of each text's SHA-256 is marked, and whoever bears no mark fails. Ids
    meet the marks by id and digest, so a text of many copies is no hot key. A null text is empty; a null part is the empty
    string; a null id neither fails E nor makes others fail; of several labels of an id one that says so is enough; rows
    without a label are neither good nor toxic. Repeated rows count each; other columns are ignored.
    """
    rows = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    parted = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    failed = parted.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in text_failures(F.col("text"), F.col("words")).items()))
    failed = save(failed, "failed")
    first = failed.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    told = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(a) == 1), F.lit(False)).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))
    joined = failed.join(first, ["id", "digest"], "left").join(told, "id", "left")
    no = F.lit(False)
    return joined.select("part", *(F.coalesce(c, no).alias(c) for c in ("good", "toxic")), *FILTERS[:4], (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"))


def _edges(judged: DataFrame, filters: Sequence[str]) -> DataFrame:
    """part, state (the filters applied so far, as bits), k (the next one), alive (rows before it), removed, good_lost, toxic_lost; parts
    of which nothing is alive have no row."""
    where, n = new_path(judged.sparkSession, "edges"), len(filters)
    met: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        met.add(state)
        rest = [k for k in range(n) if not state >> k & 1]
        if len(rest) > 1:  # others start from these rows
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        lost = lambda k, more: F.count_if(F.col(filters[k]) & more)
        counts = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("alive"), *(lost(k, more).alias(f"{name}{k}") for k in rest for name, more in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))))
        edge = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"all{k}").alias("removed"), F.col(f"good{k}").alias("good_lost"), F.col(f"toxic{k}").alias("toxic_lost"))
        counts.select("part", "alive", F.inline(F.array(*map(edge, rest)))).write.parquet(f"{where}/state={state}")
        for k in rest:
            if len(rest) > 1 and state | 1 << k not in met:
                visit(state | 1 << k, survivors.where(~F.col(filters[k])))
        if len(rest) > 1:
            survivors.unpersist()

    visit(0, judged)
    return judged.sparkSession.read.schema("part string, alive long, k int, removed long, good_lost long, toxic_lost long, state int").parquet(where)


def interactions(judged: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order
    of the filters (joined to a string) and step from 1. judged has part, good, toxic and a boolean for each filter, true where it
    fails; no nulls. Nothing that is empty has rows; zeros are rows."""
    if not 1 <= len(filters) <= MOST or len({*filters}) < len(filters):
        raise ValueError(f"from 1 to {MOST} different filters")
    spark, n = judged.sparkSession, len(filters)
    judged = save(judged, "verdicts")
    edges = _edges(judged, filters)
    # In how many orders a set of so many filters is the prefix before a given one.
    times = F.element_at(F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n))), F.bit_count("state").cast("int") + 1)
    bit = F.expr("shiftleft(1, k)")
    # The edges of a part and filter, 2 ** (n - 1) at most, become one row.
    held = edges.groupBy("part", "k").agg(
        F.sum(times * F.col("removed")).cast("long").alias("shapley"),
        F.max(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.max(F.when(F.col("state") == (1 << n) - 1 - bit, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.map_from_entries(F.collect_list(F.struct("state", F.struct("alive", "removed", "good_lost", "toxic_lost")))).alias("edges"),
    )
    states = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda s: s.bitwiseAND(bit) == 0)
    each = held.withColumn("state", F.explode(states)).withColumn("e", F.col("edges")[F.col("state")])
    value = {c: F.coalesce(F.col(f"e.{c}"), F.lit(0)) for c in ("alive", "removed", "good_lost", "toxic_lost")}
    orders = [("".join(filters[k] for k in order), step + 1, reduce(int.__or__, (1 << k for k in order[:step]), 0), order[step]) for order in permutations(range(n)) for step in range(n)]
    at = spark.createDataFrame(orders, "filter_order string, step int, state int, k int")  # n * n! rows
    return each.join(F.broadcast(at), ["state", "k"]).select("part", "filter_order", "step", (value["alive"] - value["removed"]).alias("kept"), value["removed"].alias("removed"), (F.col("fails") - value["removed"]).alias("redundant"), "unique_fails", value["good_lost"].alias("good_lost"), value["toxic_lost"].alias("toxic_lost"), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """interactions() of the five filters on verdicts()."""
    return interactions(verdicts(docs, labels, **names))
