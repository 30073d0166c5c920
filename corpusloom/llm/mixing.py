"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions alone.

Each source gets a target; the whole copies in it are taken of every document, and the rest is met by a threshold on a hash
of the document's id. The threshold is found from sums of words by source and hash bucket, then from the boundary bucket
only, then from the boundary's own hashes: nothing is sorted but a source's bucket sums, and applying it is a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, drop, save

#: Fixed: weights of the sources in order of their code points, repeating.
WEIGHTS = (5, 2, 1)
#: Bits of a key, and those of them that the first and second histogram tell apart.
BITS, COARSE, FINE = 60, 10, 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(ident: Column) -> Column:
    """A hash of BITS bits that any engine has: the first digits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":mix"))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size), a row for each source.

    Targets share `share` of all words by weight; a target stops at `most` times its source's size and what is over is shared
    anew. That fixed point is a water level: sources ordered by the level at which they are full, those full below it stop.
    Sources are names that a corpus is made up of, thousands at most: one task orders their rows.
    """
    num, den = share
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = F.array(*(F.lit(w) for w in weights))
    s = sizes.withColumn("w", F.element_at(every, (place - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)), "total": F.sum("source_size").over(whole)})
    s = s.withColumn("full", den * (F.col("caps") * F.col("w") + F.col("cap") * F.col("open_w")) <= num * F.col("total") * F.col("w"))
    level = (F.col("total") * (num / den) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)) / F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def _boundary(sums: DataFrame, at: str) -> DataFrame:
    """Of (source, at, s, room): the value of `at` where a source's sums pass room, the room left there, and what the sums reach there."""
    cum = F.sum("s").over(Window.partitionBy("source").orderBy(at))
    upto = sums.withColumn("cum", cum).where((F.col("cum") > F.col("room")) & (F.col("cum") - F.col("s") <= F.col("room")) & (F.col("s") > 0))
    return upto.select("source", at, (F.col("room") - F.col("cum") + F.col("s")).alias("room"), "s")


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target, copies, cut from a written table (source, size, key): documents of a source are taken
    `copies` times, and once more if their key is below cut. The document at the boundary goes in if that ends nearer."""
    by_source = save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    goal = by_source.withColumn("copies", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = goal.withColumn("room", F.col("target") - F.col("copies") * F.col("source_size"))
    coarse, fine = F.shiftright("key", BITS - COARSE), F.shiftright("key", BITS - FINE)

    def sums(rows: DataFrame, at: str, how: Column) -> DataFrame:
        return rows.groupBy("source", how.alias(at)).agg(F.sum("size").alias("s"))

    def within(rows: DataFrame, edge: DataFrame, at: str, how: Column) -> DataFrame:
        """The rows of each source's boundary bucket."""
        e = edge.select(F.col("source").alias("es"), F.col(at).alias("ea"))
        return rows.join(e, F.col("source").eqNullSafe(F.col("es")) & (how == F.col("ea"))).drop("es", "ea")

    def with_room(hist: DataFrame, edge: DataFrame) -> DataFrame:
        e = edge.select(F.col("source").alias("es"), "room")
        return hist.join(e, F.col("source").eqNullSafe(F.col("es"))).drop("es")

    one = save(_boundary(with_room(sums(sized, "b", coarse), goal), "b"), "edge")
    inside = save(within(sized, one, "b", coarse), "edge")
    two = save(_boundary(with_room(sums(inside, "b", fine), one), "b"), "edge")
    last = _boundary(with_room(sums(within(inside, two, "b", fine), "key", F.col("key")), two), "key")
    cut = F.col("key") + F.when(F.col("s") - F.col("room") < F.col("room"), 1).otherwise(0)
    last = last.select(F.col("source").alias("es"), cut.alias("cut"))
    found = goal.join(last, F.col("source").eqNullSafe(F.col("es")), "left")
    cuts = save(found.select("source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")), "cuts")
    drop(by_source, one, inside, two)
    return cuts


def _applied(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    c = cuts.withColumnRenamed("source", "cut_source")
    return rows.join(c, F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumn("times", F.col("copies") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """id_col, size, source_size, target, taken for each row of docs; other columns are ignored, whatever their names.

    Size counts words; a null or empty text has 0 and takes 0. A null source is a source of its own, last in order. Rows
    with one id (nulls included) share their hash, so they are taken equally often. Whole documents are taken: a source
    ends within half its boundary document of its target. Only ids, sizes and sources decide, so reruns agree. An empty
    table gives an empty result.
    """
    ident = column(docs, id_col)
    sized = save(docs.select(ident.alias("id"), column(docs, source_col).cast("string").alias("source"), words(column(docs, text_col).cast("string")).alias("size"), key_of(ident).alias("key")), "sized")
    got = _applied(sized, thresholds(sized.select("source", "size", "key"), **how))
    return got.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: each row of docs, all columns, as many times as it is taken. Documents without words are not."""
    names = docs.columns
    ident = column(docs, id_col)
    sized = save(docs.select(column(docs, source_col).cast("string").alias("source"), words(column(docs, text_col).cast("string")).alias("size"), key_of(ident).alias("key")), "sized")
    cuts = thresholds(sized, **how)
    rows = docs.select(F.struct(*(column(docs, c) for c in names)).alias("row"), column(docs, source_col).cast("string").alias("source"), key_of(ident).alias("key"), (F.length(F.regexp_replace(F.coalesce(column(docs, text_col).cast("string"), F.lit("")), r"^[\x20\x09-\x0D]+", "")) > 0).alias("worded"))
    taken = _applied(rows, cuts).where("times > 0 and worded")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
