"""Personal data: base patterns, and identifiers that bootstrapped contexts reveal, in DataFrame functions alone.

The base patterns' entities are the seeds. A lexical pattern is the word before or after an entity. Patterns and the values
they surround form a graph that is scored in ROUNDS rounds: a pattern is as sure as the share of all occurrences of its word,
anywhere in the corpus, that stand beside an accepted value; a value is as sure as its surest pattern. Patterns of at least
MIN_SURE, with MIN_SEEDS different values accepted so far, give the values beside them their kind: these are the identifiers
that no base pattern knows, and the next round learns from them as from the seeds. A word that also stands elsewhere in
ordinary text never gets sure, so clean texts stay clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop, save
from .spans import SPANS, digits, let, matches, ordered, overlapping, replaced, spans

ROUNDS, MIN_SURE, MIN_SEEDS = 3, 0.5, 5
#: Contexts up to this size, about in bytes, are broadcast.
SMALL = 8 << 20
#: Words and values longer than this are known by a digest of theirs.
LONG = 64
#: Fixed: the kinds, in the order in which spans are listed, and their patterns. Each is tried from the start of a run of its
#: first characters (or where the match before it ended) and its repeats are possessive: no match changes by that, and a long
#: run that fails is read once instead of once from each character.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"  # shorter runs of digits fail whole, so they need no match
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_TOKEN = rf"(?<!{_WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+"
#: Punctuation around a value is none of it.
_AROUND = r"^[^0-9A-Za-z@+(]++|(?:\G|(?<![^0-9A-Za-z)]))[^0-9A-Za-z)]++\z"


def short(word: Column) -> Column:
    """word, or where it is long (a text without spaces is one word) a digest, so that what is counted stays narrow."""
    return F.when(F.length(word) > LONG, F.md5(word)).otherwise(word)


def _luhn(m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return F.when((n >= 16) & (n <= 19), total % 10 == 0).otherwise(False)


def _ip_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).cast("int"), F.lit(0)) <= 255))


def _phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def base_spans(text: Column) -> Column:
    """The base patterns' spans by kind as listed, then start."""
    number = text.rlike("[0-9]")
    return F.concat(
        spans(text, "email", EMAIL, None, text.contains("@")),
        spans(text, "ip", IP, _ip_ok, number),
        spans(text, "card", CARD, _luhn, number),
        spans(text, "phone", PHONE, _phone_ok, text.contains("+")),
    )


def _candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, left, right, value, kind>>: the tokens with a digit or @ that may be identifiers, the words beside
    them, and the kind of the base span on them, if any."""

    def words_beside(found: Column) -> Column:
        gaps = F.split(text, _TOKEN, -1)
        left = F.transform(gaps, lambda g: short(F.lower(F.regexp_extract(g, rf"(?s)^.*(?<!{_WORD})({_WORD}++){_SPACE}*+\z", 1))))
        right = F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda g: short(F.lower(F.regexp_extract(g, rf"^{_SPACE}*+({_WORD}++)", 1))))
        zipped = F.filter(F.arrays_zip(found.alias("f"), left.alias("left"), right.alias("right")), lambda z: z["f"].isNotNull())
        return F.transform(zipped, lambda z: F.struct(z["f"]["start"].alias("start"), z["f"]["end"].alias("end"), z["left"].alias("left"), z["right"].alias("right"), F.regexp_replace(z["f"]["m"], _AROUND, "").alias("value")))

    def with_kind(c: Column, hit: Column) -> Column:
        kind = F.when(F.size(hit) > 0, hit[0]["kind"])
        named = F.when(kind.isNotNull() | (F.length(digits(c["value"])) >= 4) | c["value"].contains("@"), short(c["value"]))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["left"].alias("l"), c["right"].alias("r"), named.alias("value"), kind.alias("kind"))

    found = F.filter(overlapping(words_beside(matches(text, _TOKEN)), base, with_kind), lambda c: c["value"].isNotNull())
    return F.when(text.rlike("[0-9@]"), found)


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (of the text), base, cands: what one pass over the texts gives, written down."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("id"), text.alias("text"))
    both = let(base_spans(F.col("text")), lambda base: F.struct(base.alias("base"), _candidates(F.col("text"), base).alias("cands")))
    return save(rows.select("id", F.xxhash64("text").alias("h"), both.alias("f")).select("id", "h", "f.base", "f.cands"), "pii")


def surest(kind: str, score: Column) -> Column:
    """The kind of the highest score, the last of them in order where several have it."""
    return F.max_by(kind, F.struct(score, F.col(kind)))


def learned_spans(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """id, h, more (SPANS): what the patterns learned from found add. Written down, a row for each document with such spans."""
    each = found.where(F.size("cands") > 0).select("id", "h", F.explode("cands").alias("c")).select("id", "h", "c.*")
    sides = each.select("value", "kind", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("word")), F.struct(F.lit("r").alias("side"), F.col("r").alias("word")))).alias("p"))
    graph = sides.where(F.length("p.word") > 1).groupBy("p.side", "p.word", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    graph = save(graph, "graph")
    none = found.sparkSession.createDataFrame([], f"id {dict(found.dtypes)['id']}, h long, more {SPANS}")
    text = F.lower(F.coalesce(column(docs, text_col).cast("string"), F.lit("")))
    every = docs.select(F.explode(F.split(text, _SPACE + "+")).alias("w")).select(short(F.col("w")).alias("word"))

    def totals_of(contexts: DataFrame) -> DataFrame | None:
        """word, total: how often each context stands anywhere."""
        size = contexts.agg(F.sum(F.octet_length("word") + 64)).first()[0]
        if size is None:
            return None
        # Few contexts filter the words where they are read; else words are counted first, so that none is shuffled row by row.
        small = size <= SMALL
        counted = (every.join(F.broadcast(contexts), "word") if small else every).groupBy("word").agg(F.count(F.lit(1)).alias("total"))
        counted = save(counted if small else counted.join(contexts, "word"), "totals")
        done.append(counted)
        return counted

    # A table: a union of two aggregations by value would pass for one that is dealt by value, though AQE may coalesce each otherwise.
    seeds = save(graph.where("kind is not null").groupBy("value").agg(F.max("kind").alias("vkind"), F.lit(1.0).alias("score")), "seeds")
    scored, totals, done = seeds, None, [seeds]
    for n in range(1, ROUNDS + 1):
        # Ties go to the later kind, and scores are rounded, so that reruns agree whatever the order of rows.
        weight = F.round(F.col("n") * F.col("score"), 9)
        met = graph.join(scored, "value").groupBy("side", "word").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("values"), surest("vkind", weight).alias("pkind"))
        met = save(met.where(F.col("values") >= MIN_SEEDS), "met")
        # Contexts that may get sure enough in this round; those new to it are counted.
        words = met.select("word").distinct()
        contexts = save(words if totals is None else words.join(totals, "word", "left_anti"), "contexts")
        done += [met, contexts]
        more = totals_of(contexts)
        if more is not None:
            totals = more if totals is None else totals.unionByName(more)
        if totals is None:
            return none
        rules = met.join(totals, "word").withColumn("sure", F.round(F.col("weight") / F.col("total"), 9))
        rules = save(rules.where(F.col("sure") >= MIN_SURE).select("side", "word", "sure", "values", "pkind"), "patterns")
        if rules.isEmpty():
            return none
        done.append(rules)
        if n == ROUNDS:
            break
        new = graph.join(rules, ["side", "word"]).groupBy("value").agg(surest("pkind", F.col("sure")).alias("vkind"), F.max(F.least("sure", F.lit(1.0))).alias("score"))
        scored = save(seeds.unionByName(new).groupBy("value").agg(surest("vkind", F.col("score")).alias("vkind"), F.max("score").alias("score")), "scores")
        done.append(scored)
    by = lambda side: each.where("kind is null").join(rules.where(F.col("side") == side).select(F.col("word").alias(side), "pkind", "sure"), side)
    fresh = by("l").unionByName(by("r")).groupBy("id", "h", "start", "end").agg(surest("pkind", F.col("sure")).alias("kind"))
    fresh = fresh.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).cast(SPANS).alias("more"))
    out = save(fresh, "learned")
    drop(graph, *done)
    return out


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    m = more.select(F.col("id").alias("mid"), F.col("h").alias("mh"), "more")
    joined = rows.join(m, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")), "left")
    return joined.withColumn("all", ordered(F.concat("base", F.coalesce("more", F.array().cast(SPANS))), KINDS, True)).drop("mid", "mh", "more")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (SPANS of the base patterns), spans (those and the learned ones) for each row of docs.

    Places are code points, end exclusive; both lists go by kind as in KINDS, then start. A null text is empty and has none;
    repeated rows and null ids are searched each; other columns are ignored. An empty table gives an empty result.
    """
    found = _found(docs, id_col, text_col)
    rows = _with_more(found.select("id", "h", "base"), learned_spans(docs, found, text_col))
    return rows.select(F.col("id").alias(id_col), "base", F.col("all").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind in angle brackets; overlapping spans go as one, under the first
    one's kind. Null texts stay null, all other columns as they are."""
    found = _found(docs, id_col, text_col)
    more = learned_spans(docs, found, text_col)
    names = docs.columns
    rows = docs.select(F.struct(*(column(docs, c) for c in names)).alias("row"), column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    rows = _with_more(rows, more)
    rows = rows.withColumn("clean", replaced(F.col("text"), F.col("all"), lambda kind: F.concat(F.lit("<"), F.upper(kind), F.lit(">"))))
    kept = [F.when(F.col("row")[c].isNotNull(), F.col("clean")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return rows.select(*kept)
