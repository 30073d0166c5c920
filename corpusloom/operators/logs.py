"""Feedback and conversation logs: keyed, append-ordered records with a seq column for their place in the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered

HISTORY, CUT, RECENT, TITLE = 6, 300, 20, 50


def contextual_query(query: Column, history: Column) -> Column:
    """The query after the last messages of history (array<struct<role, content>>), long ones cut; the query alone if there
    are none. Whoever is not the user counts as the assistant."""
    history = F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))
    last = F.slice(history, F.greatest(F.size(history) - HISTORY + 1, F.lit(1)), F.lit(HISTORY))

    def said(m: Column) -> Column:
        short = F.when(F.length(m["content"]) > CUT, F.concat(F.substring(m["content"], 1, CUT), F.lit("..."))).otherwise(m["content"])
        return F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), short)

    talk = F.array_join(F.transform(last, said), "\n")
    return F.when(F.size(history) > 0, F.concat(F.lit("[Previous conversation]\n"), talk, F.lit("\n\n[Current question]\n"), query)).otherwise(query)


def title(messages: Column) -> Column:
    """The start of the first user message, else Untitled."""
    asked = F.filter(messages, lambda m: m["role"] == "user")
    return F.when(F.size(asked) > 0, F.substring(asked[0]["content"], 1, TITLE)).otherwise("Untitled")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, title, messages, message_count from a row for each turn (conv_id, turn, role, text). A conversation is one
    record, so its turns meet in one row; they are gathered by key alone."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    rows = rows.withColumn("messages", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return rows.select("conv_id", title(F.col("messages")).alias("title"), "messages", F.size("messages").cast("long").alias("message_count"))


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last entry of each key, as a listing shows it. Only a maximum is kept for a key, however often it was written."""
    return _one(log, key, F.max_by(F.struct(*log.columns), seq))


def earliest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The first entry of each key, as a lookup finds it."""
    return _one(log, key, F.min_by(F.struct(*log.columns), seq))


def _one(log: DataFrame, key: str, pick: Column) -> DataFrame:
    return log.groupBy(F.col(key).alias("__key")).agg(pick.alias("__row")).select("__row.*")


def lookup(log: DataFrame, key: str, value) -> DataFrame:
    return log.where(F.col(key) == value).orderBy("seq").limit(1)


def upsert(log: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """log with every entry of a changed key replaced by its last change, and new keys appended."""
    last = latest(changes, key)
    new = last.select(*log.columns)
    hit = log.join(new.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    kept = hit.where("__k is null").drop("__k")
    places = log.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__times"))
    times = new.join(places, F.col(key) == F.col("__k"), "left").withColumn("__times", F.coalesce("__times", F.lit(1)))
    return kept.unionByName(times.select(*log.columns, F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__i")).drop("__i"))


def delete(log: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """log without the entries of the keys."""
    return log.join(keys.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def feedback_stats(log: DataFrame) -> DataFrame:
    """One row: total, up, down, and the share of up in whole percent, halves rounded up."""
    up, down = (F.coalesce(F.sum(F.when(F.col("rating") == r, 1)), F.lit(0)).cast("long") for r in ("up", "down"))
    counts = log.agg(F.count(F.lit(1)).alias("total"), up.alias("up"), down.alias("down"))
    return counts.withColumn("up_percent", F.when(F.col("total") > 0, F.floor(F.col("up") * 100 / F.col("total") + 0.5)).cast("long"))


def recent(log: DataFrame, n: int = RECENT, seq: str = "seq") -> DataFrame:
    """The last n entries: each task keeps n, then these are merged."""
    return log.orderBy(F.desc(seq)).limit(n)


def relative_time(now: Column, then: Column) -> Column:
    """Just now, minutes or hours ago, else the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, "Just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.date_format(then, "yyyy-MM-dd"))


def ranked_by_time(log: DataFrame) -> DataFrame:
    """log with place from 1, newest first by updated_at; ties by conversation_id, null times last."""
    return numbered(log, [F.desc_nulls_last("updated_at"), F.asc("conversation_id")], "place").withColumn("place", F.col("place") + 1)
