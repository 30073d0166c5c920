"""Secrets: base patterns, and weak candidates that only their company betrays, in DataFrame functions alone.

A credential often comes in parts: an access identifier, a secret and an endpoint. Each part alone is weak (a long mixed token
may be anything), so weak parts are linked by an interval join within a scope of SCOPE characters of one document: a weak
secret is reported if an identifier lies in its scope, a weak identifier if a secret does, an endpoint if such a linked secret
does. Parts that overlap are no company for each other, and a token inside a weak identifier is no secret. Parts are brought
together by buckets of SCOPE characters, and a bucket keeps the outermost places of its parts only, so a document with
thousands of parts costs as many rows, not their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop, save
from .spans import SPANS, let, matches, ordered, overlapping, spans

SCOPE = 256
#: Fixed: base kinds in listed order and their patterns; then the weak parts' kinds and patterns.
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
WEAK_KINDS = ["weak_id", "weak_secret", "endpoint"]
WEAK_ID = r"""(?:(?i:client|account|access_?key|user)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_-]{6,64}+|(?<![A-Z0-9])A[GS]IA[A-Z0-9]{16}(?![A-Z0-9]))"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]++"""


def _assigned(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]") & ~m.rlike("^[/]")


def base_spans(text: Column) -> Column:
    """The base patterns' spans by start, then kind as listed."""
    named = text.rlike("(?i:password|passwd|secret|token|api_?key)")
    found = F.concat(spans(text, "assign", ASSIGN, _assigned, named), spans(text, "access", ACCESS, None, text.contains("AKIA")), spans(text, "hex", HEX))
    return ordered(found, KINDS, False)


def weak_spans(text: Column) -> Column:
    return F.concat(spans(text, "weak_id", WEAK_ID, None, text.rlike("(?i:id[\"']?\\x20*[:=])|A[GS]IA")), spans(text, "weak_secret", WEAK_SECRET, _mixed), spans(text, "endpoint", ENDPOINT, None, text.contains("://")))


def apart(base: Column, weak: Column) -> Column:
    """The weak spans that overlap no base span; a token inside a weak identifier is no secret."""

    def alone(w: Column, hits: Column) -> Column:
        inside = lambda h: (w["kind"] == "weak_secret") & (h["kind"] == "weak_id") & (h["start"] <= w["start"]) & (h["end"] >= w["end"])
        return F.when(~F.exists(hits, lambda h: ~h["kind"].isin(WEAK_KINDS) | inside(h)), w)

    by_start = ordered(weak, WEAK_KINDS, False)
    return let(by_start, lambda ws: F.array_compact(overlapping(ws, F.concat(base, F.filter(ws, lambda w: w["kind"] == "weak_id")), alone)))


def near(parts: DataFrame, others: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts (id, h, kind, start, end) with another part of the same document beside them, at most scope characters away."""
    bin_ = lambda c: F.floor(c / scope).cast("long")
    place = lambda side, c: F.struct(F.lit(side).alias("oside"), bin_(c).alias("obin"), c.alias("at"))
    o = others.select(F.col("id").alias("oid"), F.col("h").alias("oh"), F.explode(F.array(place("end", F.col("end")), place("start", F.col("start")))).alias("o")).select("oid", "oh", "o.*")
    o = o.groupBy("oid", "oh", "oside", "obin").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    # Another part ends in the scope before this one, or starts in the scope after it. A scope lies in two buckets: all places of
    # the first are low enough and all of the second high enough, so one outermost place decides in each.
    span = lambda side, a, b: F.transform(F.array(bin_(a), bin_(b)), lambda x: F.struct(F.lit(side).alias("side"), x.alias("bin"), a.alias("a"), b.alias("b")))
    p = parts.select("id", "h", "kind", "start", "end", F.explode(F.concat(span("end", F.col("start") - scope, F.col("start")), span("start", F.col("end"), F.col("end") + scope))).alias("p"))
    p = p.select("id", "h", "kind", "start", "end", "p.*")
    met = p.join(o, F.col("id").eqNullSafe(F.col("oid")) & (F.col("h") == F.col("oh")) & (F.col("side") == F.col("oside")) & (F.col("bin") == F.col("obin")))
    return met.where((F.col("high") >= F.col("a")) & (F.col("low") <= F.col("b"))).select("id", "h", "kind", "start", "end").distinct()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base (SPANS of the base patterns), spans (those and the linked weak parts) for each row of docs.

    Places are code points, end exclusive; both lists go by start, then kind as listed. A weak part that overlaps a base span
    is that span and not reported again. A null text is empty and has none; repeated rows and null ids are searched each;
    other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("id"), text.alias("text"))
    both = let(base_spans(F.col("text")), lambda base: F.struct(base.alias("base"), apart(base, weak_spans(F.col("text"))).alias("weak")))
    found = save(rows.select("id", F.xxhash64("text").alias("h"), both.alias("f")).select("id", "h", "f.base", "f.weak"), "secrets")
    parts = found.where(F.size("weak") > 0).select("id", "h", F.explode(F.concat("base", "weak")).alias("s")).select("id", "h", "s.*").distinct()
    parts = save(parts, "parts")
    ids, keys = parts.where("kind in ('access', 'weak_id')"), parts.where("kind in ('assign', 'hex', 'weak_secret')")
    linked = save(near(parts.where("kind = 'weak_secret'"), ids).unionByName(near(parts.where("kind = 'weak_id'"), keys)), "linked")
    sure = linked.where("kind = 'weak_secret'").unionByName(near(keys.where("kind <> 'weak_secret'"), ids))
    more = linked.unionByName(near(parts.where("kind = 'endpoint'"), sure))
    more = save(more.groupBy(F.col("id").alias("mid"), F.col("h").alias("mh")).agg(F.collect_list(F.struct("kind", "start", "end")).cast(SPANS).alias("more")), "more")
    drop(parts, linked)
    out = found.join(more, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")), "left")
    return out.select(F.col("id").alias(id_col), "base", ordered(F.concat("base", F.coalesce("more", F.array().cast(SPANS))), KINDS + WEAK_KINDS, False).alias("spans"))


__all__ = ["base_spans", "matches", "near", "secrets", "weak_spans"]
