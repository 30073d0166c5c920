"""Splitting, packing and merging of texts into token-bounded chunks, as Column functions over arrays.

A document's chunks are arrays in its own row, so all this is projection: nothing is shuffled until chunks become rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import QUESTION
from .text import estimate_tokens, let, max_words, n_words, strip, tokens_of, words

MAX_TOKENS, OVERLAP_TOKENS, MIN_TOKENS, HARD_TOKENS = 400, 50, 50, 512
HEADING = r"(?mdU)^#{1,6}\s+(.+)$"
_HEADING_LINE = r"\n#{1,6}[^\S\n]+([^\n]+)"
SECTIONS = "array<struct<heading:string,content:string>>"
_PARTS = "array<struct<text:string,big:boolean>>"
_ITEM = "struct<heading:string,content:string,n:bigint>"


def _sections(headings: Column, bodies: Column) -> Column:
    return F.zip_with(headings, bodies, lambda h, b: F.struct(h.alias("heading"), b.alias("content"))).cast(SECTIONS)


def split_by_headings(text: Column) -> Column:
    """SECTIONS between Markdown headings; the text before the first has an empty heading and goes if it is blank."""
    titles = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), strip)
    every = _sections(F.concat(F.array(F.lit("")), titles), F.transform(F.split(text, HEADING, -1), strip))
    kept = F.filter(every, lambda s: (s["content"] != "") | (s["heading"] != ""))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.struct(F.lit("").alias("heading"), strip(text).alias("content"))).cast(SECTIONS)))


def split_qa(text: Column) -> Column:
    """SECTIONS of questions with their answers: a question line starts a new one, but for the first below a heading."""
    whole = F.concat(F.lit("\n"), text)
    titles = F.transform(F.regexp_extract_all(whole, F.lit(_HEADING_LINE), F.lit(1)), strip)
    every = _sections(F.concat(F.array(F.lit("")), titles), F.split(whole, _HEADING_LINE, -1))

    def parts(section: Column) -> Column:
        return let(F.substring(section, F.lit(2), F.length(section)), lambda body: let(F.split(body, rf"\n(?=[^\n]*{QUESTION})", -1), lambda pieces: regrouped(body, pieces)))

    def regrouped(body: Column, pieces: Column) -> Column:
        opens = F.substring_index(body, "\n", 1).contains(QUESTION)
        joined = F.concat(F.array(F.concat(pieces[0], F.lit("\n"), F.try_element_at(pieces, F.lit(2)))), F.slice(pieces, F.lit(3), F.greatest(F.size(pieces) - 2, F.lit(0))))
        return F.when(opens | (F.size(pieces) < 2), pieces).otherwise(joined)

    found = F.flatten(F.transform(F.filter(every, lambda s: s["content"] != ""), lambda s: F.transform(parts(s["content"]), lambda p: F.struct(s["heading"].alias("heading"), p.alias("content"))))).cast(SECTIONS)
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.struct(F.lit("").alias("heading"), text.alias("content"))).cast(SECTIONS)))


def word_windows(text: Column, size: int) -> Column:
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size)), lambda i: i <= F.size(w))
    return let(words(text), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))


def pack(parts: Column, max_tokens: int) -> Column:
    """Joins consecutive parts by a blank line as long as they fit; a part that is too large alone stays so and is marked."""
    trimmed = F.filter(F.transform(parts, strip), lambda p: p != "")
    counted = F.transform(trimmed, lambda p: F.struct(p.alias("p"), n_words(p).alias("w")))
    start = F.struct(F.array().cast(_PARTS).alias("out"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("n"))
    one = lambda text, big: F.array(F.struct(text.alias("text"), F.lit(big).alias("big"))).cast(_PARTS)

    def step(acc: Column, x: Column) -> Column:
        closed = F.when(acc["cur"] != "", F.concat(acc["out"], one(acc["cur"], False))).otherwise(acc["out"])
        fits, big = tokens_of(acc["n"] + x["w"]) <= max_tokens, tokens_of(x["w"]) > max_tokens
        grown = F.struct(acc["out"].alias("out"), F.when(acc["cur"] == "", x["p"]).otherwise(F.concat(acc["cur"], F.lit("\n\n"), x["p"])).alias("cur"), (acc["n"] + x["w"]).alias("n"))
        alone = F.struct(F.concat(closed, one(x["p"], True)).alias("out"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("n"))
        fresh = F.struct(closed.alias("out"), x["p"].alias("cur"), x["w"].alias("n"))
        return F.when(fits, grown).when(big, alone).otherwise(fresh)

    return F.aggregate(counted, start, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], one(acc["cur"], False))).otherwise(acc["out"]))


def _once(text: Column, max_tokens: int) -> Column:
    """The parts of a text that is too large: by paragraphs, else by lines, else by sentences, else by words."""
    parts = F.when(text.contains("\n\n"), F.split(text, r"\n\n+", -1)).when(text.contains("\n"), F.split(text, "\n", -1)).otherwise(F.split(text, r"(?U)(?<=[.!?])\s+", -1))
    cut = F.transform(word_windows(text, max_words(max_tokens)), lambda t: F.struct(t.alias("text"), F.lit(False).alias("big"))).cast(_PARTS)
    splits = text.contains("\n") | text.rlike(r"(?U)[.!?]\s")
    return F.when(splits, pack(parts, max_tokens)).otherwise(cut)


def split_paragraphs(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """array<string>: text in pieces of at most max_tokens. Each of the four splitters can find work once, so four rounds do."""
    again = lambda found: F.flatten(F.transform(found, lambda p: F.when(p["big"], _once(p["text"], max_tokens)).otherwise(F.array(p))))
    found = _once(text, max_tokens)
    for _ in range(3):
        found = let(found, lambda f: F.when(F.exists(f, lambda p: p["big"]), again(f)).otherwise(f))
    pieces = F.transform(found, lambda p: p["text"])
    small = F.when(strip(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(estimate_tokens(text) <= max_tokens, small).otherwise(pieces)


def continued(heading: Column, i: Column) -> Column:
    """The heading of a piece: pieces after the first of a section say that they go on."""
    return F.when((i > 0) & (heading != ""), F.concat(heading, F.lit(" (cont.)"))).otherwise(heading)


def split_sections(sections: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """SECTIONS of at most max_tokens each; blank ones go."""
    full = F.filter(sections, lambda s: strip(s["content"]) != "")
    pieces = lambda s: F.transform(split_paragraphs(s["content"], max_tokens), lambda p, i: F.struct(continued(s["heading"], i).alias("heading"), p.alias("content")))
    return F.flatten(F.transform(full, pieces)).cast(SECTIONS)


def _merge_pass(items: Column, min_tokens: int, max_tokens: int) -> Column:
    """One pass over items: a tiny one joins the one before it if that fits, or else waits to be joined to the next."""
    none = F.lit(None).cast(_ITEM)
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), none.alias("last"), none.alias("wait"))
    fits = lambda a, b: F.coalesce(tokens_of(a["n"] + b["n"]) <= max_tokens, F.lit(False))
    joined = lambda a, b, h: F.struct(h.alias("heading"), F.concat(a["content"], F.lit("\n\n"), b["content"]).alias("content"), (a["n"] + b["n"]).alias("n")).cast(_ITEM)
    put = lambda out, x: F.when(x.isNotNull(), F.concat(out, F.array(x))).otherwise(out)

    def step(acc: Column, item: Column) -> Column:
        # First what waits goes into the item, or goes its own way; then the item is placed.
        taken = fits(acc["wait"], item)
        x = F.when(taken, joined(acc["wait"], item, F.when(acc["wait"]["heading"] != "", acc["wait"]["heading"]).otherwise(item["heading"]))).otherwise(item)
        freed = acc["wait"].isNotNull() & ~taken
        settled = F.struct(F.when(freed, put(acc["out"], acc["last"])).otherwise(acc["out"]).alias("out"), F.when(freed, acc["wait"]).otherwise(acc["last"]).alias("last"), x.alias("x"))
        return let(settled, lambda s: F.when(
            (tokens_of(s["x"]["n"]) < min_tokens) & fits(s["last"], s["x"]), F.struct(s["out"].alias("out"), joined(s["last"], s["x"], s["last"]["heading"]).alias("last"), none.alias("wait"))
        ).when(
            tokens_of(s["x"]["n"]) < min_tokens, F.struct(s["out"].alias("out"), s["last"].alias("last"), s["x"].alias("wait"))
        ).otherwise(F.struct(put(s["out"], s["last"]).alias("out"), s["x"].alias("last"), none.alias("wait"))))

    return F.aggregate(items, start, step, lambda acc: put(put(acc["out"], acc["last"]), acc["wait"]))


def merge_tiny(sections: Column, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS, passes: int = 5) -> Column:
    """SECTIONS without pieces of less than min_tokens where they fit a neighbour; passes beyond the last change do nothing."""
    full = F.filter(F.transform(sections, lambda s: F.struct(s["heading"].alias("heading"), strip(s["content"]).alias("content"))), lambda s: s["content"] != "")
    items = F.transform(full, lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"), n_words(s["content"]).alias("n"))).cast(f"array<{_ITEM}>")
    for _ in range(passes):
        tiny = lambda x: F.exists(x, lambda i: tokens_of(i["n"]) < min_tokens)
        items = let(items, lambda x: F.when(tiny(x), _merge_pass(x, min_tokens, max_tokens)).otherwise(x))
    return F.transform(items, lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"))).cast(SECTIONS)


def add_overlap(sections: Column, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """SECTIONS, each after the first led by the last words of the one before it, if that one has more words than these."""
    n = max_words(overlap_tokens)
    if n <= 0:
        return sections
    before = F.concat(F.array(F.array().cast("array<string>")), F.transform(sections, lambda s: words(s["content"])))
    lead = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " ")
    both = F.zip_with(sections, F.slice(before, F.lit(1), F.size(sections)), lambda s, w: F.struct(s["heading"].alias("heading"), F.when(F.size(w) > n, F.concat(lead(w), F.lit("\n\n"), s["content"])).otherwise(s["content"]).alias("content")))
    return both.cast(SECTIONS)


def hard_cap(sections: Column, tokens: int = HARD_TOKENS) -> Column:
    """SECTIONS with those of more than `tokens` cut into windows of words."""
    one = lambda s: F.array(s)
    cut = lambda s: F.transform(word_windows(s["content"], max_words(tokens)), lambda p, i: F.struct(continued(s["heading"], i).alias("heading"), p.alias("content")))
    return F.flatten(F.transform(sections, lambda s: F.when(estimate_tokens(s["content"]) > tokens, cut(s)).otherwise(one(s)))).cast(SECTIONS)
