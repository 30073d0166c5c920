"""Column helpers for text: computed regex replacements, Unicode white space, lines, token estimates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens per word, as a fraction so that counts stay whole numbers.
TOKENS_NUM, TOKENS_DEN = 13, 10
#: Fixed: all that (?U)\\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places at which a match might begin, of a pattern that looks far ahead, that are few.
FEW = 64


def sub(text: Column, pattern: str, replacement: str) -> Column:
    """regexp_replace with a literal replacement unless it holds $n groups."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def let(value: Column, how: Callable[[Column], Column]) -> Column:
    """how(value) with value computed once, however often how names it."""
    return F.transform(F.array(value), how)[0]


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added or replaced, as a step of its own.

    Catalyst copies what a projection computes into every filter and projection above that names it, so a chain of long
    expressions grows with each link. A generator of one row is a boundary that nothing is copied across.
    """
    one = F.explode_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__staged")
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", one).select(*kept, *(F.col("__staged")[n].alias(n) for n in columns))


def upto(text: Column, mark: str, how: Callable[[Column], Column], beyond: str = "") -> Column:
    """how() of the text up to its last mark and what matches beyond there, then the rest as it is: for what finds nothing without a
    mark, so that long plain ends are not searched."""

    def apply(t: Column, rest: Column) -> Column:
        head = lambda tail: F.substring(t, F.lit(1), F.length(t) - F.length(tail))
        cut = lambda tail: F.concat(how(head(tail)), tail)
        return F.when(F.length(rest) == F.length(t), t).otherwise(let(sub(rest, beyond, ""), cut) if beyond else cut(rest))

    return let(text, lambda t: let(F.substring_index(t, mark, -1), lambda rest: apply(t, rest)))


def where(text: Column, mark: str, how: Callable[[Column], Column]) -> Column:
    """how() of a text that has the mark, others as they are."""
    return let(text, lambda t: F.when(t.contains(mark), how(t)).otherwise(t))


def replace_each(text: Column, pattern: str, how: Callable[..., Column], groups: tuple[int, ...] = (1,)) -> Column:
    """Replaces every match by how(ordinal, *captures), a computed value; the pattern must never match an empty string."""

    def apply(t: Column) -> Column:
        found = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))
        new = F.transform(found, lambda m, i: how(i, *(F.coalesce(m[f"g{g}"], F.lit("")) for g in groups)))
        pieces = F.zip_with(F.split(t, pattern, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return let(text, apply)


def replace_tokens(text: Column, pattern: str, begin: str, dead: str, other: str, how: Callable[..., Column], groups: int) -> Column:
    """replace_each() in time linear in the text, for a pattern that looks far ahead from each place where it might begin.

    begin is what each match begins with. The whole text is cut into tokens, one after another: a match; dead, what can hold no match's beginning once the match fails
    here; other, a run in which no match begins. how gets the captures. Where few matches might begin, replace_each() is linear
    too, and faster."""
    token = rf"(?s)\G(?:{pattern}|{dead}|{other})"
    part = lambda g: F.regexp_extract_all(text, F.lit(token), F.lit(g))
    tokens = F.arrays_zip(*(part(g).alias(f"g{g}") for g in range(groups + 1)))
    # A match has all its captures; they are never empty.
    made = F.transform(tokens, lambda t: F.when(t["g1"] != "", how(*(t[f"g{g}"] for g in range(1, groups + 1)))).otherwise(t["g0"]))
    plain = replace_each(text, pattern, lambda _, *found: how(*found), tuple(range(1, groups + 1)))
    return F.when(F.regexp_count(text, F.lit(begin)) <= FEW, plain).otherwise(F.array_join(made, ""))


def enclosed(text: Column, opening: str, closing: str, how: Callable[[Column], Column]) -> Column:
    """Each closing mark with the first opening one since the closing before it, and what they enclose, replaced by how of that.
    The text is parted at closing marks, so marks that do not close cost nothing."""

    def segment(part: Column, last: Column) -> Column:
        found = lambda at: F.when(at > 0, F.concat(F.substring(part, F.lit(1), at - 1), how(F.substring(part, at + len(opening), F.length(part))))).otherwise(F.concat(part, F.lit(closing)))
        return F.when(last, part).otherwise(let(F.locate(opening, part), found))

    parts = let(F.split(text, re.escape(closing), -1), lambda p: F.transform(p, lambda x, i: segment(x, i == F.size(p) - 1)))
    return F.when(text.contains(opening) & text.contains(closing), F.array_join(parts, "")).otherwise(text)


def strip(text: Column) -> Column:
    """Drops white space, Unicode's too, from both ends: only the ends are looked at, no pattern goes over the text."""
    return rstrip(F.ltrim(text, F.lit(WHITE)))


def rstrip(text: Column) -> Column:
    """A trim from the right lists all characters, so it is done only where the last byte can end white space."""
    last = lambda t: F.substring(t.cast("binary"), -1, 1)
    return let(text, lambda t: F.when(last(t).between(F.lit(b"!"), F.lit(b"\x7f")), t).otherwise(F.rtrim(t, F.lit(WHITE))))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def per_line(text: Column, how: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(lines(text), how), "\n")


def full_lines(text: Column) -> Column:
    """The lines that are not blank, stripped."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def words(text: Column) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def tokens_of(count: Column) -> Column:
    return F.floor(count * TOKENS_NUM / TOKENS_DEN).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Tokens that a text is likely to have, from its words."""
    return tokens_of(n_words(text))


def max_words(tokens: int) -> int:
    """Words that fill so many tokens."""
    return tokens * TOKENS_DEN // TOKENS_NUM


def lexical_tokens(text: Column) -> Column:
    """Lower-case ASCII words; a word with underscores is followed by its parts."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    parted = lambda t: F.when(t.contains("_"), F.concat(F.array(t), F.filter(F.split(t, "_", -1), lambda p: p != ""))).otherwise(F.array(t))
    return F.when(text.contains("_"), F.flatten(F.transform(found, parted))).otherwise(found)
