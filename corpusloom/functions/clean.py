"""Cleaning, filtering and classifying of Markdown documents, as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import estimate_tokens, full_lines, let, lines, per_line, rstrip, strip, sub, where

#: Fixed: entities in decoding order.
ENTITIES = (("&rarr;", "->"), ("&larr;", "<-"), ("&radic;", "sqrt"), ("&mu;", "mu"), ("&ge;", ">="), ("&le;", "<="), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&nbsp;", " "))
SIGNATURE = r"(?mdU)^(?:—|--)\s*([A-Za-z][A-Za-z0-9_ ]*?)(?:\s*[-,]\s*(.+?))?\s*$"
QUESTION, ANSWER = "\U0001f534", "\U0001f7e2"
URL = r"(?U)https?://\S+"
#: Fixed: the status signs that plain_text() drops.
_SIGNS = "\U0001f534\U0001f7e2\U0001f535\u2139\ufe0f\u2705\u2714\u274c"
MIN_CHARS, MINIMAL = 50, 200
#: More characters than the part of an address has that URL does not yet match.
_CUT = 16
INSUFFICIENT, MOSTLY_LINKS, EMPTY = "insufficient_content", "mostly_links", "empty_after_cleaning"


def signature(text: Column) -> Column:
    """struct<author, date> of the last signature line; empty strings if there is none."""
    # The text is searched once; its last match is the same match by itself.
    part = lambda last, g: strip(F.regexp_extract(last, SIGNATURE, g))
    last = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(0)), F.lit(-1)), F.lit(""))
    return let(last, lambda x: F.struct(part(x, 1).alias("author"), part(x, 2).alias("date")))


def without_signatures(text: Column) -> Column:
    return sub(text, SIGNATURE, "")


def clean_text(text: Column) -> Column:
    """Drops HTML and what conversion left behind; keeps the words. Fixed: the patterns, and their order, as it shows in the result."""
    # Each step looks only at texts that have what it begins or ends with; marks that begin with a rare character are found fastest.
    text = where(text, "\r", lambda t: sub(t, "\r\n?", "\n"))
    text = where(text, "<", lambda t: where(t, "sticky>", lambda x: sub(x, "</?sticky>", "")))
    text = where(text, "=", lambda t: where(t, "hideimg", lambda x: sub(x, r"""(?U)["\s]*hideimg(?:right|left)=["\s]*["}%]*""", "")))
    text = where(text, '="hide', lambda t: sub(t, r"""(?U)["\s]*start="hide\s*"["\s}%]*""", ""))
    text = where(text, "}%", lambda t: sub(t, r"""(?mdU)^["\s]*\}%\s*$""", ""))
    text = where(text, "<", _without_tags)
    text = where(text, "&", _decoded)
    text = where(text, '" role="presentation">', lambda t: sub(t, '" role="presentation">[^<]*', ""))
    text = where(text, "\n\n\n", lambda t: sub(t, r"\n{3,}", "\n\n"))
    return strip(per_line(text, rstrip))


def _without_tags(text: Column) -> Column:
    text = sub(text, "(?s)<!--.*?-->", "")
    text = sub(text, r"(?iU)<br\s*/?>", "\n")
    text = sub(text, "(?i)</?center>", "")
    for tag in ("p", "span", "a"):
        text = sub(text, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", "$1")
    text = sub(text, r"(?i)<img[^>]*/?\s*>", "")
    return sub(text, "<[^>]+>", "")


def _decoded(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = where(text, entity, lambda t, e=entity, p=plain: F.replace(t, F.lit(e), F.lit(p)))
    return sub(text, "&#x?[0-9a-fA-F]+;", "")


def plain_text(cleaned: Column) -> Column:
    """What is left of a cleaned text without marks, addresses and status signs, on one line."""
    text = where(cleaned, "#", lambda t: sub(t, r"(?mdU)^#+\s*", ""))
    text = sub(text, r"[*_`~\[\](){}|#>!]", "")
    text = where(text, "://", lambda t: sub(t, URL, ""))
    text = let(text, lambda t: F.when(reduce(or_, map(t.contains, _SIGNS)), sub(t, f"[{_SIGNS}]", "")).otherwise(t))
    return strip(sub(text, r"(?U) \s+|[^\S ]\s*", " "))  # single blanks stay as they are


def plain_start(cleaned: Column, least: int) -> Column:
    """plain_text() of what begins a cleaned text, if that has `least` characters or more, else of all: for what asks only whether a text
    is as long as that. What is left of a beginning begins what is left of the text, but for an address that it cuts."""
    return let(plain_text(F.substring(cleaned, 1, 4 * least)), lambda head: F.when(F.length(head) >= least + _CUT, head).otherwise(plain_text(cleaned)))


def filter_reason(raw: Column, plain: Column, min_chars: int = MIN_CHARS) -> Column:
    """Why a document is left out, null if it is kept. plain: plain_text() of the cleaned raw text."""
    rest = lambda x: strip(sub(strip(sub(x, URL, "")), r"[*_`\[\]()#>!\-|]", ""))

    def links(every: Column) -> Column:
        linked = F.size(F.filter(every, lambda x: x.rlike(URL) & (F.length(rest(x)) < 30)))
        share = lambda n: n / F.size(every)
        said = lambda n: F.format_string(MOSTLY_LINKS + " (%d%% link-only lines)", F.bround(share(n) * 100).cast("int"))
        return F.when(F.size(every) > 10, let(linked, lambda n: F.when(share(n) > 0.7, said(n))))

    few = F.format_string(INSUFFICIENT + " (%d chars)", F.length(plain))
    return F.when(F.length(plain) < min_chars, few).when(raw.contains("://"), let(full_lines(raw), links))


def reason_category(reason: Column) -> Column:
    return F.trim(F.substring_index(reason, "(", 1))


def content_type(cleaned: Column, plain: Column) -> Column:
    """qa, meeting_log, table, minimal or technical; the first that fits."""

    def by_lines(every: Column) -> Column:
        share = lambda hit: F.size(F.filter(every, hit)) / F.size(every)
        links = (F.size(every) > 10) & (share(lambda x: x.rlike(URL)) > 0.5)
        return F.when(links, "meeting_log").when((F.size(every) > 0) & (share(lambda x: x.startswith("|")) > 0.6), "table")

    marks = F.regexp_count(cleaned, F.lit(r"[\x{1F534}\x{1F7E2}]"))
    return F.when(marks >= 4, "qa").otherwise(F.coalesce(let(full_lines(cleaned), by_lines), F.when(F.length(plain) < MINIMAL, "minimal").otherwise("technical")))


def has_heading(cleaned: Column) -> Column:
    return cleaned.rlike(r"(?mdU)^#{1,6}\s+")


def residual_html(cleaned: Column) -> Column:
    """Tags that cleaning left: those that were written as entities."""
    return F.regexp_count(cleaned, F.lit("<[a-zA-Z][^>]*>")).cast("long")


__all__ = ["clean_text", "content_type", "estimate_tokens", "filter_reason", "lines", "plain_text", "signature"]
