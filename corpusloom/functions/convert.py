"""Wiki markup to Markdown: one Column function for each of fifteen phases, applied in PHASES' order by convert().

Each phase is text to text. Verbatim blocks leave the text in the first phase and come back in the thirteenth, so convert()
keeps them in a column of their own. Line ends are \\n only, as (?d) and explicit classes below see to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import FEW, enclosed, let, lines, per_line, replace_each, replace_tokens, staged, strip, sub, upto, where

#: Fixed: the emoji of icon names.
ICONS = {
    "led-red": "🔴", "led-green": "🟢", "led-blue": "🔵", "led-yellow": "🟡", "led-orange": "🟠", "led-gray": "⚪", "led-grey": "⚪",
    "tip": "💡", "warning": "⚠️", "help": "❓", "info": "ℹ️", "checked": "✅", "unchecked": "⬜", "choice-yes": "✅", "choice-no": "❌",
    "stop": "🛑", "new": "🆕", "updated": "🔄", "todo": "📝", "done": "✅", "closed": "🔒", "flag": "🚩", "star": "⭐", "home": "🏠",
    "mail": "✉️", "search": "🔍", "person": "👤", "group": "👥", "wrench": "🔧", "gear": "⚙️", "plugin": "🔌", "arrowright": "→", "arrowleft": "←",
}
#: Fixed: the emoji of colour names.
COLOURS = {
    "RED": "🔴", "GREEN": "🟢", "BLUE": "🔵", "YELLOW": "🟡", "ORANGE": "🟠", "PURPLE": "🟣", "PINK": "🩷", "AQUA": "💠", "MAROON": "🟤",
    "NAVY": "🔵", "TEAL": "🟢", "LIME": "🟢", "OLIVE": "🟤", "SILVER": "⚪", "GRAY": "⚪", "BLACK": "⚫", "WHITE": "⚪",
}
#: Fixed: variables that are removed by name, web prefixes, and entities in decoding order.
VARIABLES = ("WEB", "TOPIC", "USERSWEB", "DATE", "WIKINAME", "WIKITOOLNAME", "MAINWEB", "SYSTEMWEB", "HOMETOPIC")
WEBS = ("Main", "TWiki", "Sandbox", "CMS", "CMSPublic", "System", "Trash")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#124;", "\\|"), ("&#94;", "^"))
#: Fixed: the markup that phases look for, here and in each of them, follows from the wiki's language.
_COLOUR = "|".join(COLOURS)
_ICON = r"""%ICON\{["']?([\w-]+)["']?\}%"""
_OPENING = r"""(?:%ICON\{["']?[\w-]+["']?\}%\s*)?%(?:""" + _COLOUR + ")%"
VERBATIM = r"(?s)<(verbatim|pre)(\s[^>]*)?>(.+?)</\1>"
#: Stands in a tag that nothing closes any more while blocks are looked for, and for links while they are numbered.
_OPEN = "\ue0f7"
BLOCKS = "array<struct<content:string,lang:string>>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain(*table.items())))[key], F.lit(""))


def _closable(text: Column) -> Column:
    """text with a mark in the tags of protected blocks that no end tag follows, so that none is looked for from each of them."""
    for tag in ("verbatim", "pre"):
        rest = lambda t: F.substring_index(t, f"</{tag}>", -1)  # noqa: B023, E731
        marked = lambda t: let(rest(t), lambda r: F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(r)), F.replace(r, F.lit(f"<{tag}"), F.lit(f"<{_OPEN}{tag}"))))  # noqa: B023, E731
        text = let(text, lambda t: F.when(t.contains(f"<{tag}"), marked(t)).otherwise(t))  # noqa: B023
    return text


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(f"<{_OPEN}"), F.lit("<"))


def verbatim_blocks(text: Column) -> Column:
    """BLOCKS of the protected blocks, in order."""

    def found(t: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(t, F.lit(VERBATIM), F.lit(2)).alias("a"), F.regexp_extract_all(t, F.lit(VERBATIM), F.lit(3)).alias("c"))
        return F.transform(both, lambda b: F.struct(_unmarked(b["c"]).alias("content"), F.regexp_extract(F.coalesce(b["a"], F.lit("")), r'(?U)class="(\w+)"', 1).alias("lang"))).cast(BLOCKS)

    return let(_closable(text), found)


def extract_verbatim(text: Column) -> Column:
    taken = lambda t: _unmarked(replace_each(_closable(t), VERBATIM, lambda i, _: F.concat(F.lit("%%VERBATIM_"), i.cast("string"), F.lit("%%")), (3,)))
    return F.when(text.contains("<verbatim") | text.contains("<pre"), upto(text, ">", taken)).otherwise(text)


def _restored(text: Column, name: str, blocks: Column, how: Callable[[Column], Column]) -> Column:
    """The placeholders %%name_i%% as how of the i-th block, found in one pass; others stay as they are."""
    known = lambda i, x: F.when((i >= 0) & (i < F.size(blocks)) & (i.cast("string") == x), how(F.get(blocks, i)))
    found = lambda x: F.coalesce(let(x.try_cast("int"), lambda i: known(i, x)), F.concat(F.lit(f"%%{name}_"), x, F.lit("%%")))
    return F.when(text.contains(f"%%{name}_"), replace_each(text, rf"%%{name}_(\d+)%%", lambda _, x: found(x))).otherwise(text)


def strip_meta(text: Column) -> Column:
    return sub(text, r"(?md)^%META:.*%\s*$\n?", "")


def colour_blocks(text: Column) -> Column:
    """Colour blocks as quotes; the first line that is not blank starts with the icon's emoji, or else the colour's. A block
    begins at the first colour since the last end mark, so the text is parted at these."""

    def quote(mark: Column, body: Column) -> Column:
        own = _lookup(ICONS, F.regexp_extract(mark, _ICON, 1))
        emoji = F.when(own != "", own).otherwise(_lookup(COLOURS, F.regexp_extract(mark, "%([A-Z]+)%$", 1)))
        shown = F.array_join(F.transform(lines(F.replace(strip(body), F.lit("%BR%"), F.lit("<br>"))), lambda x: F.rtrim(F.concat(F.lit("> "), strip(x)))), "\n")
        lead = lambda x: F.regexp_extract(x, r"^(?:>\n)*+> ", 0)
        led = lambda x, start: F.when(start != "", F.concat(start, emoji, F.lit(" "), F.substring(x, F.length(start) + 1, F.length(x)))).otherwise(x)
        return let(shown, lambda x: let(lead(x), lambda start: led(x, start)))

    def segment(part: Column) -> Column:
        block = lambda mark: let(F.position(mark, part), lambda at: F.concat(F.substring(part, F.lit(1), at - 1), quote(mark, F.substring(part, at + F.length(mark), F.length(part)))))
        return let(F.regexp_extract(part, _OPENING, 0), lambda mark: F.when(mark != "", block(mark)).otherwise(F.concat(part, F.lit("%ENDCOLOR%"))))

    parts = let(F.split(text, "%ENDCOLOR%", -1), lambda p: F.transform(p, lambda x, i: F.when(i == F.size(p) - 1, x).otherwise(segment(x))))
    return F.when(text.contains("%ENDCOLOR%"), F.array_join(parts, "")).otherwise(text)


def variables(text: Column) -> Column:
    # After the last percent sign a match may go on through what is not space, and spaces; whether a line ends there shows in what follows.
    return upto(text, "%", _variables, r"(?s)^\S*+\s*+.?")


def _variables(text: Column) -> Column:
    drop = lambda t, what, to="": F.replace(t, F.lit(what), F.lit(to))
    text = drop(text, "%BR%", "<br>")
    text = drop(text, "%VBAR%", "\\|")
    text = drop(text, "%CARET%", "^")
    text = replace_each(text, _ICON, lambda _, name: _lookup(ICONS, name))
    text = drop(text, "%ATTACHURL%/")
    text = sub(text, r"(?U)%PUBURL%(?:/[^\s]*?)?/([^\s/]+)", "$1")
    text = sub(text, r"(?md)^%TOC(\{[^}]*\})?%\s*$\n?", "")
    text = sub(text, r"(?md)^%TABLE\{[^}]*\}%\s*$\n?", "")
    text = sub(text, r"(?md)^%(STARTINCLUDE|STOPINCLUDE)%\s*$\n?", "")
    text = sub(text, r"%TWISTY\{[^}]*\}%\s*\n?", "")
    text = sub(text, r"%ENDTWISTY%\s*\n?", "")
    text = sub(text, r"%INCLUDE\{[^}]*\}%", "")
    text = sub(text, r"%SEARCH\{[^}]*\}%", "")
    for name in VARIABLES:
        text = drop(text, f"%{name}%")
    text = sub(text, f"%({_COLOUR}|ENDCOLOR)%", "")
    return sub(text, r"%[A-Z_]+(\{[^}]*\})?%", "")


def headings(text: Column) -> Column:
    """Dashes and plus signs (or, after those, hashes) become as many hashes, six at most."""
    for mark in (r"\++", "#+"):
        title = lambda _, level, rest: F.concat(F.repeat(F.lit("#"), F.least(F.length(level), F.lit(6))), F.lit(" "), strip(rest))
        text = replace_each(text, r"(?md)^-{3,}\s*(" + mark + r")\s*(?:!!)?\s*(.*)$", title, (1, 2))
    return text


def is_table_line(line: Column) -> Column:
    return line.contains("|") & let(strip(line), lambda bare: bare.startswith("|") & bare.endswith("|") & (F.length(bare) > 1))


def table_cells(line: Column) -> Column:
    return F.split(sub(sub(strip(line), r"^\|", ""), r"\|\z", ""), r"(?<!\\)\|", -1)


def tables(text: Column) -> Column:
    """Table rows with trimmed cells; the first row of a block loses its bold marks if all its cells are bold, and a separator
    follows it."""

    def render(row: Column) -> Column:
        first = ~row["after"]
        cells = F.transform(table_cells(row["x"]), strip)
        worded = F.filter(cells, lambda c: c != "")
        header = (F.size(worded) > 0) & F.forall(worded, lambda c: c.rlike(r"(?d)^\*.*\*\s*$"))
        plain = F.transform(cells, lambda c: F.when(c == "^", F.lit("")).otherwise(c))
        bare = F.transform(plain, lambda c: strip(sub(c, r"(?d)^\*(.+)\*$", "$1")))
        shown = F.transform(F.when(first & header, bare).otherwise(plain), lambda c: F.array_join(F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != ""), " "))
        line = F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(shown, lambda _: F.lit(" --- ")), "|"), F.lit("|"))
        return F.when(~row["t"], row["x"]).when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line)

    rows = lambda every, flags: F.arrays_zip(every.alias("x"), flags.alias("t"), F.concat(F.array(F.lit(False)), flags).alias("after"))
    shown = lambda every: let(F.transform(every, is_table_line), lambda flags: F.array_join(F.transform(F.filter(rows(every, flags), lambda r: r["x"].isNotNull()), render), "\n"))
    # The last line with a bar is the last that may be a row.
    return upto(text, "|", lambda t: let(lines(t), shown), r"^[^\n]++")


def list_line(line: Column) -> Column:
    bullet, number, term = r"(?dU)^( {3,})\*\s(.*)$", r"(?dU)^( {3,})(?:\d+\.|[A-Z]\.|[a-z]\.|[IVXLCDM]+\.|[ivxlcdm]+\.)\s(.*)$", r"(?dU)^( {3,})\$\s+(.*?):\s+(.*)$"
    indent = lambda p: F.repeat(F.lit("  "), F.greatest(F.floor(F.length(F.regexp_extract(line, p, 1)) / 3) - 1, F.lit(0)).cast("int"))
    found = F.when(line.rlike(bullet), F.concat(indent(bullet), F.lit("- "), F.regexp_extract(line, bullet, 2)))
    found = found.when(line.rlike(number), F.concat(indent(number), F.lit("1. "), F.regexp_extract(line, number, 2)))
    found = found.when(line.rlike(term), F.concat(F.lit("**"), strip(F.regexp_extract(line, term, 2)), F.lit(":** "), strip(F.regexp_extract(line, term, 3))))
    return F.when(line.startswith("   "), found.otherwise(line)).otherwise(line)


def lists(text: Column) -> Column:
    return per_line(text, list_line)


def links(text: Column) -> Column:
    """Bracket links; a link after an exclamation mark stays, with its brackets escaped."""
    shut, dead = r"!\[\[([^\]]+)\]\]", r"\[\[[^\]]*+"
    target = lambda t: F.when(t.startswith("#"), F.lower(t)).otherwise(t)
    addressed = r"^(?:https?://|ftp://|mailto:|#)"

    def linked(t: Column) -> Column:
        return replace_tokens(t, r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"\[\[", dead, r"[^\[]++|\[", lambda to, label: F.concat(F.lit("["), label, F.lit("]("), target(to), F.lit(")")), 2)

    def bare(t: Column) -> Column:
        return replace_tokens(t, r"\[\[([^\]]+)\]\]", r"\[\[", dead, r"[^\[]++|\[", lambda to: F.when(to.rlike(addressed), F.concat(F.lit("["), to, F.lit("]("), target(to), F.lit(")"))).otherwise(to), 1)

    def escaped(t: Column) -> Column:
        """Numbered placeholders for the escaped links of t, and these back in the end."""
        found = lambda g: F.regexp_extract_all(t, F.lit(rf"(?s)\G(?:{shut}|!{dead}|[^!]++|!)"), F.lit(g))
        gaps = lambda all_: F.split(F.array_join(F.transform(F.arrays_zip(found(0).alias("t"), all_.alias("h")), lambda x: F.when(x["h"] != "", F.lit(_OPEN)).otherwise(x["t"])), ""), _OPEN, -1)
        named = lambda held: F.transform(held, lambda _, i: F.concat(F.lit("%%ESCAPED_LINK_"), i.cast("string"), F.lit("%%")))
        shown = lambda all_, held: F.array_join(F.zip_with(gaps(all_), named(held), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
        back = lambda x: F.concat(F.lit("\\[\\["), x, F.lit("\\]\\]"))
        both = lambda held, out: F.struct(held.alias("held"), out.alias("out"))
        many = let(found(1), lambda all_: let(F.filter(all_, lambda h: h != ""), lambda held: both(held, shown(all_, held))))
        few = both(F.regexp_extract_all(t, F.lit(shut), F.lit(1)), replace_each(t, shut, lambda i, _: F.concat(F.lit("%%ESCAPED_LINK_"), i.cast("string"), F.lit("%%"))))
        apart = F.when(F.regexp_count(t, F.lit(r"!\[\[")) <= FEW, few).otherwise(many)
        return let(apart, lambda x: let(let(let(x["out"], linked), bare), lambda out: _restored(out, "ESCAPED_LINK", x["held"], back)))

    plain = lambda t: let(linked(t), bare)
    # A name of a placeholder may stand anywhere.
    return F.when(~text.contains("[["), text).when(text.contains("%%ESCAPED_LINK_"), F.when(text.contains("![["), let(text, escaped)).otherwise(let(text, plain))).otherwise(upto(text, "]]", lambda t: let(t, lambda x: F.when(x.contains("![["), escaped(x)).otherwise(plain(x)))))


def _marked(line: Column, mark: str, inner: str, opens: str, closes: str) -> Column:
    """The mark is looked for before what must precede it: a line's start or white space."""
    return where(line, mark.removeprefix("\\"), lambda x: sub(x, rf"(?U){mark}(?<!\S{mark})({inner}){mark}(?=[\s.,;:!?\)\]}}>]|$)", f"{opens}$1{closes}"))


def inline_line(line: Column) -> Column:
    line = _marked(line, "==", r"[^\s=](?:.*?[^\s=])?", "**`", "`**")
    line = _marked(line, "=", r"[^\s=](?:[^=]*?[^\s=])?", "`", "`")
    line = _marked(line, "__", r"[^\s_](?:.*?[^\s_])?", "***", "***")
    line = _marked(line, r"\*", r"[^\s*](?:[^*]*?[^\s*])?", "**", "**")
    return _marked(line, "_", r"[^\s_](?:[^_]*?[^\s_])?", "*", "*")


def inline(text: Column) -> Column:
    some = text.contains("=") | text.contains("_") | text.contains("*")
    return F.when(some, per_line(text, inline_line)).otherwise(text)


def wikiwords(text: Column) -> Column:
    plain = lambda t: sub(sub(t, r"(?U)!([A-Z][a-z]+[A-Z]\w*)", "$1"), r"(?U)!(?<!\w!)([A-Z][a-zA-Z]+)", "$1")
    first = "".join(sorted({web[0] for web in WEBS}))
    return sub(where(text, "!", plain), rf"(?U)(?=[{first}])\b(?:" + "|".join(WEBS) + r")\.([A-Z]\w+)", "$1")


def html_tags(text: Column) -> Column:
    return F.when(text.contains("<"), upto(text, ">", _tags)).otherwise(text)


def _tags(text: Column) -> Column:
    text = sub(text, r"<br\s*/?>", "<br>")
    for tag, mark in (("b", "**"), ("strong", "**"), ("i", "*"), ("em", "*"), ("strike", "~~"), ("del", "~~")):
        text = let(text, lambda t: enclosed(t, f"<{tag}>", f"</{tag}>", lambda x: F.concat(F.lit(mark), x, F.lit(mark))))  # noqa: B023
    code = lambda t: per_line(t, lambda line: enclosed(line, "<code>", "</code>", lambda x: F.concat(F.lit("`"), x, F.lit("`"))))
    text = let(text, lambda t: F.when(t.contains("</code>"), code(t)).otherwise(t))
    quoted = lambda body: F.array_join(F.transform(lines(strip(body)), lambda x: F.concat(F.lit("> "), strip(x))), "\n")
    text = let(text, lambda t: enclosed(t, "<blockquote>", "</blockquote>", quoted))
    text = sub(text, r"<nop\s*/?>", "")
    for tag in ("noautolink", "literal", "sticky"):
        text = let(text, lambda t: enclosed(t, f"<{tag}>", f"</{tag}>", lambda x: x))  # noqa: B023
    return text


def signatures(text: Column) -> Column:
    return sub(text, r"(?mdU)^--\s+(?:(?:Main|CMS|CMSPublic)\.)?(\w+)\s*-\s*(.+?)\s*$", "— $1, $2")


def restore_verbatim(text: Column, blocks: Column) -> Column:
    """Each placeholder as a fenced block, in the order of blocks."""
    return _restored(text, "VERBATIM", blocks, lambda b: F.concat(F.lit("```"), b["lang"], F.lit("\n"), b["content"], F.lit("\n```")))


def rules(text: Column) -> Column:
    return sub(text, r"(?md)^-{3,}\s*$", "---")


def cleanup(text: Column) -> Column:
    text = upto(text, ";", lambda t: reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, t))
    text = where(text, "\n\n\n", lambda t: sub(t, r"\n{3,}", "\n\n"))
    text = sub(text, r"(?md)[ \t]+$", "")
    return F.concat(sub(sub(text, r"^\n+", ""), r"\n+\z", ""), F.lit("\n"))


#: The phases between taking verbatim blocks out and putting them back, in order.
PHASES = {
    "strip_meta": strip_meta, "colour_blocks": colour_blocks, "variables": variables, "headings": headings, "tables": tables, "lists": lists,
    "links": links, "inline": inline, "wikiwords": wikiwords, "html_tags": html_tags, "signatures": signatures,
}


def convert(docs: DataFrame, text_col: str = "text", out_col: str = "markdown") -> DataFrame:
    """docs with out_col, the Markdown of text_col; a row never leaves its partition. A null text converts to null."""
    names = [c for c in docs.columns if c != out_col]
    step = staged(docs, __text=F.col(text_col))
    step = staged(step, __blocks=verbatim_blocks(F.col("__text")), __text=extract_verbatim(F.col("__text")))
    for phase in PHASES.values():
        step = staged(step, __text=phase(F.col("__text")))
    step = staged(step, __text=restore_verbatim(F.col("__text"), F.col("__blocks")))
    step = staged(step, __text=rules(F.col("__text")))
    return staged(step.drop("__blocks"), **{out_col: cleanup(F.col("__text"))}).select(*names, out_col)


#: Fixed: what the validator says.
META, NOP, NOAUTOLINK, LEFT_VERBATIM = "❌ Raw %META: lines still present", "❌ <nop> tags still present", "❌ <noautolink> tags still present", "❌ Unconverted <verbatim> tags"
VARIABLE, BREAK, PASSED = "⚠️  Possible unconverted TWiki variable", "⚠️  <br /> not normalized to <br>", "✅ All validation checks passed"


def validate(markdown: Column) -> Column:
    """Diagnostics of a converted text, code left aside; one pass mark if there are none."""

    def found(bare: Column) -> Column:
        checks = (
            (bare.rlike("(?md)^%META:"), META), (bare.rlike(r"%[A-Z_]+(\{[^}]*\})?%"), VARIABLE), (bare.contains("<nop"), NOP),
            (bare.contains("<noautolink>"), NOAUTOLINK), (bare.contains("<verbatim>"), LEFT_VERBATIM), (bare.rlike(r"<br\s*/>"), BREAK),
        )
        return F.array_compact(F.array(*(F.when(hit, F.lit(said)) for hit, said in checks)))

    return _or(let(sub(sub(markdown, "(?s)```.*?```", ""), "`[^`]+`", ""), found), PASSED)


def _or(found: Column, none: str) -> Column:
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(none))))


def status(validation: Column) -> Column:
    """Error, Warning or Success; Exception where there is no text to validate."""
    bad = F.exists(validation, lambda v: v.contains("❌"))
    doubtful = F.exists(validation, lambda v: v.contains("⚠️"))
    return F.when(validation.isNull(), "Exception").when(bad, "Error").when(doubtful, "Warning").otherwise("Success")


_SPACED = r"(\S.*?\S|\S)"
#: Fixed: a rule's name, what of the source shows that it was needed, and what of the result must hold, "not " before what must not.
RULES = (
    ("META stripped", "(?md)^%META:", "not (?md)^%META:"),
    ("Headings converted", r"(?md)^-{3,}\s*\++", r"(?md)^#{1,6}\s"),
    ("Verbatim → code blocks", "<verbatim", "```"),
    ("Links converted", r"(?d)\[\[.*?\]\]", ""),
    ("Tables converted", r"(?md)^\s*\|.*\|\s*$", r"\|[-:]+\|"),
    ("Bullet lists converted", r"(?md)^\s{3,}\*\s", r"(?md)^(\s*)- "),
    ("Numbered lists converted", r"(?md)^\s{3,}\d+\.\s", ""),
    ("Colors stripped", f"%({_COLOUR})%", ""),
    ("Variables processed", r"%[A-Z_]+(\{[^}]*\})?%", ""),
    ("Bold converted", r"(?d)(?<!\*)\*(?!\*)" + _SPACED + r"\*(?!\*)", r"\*\*"),
    ("Italic converted", r"(?d)(?<!_)_(?!_)" + _SPACED + "_(?!_)", ""),
    ("Code spans converted", r"(?d)(?<!=)=(?!=)" + _SPACED + "=(?!=)", ""),
    ("BR tags normalized", r"<br\s*/?>", ""),
    ("Nop tags stripped", "<nop>", ""),
    ("Noautolink stripped", "<noautolink>", ""),
    ("Signatures converted", r"-- (Main\.|TWiki\.)", ""),
    ("WikiWord escapes stripped", r"!\w+[A-Z]\w+", ""),
)


def applied_rules(original: Column, markdown: Column) -> Column:
    """Names of the conversion rules that a document seems to have needed."""

    def name(rule: tuple[str, str, str]) -> Column:
        said, before, after = rule
        hit = original.rlike(before)
        if after:
            hit &= ~markdown.rlike(after.removeprefix("not ")) if after.startswith("not ") else markdown.rlike(after)
        return F.when(hit, F.lit(said))

    return _or(F.array_compact(F.array(*map(name, RULES))), "No specific rules matched")
