"""The test tables in the roles that operators expect, each once in Spark and once as SQL that both sides can be held to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table by expressions that Spark and DuckDB read alike."""
    return table(spark, sf_dir, name).selectExpr(*columns)


#: Pieces of wiki markup, what single phases of a conversion make of them, and what a whole conversion does. @ stands for the
#: document's number; a phase that is not named leaves a piece as it is.
PIECES: tuple[tuple[str, dict[str, str], str], ...] = (
    ('%META:TOPICINFO{author="a"}%\n', {"strip_meta": ""}, ""),
    ("---++ Topic @\n", {"headings": "## Topic @\n"}, "## Topic @\n"),
    ("---++!! Hidden @\n", {"headings": "## Hidden @\n"}, "## Hidden @\n"),
    ("---## Hashes @\n", {"headings": "## Hashes @\n"}, "## Hashes @\n"),
    ("   * item %BR% one\n", {"variables": "   * item <br> one\n", "lists": "- item %BR% one\n"}, "- item <br> one\n"),
    ("      * nested @\n", {"lists": "  - nested @\n"}, "  - nested @\n"),
    ("   1. first @\n", {"lists": "1. first @\n"}, "1. first @\n"),
    ("   A. letter @\n", {"lists": "1. letter @\n"}, "1. letter @\n"),
    ("   $ Term: it means @\n", {"lists": "**Term:** it means @\n"}, "**Term:** it means @\n"),
    ("%TOC{depth=\"2\"}%\n", {"variables": ""}, ""),
    ("%TABLE{sort=\"on\"}%\n", {"variables": ""}, ""),
    ("%STARTINCLUDE%\n", {"variables": ""}, ""),
    ("| *Name* | *Value @* |\n|  a  b | ^ |\n", {"tables": "| Name | Value @ |\n| --- | --- |\n| a b |  |\n", "inline": "| **Name** | **Value @** |\n|  a  b | ^ |\n"}, "| Name | Value @ |\n| --- | --- |\n| a b |  |\n"),
    ("between\n| plain | row |\n", {"tables": "between\n| plain | row |\n| --- | --- |\n"}, "between\n| plain | row |\n| --- | --- |\n"),
    ('%ICON{"led-red"}% %GREEN% Line @\n more %BR% text %ENDCOLOR%\n', {"colour_blocks": "> 🔴 Line @\n> more <br> text\n", "variables": "🔴  Line @\n more <br> text \n"}, "> 🔴 Line @\n> more <br> text\n"),
    ("%BLUE%alone @%ENDCOLOR%\n", {"colour_blocks": "> 🔵 alone @\n", "variables": "alone @\n"}, "> 🔵 alone @\n"),
    ("see [[Topic @]], [[#Part@][Jump]], ![[Kept]], [[http://x.org/@][label]] and [[http://x.org/@]]\n", {"links": "see Topic @, [Jump](#part@), \\[\\[Kept\\]\\], [label](http://x.org/@) and [http://x.org/@](http://x.org/@)\n"}, "see Topic @, [Jump](#part@), \\[\\[Kept\\]\\], [label](http://x.org/@) and [http://x.org/@](http://x.org/@)\n"),
    ("==code @== and =c= and __both__ and *bold @* and _it_, but not * this * one\n", {"inline": "**`code @`** and `c` and ***both*** and **bold @** and *it*, but not * this * one\n"}, "**`code @`** and `c` and ***both*** and **bold @** and *it*, but not * this * one\n"),
    ("%VBAR% %CARET% %ATTACHURL%/f.png %PUBURL%/Web/g.png %ICON{help}% %AQUA% %WEB%@ %SOMEVAR{a}% end\n", {"variables": "\\| ^ f.png g.png ❓  @  end\n"}, "\\| ^ f.png g.png ❓  @  end\n"),
    ('%TWISTY{mode="div"}%\ninside @%ENDTWISTY%\n%INCLUDE{"A"}%%SEARCH{"q"}%after\n', {"variables": "inside @after\n"}, "inside @after\n"),
    ('<verbatim class="py">a = [[c]] @\n  b</verbatim>\n', {"extract_verbatim": "%%VERBATIM_0%%\n", "links": '<verbatim class="py">a = c @\n  b</verbatim>\n'}, "```py\na = [[c]] @\n  b\n```\n"),
    ("<pre>kept as *it* is</pre>\n", {"extract_verbatim": "%%VERBATIM_1%%\n", "inline": "<pre>kept as **it** is</pre>\n"}, "```\nkept as *it* is\n```\n"),
    ("<b>bold</b> <i>it</i> <code>x</code> <strike>s</strike> <blockquote>q @</blockquote> A<nop>B <noautolink>n</noautolink> <br />\n", {"html_tags": "**bold** *it* `x` ~~s~~ > q @ AB n <br>\n"}, "**bold** *it* `x` ~~s~~ > q @ AB n <br>\n"),
    ("!WikiWord by Main.UserName at 8 !TeV\n", {"wikiwords": "WikiWord by UserName at 8 TeV\n"}, "WikiWord by UserName at 8 TeV\n"),
    ("-----\n", {"rules": "---\n"}, "---\n"),
    ("-- Main.User@ - 2012-07-11\n", {"signatures": "— User@, 2012-07-11\n", "wikiwords": "-- User@ - 2012-07-11\n"}, "— User@, 2012-07-11\n"),
    ("&amp; &lt;x&gt; a&nbsp;b &#124; &#94; trailing  \n", {"cleanup": "& <x> a b \\| ^ trailing\n"}, "& <x> a b \\| ^ trailing\n"),
    ("far\n\n\n\napart\n", {"cleanup": "far\n\napart\n"}, "far\n\napart\n"),
)
#: What only some documents have: a tag that nothing takes out, and a variable that only the escape's removal makes one.
FAULTS = "CASE WHEN doc_id % 7 = 0 THEN '<nop' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' %!AB% ' ELSE '' END || chr(10)"


def sql_text(text: str) -> str:
    """text as SQL of either engine: no line breaks or backslashes in literals, the document's number for @."""
    parts = [x for x in re.split(r"([\n\\@])", text) if x]
    known = {"\n": "chr(10)", "\\": "chr(92)", "@": "CAST(doc_id AS STRING)"}
    return " || ".join(known.get(x, "'" + x.replace("'", "''") + "'") for x in parts) or "''"


def wiki_sql(phase: str | None = None, body: str = "replace(coalesce(text, ''), ' the ', ' *the* ')", faults: str = FAULTS) -> str:
    """The wiki text of a document, or what a phase ("full" for all of them) should make of it."""
    shown = [raw if phase is None else final if phase == "full" else by.get(phase, raw) for raw, by, final in PIECES]
    return " || ".join([sql_text("".join(shown)), body, "chr(10)", faults])


WIKI = wiki_sql()
#: Markdown made of a document: a heading, the text (of some, with its lines as paragraphs), a second heading with a link list,
#: questions of some, tags left as entities of some, a signature.
MARKDOWN = (
    "'## Part ' || CAST(doc_id AS STRING) || chr(10) || CASE WHEN doc_id % 5 = 2 THEN replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) ELSE coalesce(text, '') END || chr(10) || '### Second' || chr(10)"
    " || CASE WHEN doc_id % 4 = 1 THEN 'About it' || chr(10) || '\U0001f534 Why ' || CAST(doc_id AS STRING) || '?' || chr(10) || '\U0001f7e2 Because.' || chr(10) || '\U0001f534 How?' || chr(10) || '\U0001f7e2 So.' || chr(10) ELSE '' END"
    " || CASE WHEN doc_id % 3 = 0 THEN 'see https://example.com/' || CAST(doc_id AS STRING)"
    " || chr(10) || 'a &lt;b&gt; <span class=\"x\">kept</span>' ELSE 'plain' END || chr(10) || '# ' || chr(10) || chr(10) || '-- Writer ' || CAST(doc_id AS STRING) || ', 2015-02-08' || chr(10)"
)
#: Documents after a short line, after lines of links, after rows of a table, between questions, and as they are.
MIXED = (
    "CASE WHEN doc_id % 5 = 0 THEN '<b>x</b> ' || CAST(doc_id AS STRING) || chr(10) || coalesce(text, '') WHEN doc_id % 5 = 1 THEN repeat('https://example.com/' || CAST(doc_id AS STRING) || ' see' || chr(10), 15) || 'A line that has words enough to count as text of its own.' || chr(10) || coalesce(text, '')"
    " WHEN doc_id % 5 = 2 THEN repeat('| a | b |' || chr(10), 20) || coalesce(text, '') WHEN doc_id % 5 = 3 THEN 'Is it? \U0001f534 Yes \U0001f7e2' || chr(10) || coalesce(text, '') || chr(10) || '## More' || chr(10) || 'Some' || chr(10) || 'More? \U0001f534 No \U0001f7e2' ELSE coalesce(text, '') END"
)
CHUNK = ("'chunk_' || CAST(doc_id AS STRING) AS id", "doc_id AS seq", "CAST((doc_id - doc_id % 4) AS STRING) AS source_file", "doc_id % 4 AS chunk_index", "coalesce(source, '') AS page_title", "CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS section_heading", "CASE WHEN doc_id % 3 = 0 THEN '2015-02-08' ELSE '' END AS date", "'' AS author", "coalesce(text, '') AS content")
QUERY = ("item_id AS query_id", "text AS query")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "documents", *CHUNK)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "embeddings", "'chunk_' || CAST(vec_id AS STRING) AS id", "vec_id AS seq", "embedding", "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries, with the vectors of equal numbers for their embeddings."""
    q = derived(spark, sf_dir, "benchmark", *QUERY)
    v = derived(spark, sf_dir, "embeddings", "vec_id AS query_id", "embedding")
    return v.join(q, "query_id")


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "documents", "doc_id", f"{WIKI} AS text")


def markdown(spark: SparkSession, sf_dir: str, sql: str = MARKDOWN) -> DataFrame:
    return derived(spark, sf_dir, "documents", "lpad(CAST(doc_id AS STRING), 9, '0') AS source_file", f"{sql} AS text", "doc_id")
