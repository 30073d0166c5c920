"""The converter, case by case: whole outputs, worked out by hand."""

import random
import time

import pytest

from corpusloom.functions import convert as c, text
from corpusloom.operators import conversion

CASES = [
    ("page data", '%META:FORM{name="Survey"}%\nrain fell', "rain fell\n"),
    ("page data, several", '%META:FIELD{a="1"}%\n%META:FIELD{a="2"}%\n%META:FIELD{a="3"}%\nrain', "rain\n"),
    ("page data takes blank lines along", "%META:FORM{}%\n\n\n\nrain", "rain\n"),
    ("page data inside a line stays", "see %META:FORM{}% there", "see %META:FORM{}% there\n"),
    *((f"heading {n}", f"---{'+' * n} Lake {n}", f"{'#' * min(n, 6)} Lake {n}\n") for n in range(1, 9)),
    ("heading of many dashes", "--------+++ River", "### River\n"),
    ("heading left out of contents", "---+!! River", "# River\n"),
    ("heading by hashes", "---### River", "### River\n"),
    ("a rule joins the heading below", "-----\n\n---+ River", "# River\n"),
    ("a heading without title takes the next line", "---+++\nshore", "### shore\n"),
    ("bold", "a *very wide* river", "a **very wide** river\n"),
    ("italic", "a _very wide_ river", "a *very wide* river\n"),
    ("bold italic", "a __very wide__ river", "a ***very wide*** river\n"),
    ("code", "call =flow(x)= twice", "call `flow(x)` twice\n"),
    ("bold code", "call ==flow(x)== twice", "call **`flow(x)`** twice\n"),
    ("spaced stars stay", "3 * 4 * 5", "3 * 4 * 5\n"),
    ("marks inside words stay", "a*b*c snake_case_name x=y=z", "a*b*c snake_case_name x=y=z\n"),
    ("bold at a line's ends", "*wide*\nand *deep*", "**wide**\nand **deep**\n"),
    ("bold before stops", "*wide*, *deep*; (*cold*) *wet*)", "**wide**, **deep**; (*cold*) **wet**)\n"),
    ("nested marks", "*a _b_ c* and _a =b= c_", "**a *b* c** and *a `b` c*\n"),
    ("rule", "east\n--------\nwest", "east\n---\nwest\n"),
    ("bullets", "   * oak\n      * twig\n         * leaf\n   * elm", "- oak\n  - twig\n    - leaf\n- elm\n"),
    ("numbers", "   7. oak\n   B. elm\n   X. ash\n   ii. fir\n      2. cone", "1. oak\n1. elm\n1. ash\n1. fir\n  1. cone\n"),
    ("terms", "   $ oak: a tree: large\n   $  moss :  green", "**oak:** a tree: large\n**moss:** green\n"),
    ("too little indent", "  * oak\n * elm", "  * oak\n * elm\n"),
    ("table", "| *tree* | *height* |\n| oak | 40   m |\n| ^ | 38 m |", "| tree | height |\n| --- | --- |\n| oak | 40 m |\n|  | 38 m |\n"),
    ("tables of plain rows", "trees\n| oak | elm |\n| ash | fir |\nend\n|moss|", "trees\n| oak | elm |\n| --- | --- |\n| ash | fir |\nend\n| moss |\n| --- |\n"),
    ("a bar in a cell", "| oak %VBAR% elm | ash |", "| oak \\| elm | ash |\n| --- | --- |\n"),
    ("a link in a cell", "| [[http://t.org/oak][oak]] | *x* |", "| [oak](http://t.org/oak) | **x** |\n| --- | --- |\n"),
    ("link", "[[ftp://files.t.org/map][the map]]", "[the map](ftp://files.t.org/map)\n"),
    ("bare links", "[[mailto:a@t.org]] [[RiverList]] [[#Shore]]", "[mailto:a@t.org](mailto:a@t.org) RiverList [#Shore](#shore)\n"),
    ("escaped links", "![[River]] then [[Lake]] then ![[Shore]]", "\\[\\[River\\]\\] then Lake then \\[\\[Shore\\]\\]\n"),
    ("escaped link with a label stays half", "![[River][wide]]", "![wide](River)\n"),
    ("brackets that do not close", "[[River [[Lake]] ![[Shore", "River [[Lake ![[Shore\n"),
    ("place in the page", "[[#EastShore][over there]]", "[over there](#eastshore)\n"),
    ("break", "oak %BR% elm", "oak <br> elm\n"),
    ("contents", "%TOC{depth=\"3\"}%\n\nOaks", "Oaks\n"),
    ("icons", '%ICON{warning}% deep %ICON{"star"}%%ICON{nosuch}%!', "⚠️ deep ⭐!\n"),
    ("attachment", "%ATTACHURL%/oak-map.pdf", "oak-map.pdf\n"),
    ("public address", "%PUBURL%/Forest/Oaks/map.pdf", "Oaks/map.pdf\n"),
    ("marks by name", "oak %CARET% elm %VBAR% ash", "oak ^ elm \\| ash\n"),
    ("unknown variables", "%RIVER_LENGTH% km, %LAKE{deep=\"1\"}%m", " km, m\n"),
    ("variable with digits stays", "%LAKE2% km", "%LAKE2% km\n"),
    ("directives", '%TABLE{width="9"}%\n%STARTINCLUDE%\noak', "oak\n"),
    ("colour with an icon", "%ICON{star}% %TEAL%\nhow deep\n%ENDCOLOR%", "> ⭐ how deep\n"),
    ("colour over lines", "%ICON{help}% %LIME%\noak\n\nelm\n%ENDCOLOR% ash", "> ❓ oak\n>\n> elm ash\n"),
    ("colour alone", "%NAVY%\noak %BR% elm\n%ENDCOLOR%", "> 🔵 oak <br> elm\n"),
    ("colour with an unknown icon", "%ICON{nosuch}% %PINK% oak %ENDCOLOR%", "> 🩷 oak\n"),
    ("colour in colour", "%RED% oak %BLUE% elm %ENDCOLOR% ash %ENDCOLOR% fir", "> 🔴 oak  elm ash  fir\n"),
    ("colour that does not end", "%RED% oak %BLUE% elm", " oak  elm\n"),
    ("empty colour", "a %RED%%ENDCOLOR% b", "a > b\n"),
    ("verbatim", "oak\n<verbatim>\nelm *x*\n</verbatim>\nash", "oak\n```\n\nelm *x*\n\n```\nash\n"),
    ("verbatim of a language", '<verbatim class="sql">SELECT 1</verbatim>', "```sql\nSELECT 1\n```\n"),
    ("verbatim keeps marks", "<verbatim>[[Oak]] %RED% ---++ _x_</verbatim>", "```\n[[Oak]] %RED% ---++ _x_\n```\n"),
    ("two of pre", "<pre>oak</pre>-<pre>elm</pre>", "```\noak\n```-```\nelm\n```\n"),
    ("pre in verbatim", "<verbatim><pre>oak</pre></verbatim> <pre>elm", "```\n<pre>oak</pre>\n``` <pre>elm\n"),
    ("an empty pre takes all up to the next end", "<pre></pre> oak </pre>", "```\n</pre> oak\n```\n"),
    ("verbatim is cleaned up too", "<pre>x &lt; y\n-----\nz</pre>", "```\nx < y\n---\nz\n```\n"),
    ("breaks", "oak<br/>elm<br  />ash<br>", "oak<br>elm<br>ash<br>\n"),
    ("tags", "<strong>oak</strong> <em>elm</em> <del>ash</del> <b>fir\nyew</b> <i>box</i> <strike>bay</strike> <code>f(x)</code>", "**oak** *elm* ~~ash~~ **fir\nyew** *box* ~~bay~~ `f(x)`\n"),
    ("tags that do not end", "<b>oak <b>elm</b> <i>ash", "**oak <b>elm** <i>ash\n"),
    ("quote", "<blockquote>\noak\n  elm</blockquote>", "> oak\n> elm\n"),
    ("no-op marks", "Oak<nop/>Tree <literal>x</literal><sticky>y</sticky><noautolink>Elm Tree</noautolink>", "OakTree xyElm Tree\n"),
    ("signature", "-- CMS.OakFriend - 3 Feb 2015", "— OakFriend, 3 Feb 2015\n"),
    ("signature without a web", "--  ElmFriend  -  2015-02-03  ", "— ElmFriend, 2015-02-03\n"),
    ("escaped names", "!OakTree of 7 !GeV in Sandbox.ElmTree", "OakTree of 7 GeV in ElmTree\n"),
    ("entities", "oak &lt; elm&nbsp;&amp; ash &gt; &#94; &#124;", "oak < elm & ash > ^ \\|\n"),
    ("decoded twice", "&amp;gt;", ">\n"),
    ("blank runs", "\n\noak\n\n\n\n\nelm \t\n\n", "oak\n\nelm\n"),
    ("nothing", "", "\n"),
]


@pytest.fixture(scope="module")
def converted(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in CASES], "k string, text string")
    return {r.k: r.markdown for r in c.convert(df).collect()}


@pytest.mark.parametrize(("name", "source", "want"), CASES)
def test_case(converted, name, source, want):
    assert converted[name] == want


HOSTILE = {"open colours": "%RED% a ", "colours": "%RED% a %ENDCOLOR% ", "escaped links": "![[x]] ", "links": "[[a][b]] [[c]] ", "open links": "[[x ", "open escaped links": "![[x ", "open pre": "<pre>", "pre": "<pre>x</pre> ", "open bold": "<b>a ", "open quotes": "<blockquote>", "ends": "%ENDCOLOR%</b></pre>]]"}


@pytest.mark.parametrize("name", HOSTILE)
def test_long_texts_take_linear_time(spark, name):
    """A megabyte of marks; what closes is converted, what doesn't stays."""
    times = 1_000_000 // len(HOSTILE[name])
    df = spark.createDataFrame([(1, HOSTILE[name] * times)], "k long, text string")
    began = time.perf_counter()
    got = c.convert(df).first().markdown
    assert time.perf_counter() - began < 12
    made = {"colours": "> 🔴 a ", "escaped links": "\\[\\[x\\]\\] ", "links": "[b](a) c ", "pre": "```\nx\n``` ", "open bold": "<b>a ", "open links": "[[x ", "open escaped links": "![[x ", "open pre": "<pre>"}
    if name in made:
        assert got == (made[name] * times).rstrip() + "\n"


def test_few_and_many_links_agree(spark, monkeypatch):
    """Both ways of finding links give the same texts."""
    r = random.Random(4)
    bits = ["[[", "]]", "][", "![[", "]", "[", "!", "#", "a", "http://t.org", " ", "%%ESCAPED_LINK_0%%", "\n"]
    df = spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(2000)], "k long, text string")
    shown = lambda: {x.k: x.t for x in df.select("k", c.links(df.text).alias("t")).collect()}
    few = shown()
    for module in (c, text):
        monkeypatch.setattr(module, "FEW", -1)
    assert shown() == few


def test_page(spark):
    page = "\n".join(['%META:TOPICPARENT{name="Forests"}%', "---++ Oaks above 30 !Metre", "", "   * tall", "   * old", "", "---+++!! Care", "%ICON{help}% %AQUA%", "How much water?", "%ENDCOLOR%", "", "%TEAL% Little. %ENDCOLOR%", "", "-- Main.ElmFriend - 3-Feb-2015", ""])
    want = "## Oaks above 30 Metre\n\n- tall\n- old\n\n### Care\n> ❓ How much water?\n\n> 🟢 Little.\n\n— ElmFriend, 3-Feb-2015\n"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "%A1% <nop x"), (4, "x %A_B{%")], "doc_id long, text string")
    got = {r.doc_id: r for r in conversion.convert_all(rows).collect()}
    assert got[1].markdown == want and got[1].status == "Success" and got[1].validation == [c.PASSED]
    assert got[1].input_size == len(page.encode()) and got[1].output_size == len(want.encode())
    assert got[1].applied_rules == ["META stripped", "Headings converted", "Bullet lists converted", "Colors stripped", "Variables processed", "Signatures converted"]
    assert got[2].status == "Exception" and got[2].markdown is None
    assert got[3].status == "Error"
    counts = {r.status: r.n for r in conversion.status_counts(conversion.convert_all(rows)).collect()}
    assert counts == {"Success": 2, "Exception": 1, "Error": 1}
    assert conversion.summary(conversion.convert_all(rows)).collect()[0].success_rate == 50.0
    assert conversion.rule_counts(conversion.convert_all(rows), 1).count() == 1


@pytest.mark.parametrize(("shown", "want"), [("# Hello", [c.PASSED]), ("%META:X{bad}%\nx", [c.META]), ("a <nop> b", [c.NOP]), ("`<nop>` ```\n%AB%\n```", [c.PASSED]), ("%AB{x}% <br />", [c.VARIABLE, c.BREAK]), ("<noautolink> <verbatim>", [c.NOAUTOLINK, c.LEFT_VERBATIM])])
def test_validate(spark, shown, want):
    df = spark.createDataFrame([(shown,)], "t string")
    assert df.select(c.validate(df.t)).collect()[0][0] == want
