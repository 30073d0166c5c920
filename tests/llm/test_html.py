"""Main texts of pages that the tests build: what parts them, what wraps them, and what stands beside them."""

import random

import pytest

from corpusloom.llm import html_text
from corpusloom.llm.html_text import main_text

LONG = "A long sentence of the page's own text that goes on for a while, with more words and yet more of them. " * 3
LONG = LONG.strip()


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + "."


CUTS = ("<aside>see also</aside>", "<figure><button>zoom</button></figure>", "<button>play</button>", "<nav><a>back</a> <a>next</a></nav>", "<form><input><button>send</button></form>", "<div class='ad-slot'><a>buy this</a></div>", "<script>var x = '<p>no</p>';</script>", "<div aria-hidden='true'>decor</div>")
COMMENTS = ("<section><article><p>{}</p></article></section>", "<ol class='replies'><li><p>{}</p></li></ol>", "<div id='comments'><div><p>{}</p></div></div>", "<div class='post-replies'><p>{}</p></div>")
WRAPS = ("<article>{}</article>", "<div>{}</div>", "<main>{}</main>", "<div class='widget-container'><div>{}</div></div>", "<div class='page'><article id='search-result'>{}</article></div>", "<div id='header-less'>{}</div>")


def page(seed):
    """A page and the lines of its text."""
    r = random.Random(seed)
    lines, body = [sentence(r, 4)], []
    body.append(f"<h1>{lines[0]}</h1>")
    for i in range(r.randint(4, 9)):
        text = sentence(r, r.choice((3, 5, 40, 60, 90)) if i % 3 else 60)
        lines.append(text)
        body.append(r.choice(("<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>")).format(text))
        if r.random() < 0.5:
            body.append(r.choice(CUTS))
    lines.append(sentence(r, 5))
    body.append(f"<p>{lines[-1]}</p>")
    wrap = r.choice(WRAPS)
    said = "".join(r.choice(COMMENTS).format(sentence(r, 25)) for _ in range(r.randint(0, 2)))
    inside = r.random() < 0.5 and "article" in wrap
    whole = wrap.format("".join(body) + (said if inside else ""))
    after = "" if inside else said.replace("<section><article>", "<section class='comments'><article>")
    return f"<html><head><title>t</title></head><body><header><h2>Site</h2><nav><a>one</a><a>two</a></nav></header>{whole}{after}<footer>All rights</footer></body></html>", lines


def test_generated_pages_lose_and_gain_nothing():
    wrong = []
    for seed in range(1000):
        html, lines = page(seed)
        if main_text(html).split("\n") != lines:
            wrong.append(seed)
    assert not wrong, (len(wrong), wrong[:5])


CASES = {
    "what stands between lines of one parent": (f"<div><h1>T</h1><aside>x</aside><p>Short intro.</p><nav>m</nav><p>{LONG}</p></div>", ["T", "Short intro.", LONG]),
    "a button in a figure": (f"<p>{LONG}</p><p>{LONG}</p><figure><button>zoom</button></figure><p>The end.</p>", [LONG, LONG, "The end."]),
    "a list before the cut": (f"<div><p>{LONG}</p><ul><li>x</li></ul><aside>ad</aside><p>end</p></div>", [LONG, "x", "end"]),
    "other parents part": (f"<div><a>one</a></div><nav>m</nav><div><p>{LONG}</p><p>{LONG}</p></div><nav>m</nav><div><a>two</a></div>", [LONG, LONG]),
    "articles in an article are comments": (f"<article><p>{LONG}</p><p>{LONG}</p><section><article>{LONG}</article><article>I agree.</article></section></article>", [LONG, LONG]),
    "an answer to a comment goes with it": (f"<article><p>{LONG}</p><p>{LONG}</p><article>short<article>{LONG}</article></article></article>", [LONG, LONG]),
    "unless they have the text": (f"<article><h1>List</h1><article><p>{LONG}</p></article></article>", ["List", LONG]),
    "replies by name": (f"<article><p>{LONG}</p><p>{LONG}</p><div class='post-replies'><p>{LONG}</p></div></article>", [LONG, LONG]),
    "the article's own header": (f"<article><header><h1>Head</h1></header><p>{LONG}</p></article>", [LONG]),
    "a short article beside a long one": (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><a>more</a></article>", [LONG, LONG]),
    "nothing": ("<nav>menu</nav><footer>all rights</footer>", [""]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    html, want = CASES[name]
    assert main_text(html).split("\n") == want


def test_names_alone_decide_nothing(monkeypatch):
    """Text in hinted elements is kept where it is the page's text, whatever stands outside them."""
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    want = ["Head", LONG, LONG]
    for name in ("elementor-widget-container", "search-page", "header-image social"):
        got = main_text(f"<p>News</p><div class='{name}'>{body}</div>").split("\n")
        assert [x for x in got if x != "News"] == want
        # A comment section inside is hinted twice.
        assert main_text(f"<div class='{name}'>{body}<div class='comments'><p>{LONG}</p></div></div>").split("\n") == want
    # And beside an unhinted text the same element goes.
    assert main_text(f"<div>{body}</div><div class='widget'><p>{LONG}</p></div>").split("\n") == want
    monkeypatch.setattr(html_text, "MARKS", frozenset())
    assert main_text(f"<div>{body}</div><div class='widget'><p>{LONG}</p></div>").split("\n") == [*want, LONG]


def test_many_cuts_are_linear():
    import time

    began = time.perf_counter()
    text = main_text("<div>" + f"<p>{LONG}</p><button>b</button>" * 5_000 + "</div>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000)
    assert text.count("\n") >= 4_999 and time.perf_counter() - began < 20
