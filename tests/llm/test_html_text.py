"""Main text against what made pages were made of, in several layouts."""

import html
import random

import pytest

from tickloom.llm import html_text
from tickloom.llm.html_text import extract

WORDS = "the rain over harbour towns fell while boats & crews waited for <calm> water near Öland, café lights “on” and 3 > 2 gulls".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(rng):
    """Blocks of an article and their markup."""
    blocks, out = [], []

    def put(tag, text, inner=None):
        blocks.append(" ".join(text.split()))
        out.append(f"<{tag}>{html.escape(text) if inner is None else inner}</{tag}>")

    put("h1", sentence(rng, rng.choice((2, 6))))
    for _ in range(rng.choice((1, 2, 5, 12))):
        kind = rng.random()
        text = sentence(rng, rng.choice((3, 15, 40, 90)))
        if kind < 0.5:
            put("p", text)
        elif kind < 0.6:
            put("h2", sentence(rng, 3))
        elif kind < 0.7:
            put("blockquote", text)
        elif kind < 0.8:
            a, b = text.split(" ", 1)
            put("p", f"{a} {b}", f'{html.escape(a)}\n <em>{html.escape(b[:5])}</em><a href="/x?a=1&amp;b=2">{html.escape(b[5:])}</a><!-- no --><br>')
        else:
            items = [sentence(rng, rng.choice((2, 9))) for _ in range(3)]
            blocks.extend(items)
            out.append("<ul>" + "".join(f"<li>{html.escape(i)}" + rng.choice(("</li>", "")) for i in items) + "</ul>")
    return blocks, "\n".join(out)


LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(9)) + "</ul>"
LONG = "Buy the new lamp today and save a lot of money on every second lamp that you take home with you this week, only in our shop. " * 3


def semantic(a, rng):
    return f"""<!DOCTYPE html><html><head><title>Site &mdash; page</title><style>p{{}}</style><script>var t = "<p>no</p>";</script></head><body>
<header><a href="/">Site</a><h1>The Daily Site</h1></header><nav>{LINKS}</nav><div class="ad">{LONG}</div>
<main><article>{a}<form><p>{LONG}</p><button>Send</button></form><aside><p>{LONG}</p></aside></article></main>
<section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section><aside class="sidebar">{LONG}</aside><footer><p>{LONG}</p></footer></body></html>"""


def by_names(a, rng):
    return f"""<html><body class="has-sidebar"><div id="page"><div class="site-header"><p>{LONG}</p></div><div id="cookie-notice">{LONG}</div><div class="topMenu">{LINKS}</div>
<div class="columns"><div class="post-content">{a}</div><div class="right-sidebar"><h3>More</h3><p>{LONG}</p></div></div>
<div class="comment-list"><div class="comment-body"><p>{LONG}</p></div></div><div class="newsletterBox newsletter">{LONG}</div><div id="footer">{LONG}</div></div></body>"""


def plain(a, rng):
    return f"""<html><body><table><tr><td>{LINKS}</td></tr></table><div><article>{a}</article></div><div role="contentinfo">{LONG}</div><div style="display: none">{LONG}</div>"""


def unclosed(a, rng):
    return f"""<body><nav>{LINKS}</nav><div class="sponsored-links"><p>{LONG}</div><div class=content>{a}<p>&nbsp;<p></b></section><br></div><div class="social share">{LINKS}</div><footer>{LONG}"""


@pytest.mark.parametrize("layout", [semantic, by_names, plain, unclosed])
def test_articles_come_whole_and_alone(layout):
    rng = random.Random(layout.__name__)
    for _ in range(150):
        blocks, markup = article(rng)
        assert extract(layout(markup, rng)) == "\n\n".join(blocks)


def test_region_without_names():
    """Ratios alone: link lists and short lines around unnamed long text."""
    rng = random.Random(4)
    for _ in range(50):
        paragraphs = [sentence(rng, 60) for _ in range(6)]
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs[:3]) + "<p>Well.</p>" + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs[3:])
        page = f"<body><div>{LINKS}</div><div><h1>On rain</h1>{body}</div><div>{LINKS}<span>v1</span></div></body>"
        assert extract(page) == "\n\n".join(["On rain", *paragraphs[:3], "Well.", *paragraphs[3:]])


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<nav>a</nav>", ""), ("Only text &amp; no tags", "Only text & no tags"), ("a<br>b", "a b"), ("<p>a<p>b", "a\n\nb"), ("<p>x</b></div>y</p>", "xy"),
        ("<article><header><h1>T</h1><p>by line</p></header><p>x</p></article>", "T\n\nx"), ("<p>1 &lt; 2 &#233;&#x1F600; &nbsp; &unknown;</p>", "1 < 2 é\U0001f600 &unknown;"),
        ("<p>a <button>Share</button> b<span hidden>c</span></p>", "a b"), ("<div class='sidebar'><main><p>in</p></main></div>", "in"), ("<p>un<b>br</b>oken</p>", "unbroken"), ("<![CDATA[x]]><p>a</p><!-- <p>b</p> -->", "a"),
        ("<article><p>a</p><section><h2>More</h2><article><p>I agree</p></article></section></article>", "a\n\nMore"),
    ],
)
def test_cases(page, text):
    assert extract(page) == text


def test_time_is_in_proportion():
    """Long and deep pages, and stray tags, take no square of their size."""
    import time

    for make in (lambda n: "<div>" * n + "x", lambda n: "<p>word word</p>" * n, lambda n: "<b>" * n + "</i>" * n + "x", lambda n: "<li><a href=x>y</a>" * n):
        took = []
        for n in (10_000, 40_000):
            t = time.perf_counter()
            extract(make(n))
            took.append(time.perf_counter() - t)
        assert took[1] < 12 * took[0] + 0.2


def test_clusters():
    assert 2 < html_text.threshold([1, 1.5, 2, 40, 45, 50]) < 40
    assert html_text.threshold([3.0, 3.0]) == 3.0
    s = html_text.smoothed([0, 0, 0, 10, 0, 0, 0])
    assert s[3] == max(s) and abs(s[2] - s[4]) < 1e-9 and s[2] > s[1] > 0


def test_query_columns(spark):
    rows = [(1, "u", "<article><p>Héllo</p></article>"), (2, None, None), (None, "w", "<p>a</p>"), (1, "u", "<article><p>Héllo</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'q' as n_chars")
    got = sorted(map(tuple, html_text.main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "Héllo", 5), (2, None, "", 0), (None, "w", "a", 1), (1, "u", "Héllo", 5)], key=str)
    assert html_text.main_text(df.where("false")).collect() == []
