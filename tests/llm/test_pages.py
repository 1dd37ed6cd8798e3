"""Main text of pages that are put together from known parts, and of hostile ones."""

import html as html_lib
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text

WORDS = "amber birch cedar dune ember fjord glade heath inlet & < > é 漢字 jetty".split()
NOISE = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>", "<div class='advert'><p>Buy this now</p></div>", "<p class=advert>Cheap offers</p>", "<script>if(a<b){'</p>'}</script>",
    "<aside><p>By the way</p></aside>", "<form><label>Mail</label><input></form>", "<div class='cookie-notice'>We use cookies</div>", "<ul class=menu><li><a href=/>Top</a></li></ul>", "<!-- <p>gone</p> -->", "<style>p{}</style>",
    "<section class='comments'><p>Nice post</p><p class='comment'>Indeed so</p></section>", "<p class='comment'>I beg to differ</p>", "<footer>&copy; us</footer>",
]


def sentence(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(3, 25)))


def esc(t, r):
    return html_lib.escape(t).replace(" ", r.choice([" ", "\n ", "&#32;", " <!-- x -->"]), 1)


def block(r):
    """Markup of one part of an article and the blocks that it gives."""
    kind = r.choice(["p", "p", "p", "h2", "ul", "table", "blockquote", "pre", "br", "dl"])
    a, b, c = (sentence(r) for _ in range(3))
    x, y, z = (esc(t, r) for t in (a, b, c))
    if kind == "ul":
        return f"<ul><li>{x}</li><li>{y}<li><b>{z}</b></ul>", [a, b, c]
    if kind == "table":
        return f"<table><tr><th>{x}<th>{y}</tr><tr><td>{z}</td><td></td></tr></table>", [a, b, c]
    if kind == "br":
        return f"<p>{x}<br>{y}", [a, b]
    if kind == "dl":
        return f"<dl><dt>{x}<dd>{y}</dl>", [a, b]
    if kind == "p":
        return r.choice([f"<p>{x}</p>", f"<p class='lead'>{x}", f"<p><a href='/a?b=1&c'>{x}</a></p>", f"<div><p>{x}</p></div>"]), [a]
    return f"<{kind}>{x}</{kind}>", [a]


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", "<div id='content'><article class='post'>{}</article></div>", "<div class='page has-sidebar'><main><article>{}</article></main></div>"])
def test_pages_of_known_parts(holder):
    weights = html_text.PageWeights({}, {})
    for seed in range(60):
        r = random.Random(seed)
        inner, wanted = [f"<h1>{(t := sentence(r)).replace('&', '&amp;').replace('<', '&lt;')}</h1>"], [t]
        for _ in range(r.randint(1, 12)):
            markup, texts = block(r)
            inner.append(markup)
            wanted += texts
            if r.random() < 0.3:
                inner.append(r.choice(NOISE))
        around = [r.choice(NOISE) for _ in range(4)]
        page = f"<!DOCTYPE html><html><head><title>{sentence(r).replace('<', '')}</title></head><body>{''.join(around[:2])}{holder.format(''.join(inner))}{''.join(around[2:])}</body></html>"
        assert html_text.extract(page, weights).split("\n") == [" ".join(t.split()) for t in wanted], page


def test_lists_and_cells_without_an_article():
    weights = html_text.PageWeights({}, {})
    text = "<p>Some words of the article that count.</p><ul><li>One</li><li>Two</li></ul><table><tr><td>alpha</td><td>beta</td></tr></table>"
    wanted = "Some words of the article that count.\nOne\nTwo\nalpha\nbeta"
    assert html_text.extract(f"<body><nav>Home</nav><div class=text>{text}</div><ul><li><a href=/>Top</a></ul>", weights) == wanted
    assert html_text.extract(f"<body><nav>Home</nav>{text}<ul><li><a href=/>Top</a></ul><footer>us</footer>", weights) == wanted


HOSTILE = ["<a '", "<div>", "<a ='>' ", "<p>a</q>", "<div class=ad>x", "<!-- ", "<b><p>", "<i><li>", "</script ", "<script>", "&amp", '<a b="', "<td><tr>", "<article>", "<article class=comment>a</article>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_in_linear_time(piece):
    weights = html_text.PageWeights({}, {})
    began = time.perf_counter()
    html_text.extract(piece * (200_000 // len(piece)), weights)
    assert time.perf_counter() - began < 5


def test_clashing_names_and_repeated_rows(spark):
    page = "<body><nav>x</nav><article><h1>Title</h1><p>Words of it.</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("x") for c in ("__page", "text", "n_chars", "feature", "a", "b")})
    out = html_text.extract_pages(df, html_text.fit_page_weights(df)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "Title\nWords of it.", 18), (1, "Title\nWords of it.", 18)]
    assert html_text.extract_pages(df.limit(0), html_text.fit_page_weights(df.limit(0))).count() == 0
