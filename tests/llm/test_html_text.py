"""Main text of pages: laid-out pages whose article is known, odd markup, and the given pages."""

from __future__ import annotations

import html as entities
import os
import random
import re

import pytest

from gradeloom.llm.html_text import extract, main_text, ratios
from gradeloom.llm.queries import op11_html_text

SENTENCE = "The quick fox, which was brown, ran over a lazy dog; nobody saw it."


def lines(rng, n):
    return [" ".join([SENTENCE] * rng.randrange(1, 4)) + f" {rng.random()}" for _ in range(n)]


MENU = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(8)) + "</ul>"
COMMENTS = "".join(f'<div class="comment"><b>user{k}</b><p>{SENTENCE * 4}</p></div>' for k in range(12))

#: Pages around an article's heading and paragraphs.
LAYOUTS = {
    "article": "<header><h1>Site</h1></header><nav>{menu}</nav><article>{article}</article><aside><p>{s}</p></aside><footer>{s}</footer>",
    "article with marks": '<nav>{menu}</nav><article>{article}<div class="share-buttons">Share</div><form><label>Mail</label><input></form><section id="comments"><h2>Comments</h2>{comments}</section></article>',
    "main": '<div class="cookie-notice"><p>{s}</p></div><div role="banner">Site name</div><main>{article}</main><section class="comments">{comments}</section>',
    "main and article": '<main><article>{article}</article><div class="related"><p>{s}</p></div></main><article class="comment"><p>{s}{s}{s}</p></article>',
    "div": '<div id="top-nav">{menu}</div><div class="wrap has-sidebar"><div class="content">{article}</div><div class="sidebar"><p>{s}</p>{menu}</div></div><div class="footer">&copy; 2024</div>',
    "table": "<table><tr><td>{menu}</td><td>{article}</td></tr></table>",
    "form around": '<form id="aspnetForm"><div><ul>{menu}</ul></div><div>{article}</div></form>',
    "notices": '<div role="alert">{s}</div><article>{article}<p class="advertisement">{s}</p><div class="newsletter signup"><p>{s}</p></div></article>',
    "short": '<nav>{menu}{menu}</nav><article><p>Ok.</p></article><footer>{s}{s}</footer>',
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("ends", [True, False])
def test_layouts(name, ends):
    rng = random.Random(name)
    own = lines(rng, 6)
    shown = "".join(f"<p>{x}{'</p>' if ends else ''}" for x in own)
    body = LAYOUTS[name].format(menu=MENU, s=SENTENCE, comments=COMMENTS, article=f"<h1>Head &amp; line</h1>{shown}")
    got = main_text(f"<!DOCTYPE html><html><head><title>t</title><script>if (a<b) '</p>'</script><body>{body}")
    assert got == ("Ok." if name == "short" else "\n".join(["Head & line", *own]))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        ("<p></p><br>", ""),
        ("plain", "plain"),
        ("<p>a  b\n\t c<br>d</p><p>e</p>", "a b c d\ne"),
        ("<p>1 < 2 &amp;&lt;p&gt; &#233;&eacute</p>", "1 < 2 &<p> éé"),
        ('<p title="a > b">x<b>y</b>z</p>', "xyz"),
        ("<p title='it>s' data-x=it's>x</p>", "x"),
        ('<p title="see class=ad here">x</p>', "x"),
        ("<p>a<!-- b > <p>c</p> -->d<!-->e</p>", "ade"),
        ("<article><p>one<p>two<ul><li>x<li>y</ul></article>", "one\ntwo\nx\ny"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p>in <span class=ad>Buy!</span> line</p></article>", "in line"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>cut <scr", "cut"),
        ("<article><p>a</p><script>x</article>", "a"),
        ("<head><title>t</title>text in no body", "text in no body"),
        ("<div class=menu><p>all is marked</p></div>", "all is marked"),
        ("<p>\U0001d4b3 日本。</p>", "\U0001d4b3 日本。"),
    ],
)
def test_markup(source, text):
    assert main_text(source) == text


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 30_000 + "<p>x.</p>" + "<span>" * 30_000 + "y"
    assert main_text(deep) == "x.\ny"
    assert main_text("<a b='" * 20_000) == ""
    assert main_text("<p>" + "word, " * 200_000 + "</p>") == ("word, " * 200_000).strip()


def test_ratios_by_hand():
    import numpy as np

    flat = ratios(np.array([1, 1, 1]), np.array([10, 20, 30]), np.array([0, 0, 3]))
    assert flat.tolist() == pytest.approx([40.0] * 3)  # a path's leaves are alike: 20 characters, 1 + 1 punctuation marks each
    assert len(ratios(np.array([1]), np.array([5]), np.array([0]))) == 1


def test_frame(spark):
    rows = [(1, "u", "<article><p>a.</p></article>", "x"), (1, "u", "<article><p>a.</p></article>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = extract(df).collect()
    assert sorted(r.main_text for r in got) == ["", "a.", "a."] and got[0].__fields__.count("main_text") == 1
    assert extract(df.limit(0)).count() == 0


def plain(source):
    """The article of a given page, which has no marks inside."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    blocks = [re.sub(r"</?b>", "", re.sub("<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_query(spark):
    sources = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op11_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(sources)
    for r in got:
        assert r.text == plain(sources[r.page_id]) and r.n_chars == len(r.text)
