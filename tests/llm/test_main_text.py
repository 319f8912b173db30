"""Main text: whole pages against the articles their source marks, odd markup, odd rows."""

import html
import re

import duckdb
import numpy as np
import pytest

from scanweave.llm.main_text import content_lines, extract, page_lines, page_texts, smoothed, with_main_text


def article_of(source):
    """Blocks of the one article, cut out with patterns that hold for the given pages."""
    body = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</h1>|<p>|</p>|<br>", body)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in page_texts(pages).collect()}
    rows = duckdb.sql(f"select page_id, url, html from '{sf_dir}/pages.parquet'").fetchall()
    assert got == {i: (url, article_of(source), len(article_of(source))) for i, url, source in rows}


LONG = "This is a long sentence of the article that has a good many words in it and no links."


@pytest.mark.parametrize("source, text", [
    ("", ""),
    ("<nav>a</nav><article></article><div class='ad'>buy</div>", ""),
    (f"<p>{LONG}</p>", LONG),
    ("plain &lt;words&gt; &amp; &#233;&nbsp;\n more", "plain <words> & é more"),
    # no marked content: the container of the long lines, with its heading and its short lines
    (f"<div class=menu><a href=x>one</a></div><div id=c><h1>Title</h1><p>{LONG}<p>Short.<p>{LONG}</div>"
     f"<section class='comments'><p>{LONG}</p></section><div id=f><a href=y>Imprint</a></div>", f"Title\n{LONG}\nShort.\n{LONG}"),
    # furniture within an article, readers' articles in it, the article's own header, a form around all
    ("<form id=aspnet><header>Site</header><article><header><h1>T</h1><p>by me</p></header><p>a <span class='ad'>buy</span> b"
     "<button>x</button></p><aside>pull</aside><pre>x\n y</pre><article><p>reader</p></article><footer>f</footer></article></form>", "T\na b\nx y"),
    (f"<body class='has-sidebar'><main><h1 class=page-header>T</h1><p>{LONG}</p><div class='cookie-notice'>c</div><div id='sidebarLeft'>s</div></main>",
     f"T\n{LONG}"),
    ("<article><p>a<div role=navigation>m</div><p hidden>h</p><p style='display: none'>n<p>b<ul><li><a>1</a><li><a>2</a><li><a>3</a></ul></article>", "a\nb"),
    ("<article><ul><li>one<li>two <b>bold</ul><table><tr><td>x<td>y<tr><th>z</table></article>", "one\ntwo bold\nx y\nz"),
    # markup that never ends, declarations, scripts
    ("<p>a <!-- b <p>c", "a"),
    ("<p>a<p>b <a href='", "a\nb"),
    ("<p>a<![if !IE]>b<![CDATA[c]]>d<?php e ?>f<script>if (a < b) '</p>'</script>g<style>h", "abdfg"),
    ("<article><p>a <br> b</p></article>", "a b"),
])
def test_markup(source, text):
    assert extract(source) == text


def test_ratios_and_smoothing():
    page = page_lines(f"<nav><a href=x>menu</a></nav><p>{LONG}</p><p>{LONG}</p>")
    assert [line.ratio for line in page.lines] == [0.0] + 2 * [len(LONG.replace(" ", "")) / 2]
    assert smoothed(np.array([0.0, 0, 0, 1, 0, 0, 0])).sum() == pytest.approx(1)
    assert len(smoothed(np.array([1.0]))) == 1
    assert [line.text for line in content_lines(page)] == [LONG, LONG]


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (1, "u", "", 5), (None, "u", f"<p>{LONG}</p>", 6), (None, "u", f"<p>{LONG}</p>", 6)]
    long_page = "<article>" + f"<p>{LONG}</p>" * 30_000 + "</article>"
    pages = spark.createDataFrame(rows + [(9, "u", long_page, 7)], "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["n_chars"]) for r in page_texts(pages).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 0), (None, len(LONG)), (None, len(LONG)), (9, 30_000 * (len(LONG) + 1) - 1)], key=repr)
    assert page_texts(pages.limit(0)).count() == 0
    kept = with_main_text(pages, name="text")
    assert kept.columns == ["page_id", "url", "text", "text_"] and {r["text"] for r in kept.collect()} == {5, 6, 7}
