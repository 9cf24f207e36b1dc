"""Main text of pages: templates with known articles, odd markup, and the pages of the small tables against the standard parser."""

import time
from html.parser import HTMLParser

import pytest

from factloom.llm import extraction

SMALL = "/root/testdata/sf0.001"
LONG = "This paragraph goes on for long enough that it is plainly part of an article and not of a menu, as it has sentences. " * 3
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(8)) + "</ul>"

PAGES = [
    ("<article><h1>Head</h1><p>One<p>Two &amp; three<br>four</article>", "Head One Two & three four"),
    ("<nav>Menu</nav><article>a<b>b</b>c <i>d</i></article><footer>&copy; x</footer>", "abc d"),
    ("<article><p>a</p><!-- <p>no</p> --><script>var t='</p>';</script><style>p{}</style><p>b</p></article>", "a b"),
    ("<article><h1>T</h1><p>x</p><div class='ad-box'>Buy</div><p>y</p><form><p>Mail?</p><input></form><p>z</p></article>", "T x y z"),
    ("<article><p>x</p><section id=comments><article><p>I disagree</p></article></section></article>", "x"),
    ("<main><header>h</header><p>x</p><aside>s</aside></main>", "h x"),
    ("<body class='with-sidebar'><article class='post comments-open'><p>x</p></article></body>", "x"),
    (f"<div id=top>My Site</div><div>{MENU}</div><div><h2>News</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>End.</p></div><div>(c) 2020 All rights</div>",
     f"News {LONG}Short. {LONG}End."),
    (f"<table><tr><td>{MENU}</td><td><p>{LONG}</p><p>{LONG}</p></td><td>Ads here</td></tr></table>", f"{LONG}{LONG}".strip()),
    (f"<div>{MENU}</div><div class=text><p>{LONG}</p><blockquote>Quote</blockquote><ul><li>point</li></ul><p>{LONG}</p></div><div id=cookieNotice>We use cookies {LONG}</div>",
     f"{LONG}Quote point {LONG}".strip()),
    ("<div role=navigation>Menu</div><div role=main><p>x</p></div>", "x"),
    ("<p>a &lt;b&gt; &#233; &#x1F600; &am &amp &nbsp; c</p>", "a <b> é 😀 &am & c"),
    ("<article>1 < 2 and 3 > 2 <3</article>", "1 < 2 and 3 > 2 <3"),
    ('<article><p title="a > b">x</p><p title="open>y</p></article>', "x y"),
    ("<article><p>x</p><!-- never closed <p>y</p></article>", "x"),
    ("<article><p>x</p><script>never closed</article>", "x"),
    ("<ARTICLE><P>Upper<SCRIPT>x</SCRIPT></P></ARTICLE>", "Upper"),
    ("<article><p>a</div></p></ul>b</article>", "a b"),
    ("just text", "just text"),
    ("<article>x</article><article>y</article>", "x y"),
    ("<nav>only a menu</nav>", ""),
    ("<article></article>", ""),
    ("<article><p>see <a href=x>the whole link</a></p><p><a href=y>Another</a></p></article>", "see the whole link Another"),
    ("<html><head><title>t</title></head><body>  \n\t </body></html>", ""),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_page(html, want):
    assert extraction.main_text(html) == want.strip()


def test_windows_by_hand():
    assert extraction.windows([1, 0, 0, 5]) == [1, 5, 5, 5]
    assert extraction.windows([]) == []


class Article(HTMLParser):
    """Text of the article element, with a space at each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.said = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.said.append(" " if tag in ("p", "h1", "br") else "")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.said.append(" " if tag in ("p", "h1") else "")

    def handle_data(self, data):
        self.said.append(data if self.depth else "")


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    known = {r.page_id: r for r in pages.collect()}
    got = extraction.extracted(pages).collect()
    assert len(got) == len(known)
    for r in got:
        parser = Article()
        parser.feed(known[r.page_id].html)
        want = " ".join("".join(parser.said).split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), known[r.page_id].url)


def test_rows(spark):
    rows = [(1, "u", "<article>x</article>", "c", 1), (1, "u", "<article>x</article>", "c", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, extraction.extracted(pages).collect()), key=repr) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert extraction.extracted(pages.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["<b>", "<p>x", "<div>", "</i>", "<", "<a href='", "&", "<!--", "<li><ul>", "<script>"])
def test_work_grows_with_the_page(piece):
    began = time.time()
    extraction.main_text("<article>x" + piece * 60_000)
    assert time.time() - began < 10
