import re
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from rowsmith.llm import main_text
from rowsmith.llm.lookup import frequent_from
from rowsmith.llm.main_text import Page

from .helpers import SMALL, clashing


def own(html):
    page = Page(html)
    best = page.best()
    return "" if best < 0 else page.text([best])


BODY = "<h2>Of rivers</h2><p>Rivers run <b>down</b>hill, and that\n is   all.</p><p>Some are long &amp; wide.</p>"
TEXT = "Of rivers\nRivers run downhill, and that is all.\nSome are long & wide."
AROUND = [
    "<nav><ul><li><a href=/a>Home page and more</a></ul></nav>", "<header class=top><h1>Our site of all rivers</h1></header><p></p>", "<footer>Imprint and more &copy;</footer>", "<aside><p>Also read this other text about hills</p></aside>",
    '<div class="sidebar-left"><p>Weather of the week, all in one place</p></div>', '<div id="cookie-notice"><p>We keep crumbs. Do you agree?</p></div>', "<div class='ad ad-300'>Buy boats now, cheaper than ever before!</div>", "<form><p>Your name</p><input></form>",
    "<script>if (a<b) x = '</p><p>no text';</script>", "<style>p > b {margin: 0}</style>", "<!-- <p>not here</p> -->", '<section id="comments"><article class="comment"><p>First! I liked it very much, this long reader comment.</p></article></section>',
    "<div role=navigation>Jump to the rivers</div>", "<div class=newsletterSignup>Get letters</div><div class='related posts'><p>Hills and how to climb them, in ten steps</p></div>",
]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div class=post>{}</div></main>", "<div id=page><div class='entry-content c12'>{}</div></div>", "<article><section>{}</section></article>", "<div itemprop=articleBody><div>{}</div></div>"])
def test_what_stands_around(frame):
    html = frame.format(BODY)
    assert own(html) == TEXT
    for extra in AROUND:
        assert own(f"<html><head><title>T</title></head><body>{extra}{html}{extra}") == TEXT, extra
        assert own("<body>" + frame.format(BODY + extra)) == TEXT, extra
    assert own(f"<!DOCTYPE html><html><body class='has-sidebar no-footer'>{''.join(AROUND)}{html}{''.join(AROUND)}</body></html>") == TEXT


def test_names_beside_the_text():
    """Modifiers of the text's own container do not make it noise; names of other things do."""
    for names in ("post-content share-enabled", "entry ad-free", "article-body has-comments", "story social-embeds", "mainText"):
        assert own(f"<div class=x><div class='{names}'>{BODY}</div><p>Short.</p></div>") == TEXT, names
    for names in ("post comment", "content sidebar", "comment-content", "adContent", "notice-text", "entry banner-300"):
        assert own(f"<div class='{names}'>{BODY}{BODY}</div><div>{BODY}</div>") == TEXT, names


def test_pages_laid_out_by_tables():
    html = f"<table><tr><td class=nav>Menu of all</td></tr><tr><td>Links and news of the week</td><td id=m>{BODY}<p>And much more is to be said of them than of others.</p></td></tr></table>"
    assert own(html) == TEXT + "\nAnd much more is to be said of them than of others."
    assert own("<article><table><tr><td>a<td>b</table><p>c</article>") == "a\nb\nc"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""), ("only text &lt;b&gt; &#65;&#x42;", "only text <b> AB"), ("<nav>a</nav>", ""), ("a<br>b<hr>c", "a b\nc"), ("<p>one<p>two<div>three</div>four", "one\ntwo\nthree\nfour"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>x<span class=ad>y<span>z</span></span>w</p>", "xw"), ("<p title='a > b'>t</p><p a=\"1>q", "t\nq"), ("<p>a</div></p>b", "a\nb"), ("1 < 2 and 2 > 1", "1 < 2 and 2 > 1"), ("<p>a<script>never closed", "a"),
        ("<article><header><h1>T</h1></header><p>body of it</p></article>", "T\nbody of it"), ("<article><header>By me</header><p>body of it</p></article>", "body of it"), ("<div><h1>T</h1><div><p>long enough</p><p>text</p></div></div>", "T\nlong enough\ntext"), ("<p>a&nbsp;b\t\n c</p>", "a b c"), ("<svg/><p>a</p>", "a"),
        ("<a href=x>all in links</a>", "all in links"), ("</p></div><p>é ß</p>", "é ß"), ("<P CLASS=Ad>no</P><P>yes</P>", "yes"), ("<textarea><p>x</textarea><p>y", "y"), ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
    ],
)
def test_markup(html, text):
    page = Page(html)
    assert "\n".join(b[1] for b in page.blocks) == text


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    """Votes and extraction one page after the other."""
    host = lambda url: re.match(r"[^/?#]*", url.split("://", 1)[1])[0].lower() if url and "://" in url else ""
    counted = defaultdict(Counter)
    for _, url, html in rows:
        page = Page(html or "")
        if host(url) and page.best() >= 0:
            counted[host(url)][page.paths[page.best()]] += 1
    out = []
    for i, url, html in rows:
        page, votes = Page(html or ""), counted[host(url)]
        found = None
        for path, n in sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:3]:
            if found is None and n >= 0.1 * sum(votes.values()):
                found = page.on([path])
        out.append((i, url, own(html or "") if found is None else found))
    return sorted(out, key=repr)


def test_hosts_agree(spark):
    """A page on which a long sidebar without a name outweighs the text follows its host; another host's page does not."""
    usual = "<div class=cols><div class='text t{0}'><p>Text number {0}, a few words.</p></div><div class=col2><p>{1}</p></div></div>"
    odd = usual.format(9, "All the news of the week, and much more of it than of the text. " * 3)
    rows = [(k, f"https://Site.example/{k}", usual.format(k, "Short.")) for k in range(12)] + [(90, "http://site.example?x", odd), (91, "http://other.example/1", odd), (92, None, odd), (93, "no address", odd), (94, "http://site.example/plain", "plain words"), (95, "http://site.example/", None), (None, "http://site.example/", ""), (90, "http://site.example", odd)]
    want = brute(rows)
    by = dict((i, t) for i, _, t in want if i is not None)
    assert by[90] == "Text number 9, a few words." and by[91].startswith("All the news") and by[92] == by[93] == by[91] and by[94] == "plain words" and by[95] == ""
    for few in (50_000, 1, 0):
        got = main_text.extracted(clashing(pages(spark, rows)).repartition(5), few)
        assert got.columns == ["page_id", "url", "text", "n_chars"]
        got = got.collect()
        assert sorted([(r.page_id, r.url, r.text) for r in got], key=repr) == want and all(r.n_chars == len(r.text) for r in got)


def test_empty_and_long(spark):
    assert main_text.extracted(pages(spark, [])).collect() == []
    long = "<p>" + "word &amp; " * 200_000 + "</p>"
    r = main_text.extracted(pages(spark, [(1, "http://a/b", "<article>" + long + "</article>")])).collect()[0]
    assert r.n_chars == len("word & " * 200_000) - 1


def test_given_pages(spark):
    """The articles of the given pages, by a plain cut."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    got = {r.page_id: r.text for r in main_text.op12_main_text(spark, SMALL).collect()}
    for i, _, html in rows:
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", html, re.S)[1])]
        assert got[i] == "\n".join(b for b in blocks if b)


def test_frequent_from(spark):
    t = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 1, 2, 3, 4, 9, 100])], "k int, n long").withColumn("n", F.col("n"))
    assert [frequent_from(t, "n", m) for m in (0, 1, 2, 3, 5, 8)] == [128, 16, 8, 4, 2, 1]
    assert frequent_from(t.limit(0), "n", 5) == 1
