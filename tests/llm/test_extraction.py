"""Main text of small pages in several layouts, and of the pages in the test tables."""

import itertools
import random
import re
import time

from assayer.llm import extraction
from assayer.llm.markup import blocks, pieces
from plain import rows

PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/">Home page</a></li><li><a href="/x">More links</a></li></ul></nav>
{article}
<aside>Side words here</aside><div class="comments"><p>First reader says something at length here.</p></div>
<form><label>Search</label><input><button>Go now</button></form><footer>&copy; the owners of it all</footer></body></html>"""
INNER = """<h1>Big &amp; bold</h1><p>One  two
three &lt;four&gt; <b>five</b>&nbsp;six.</p><div class="ad">Buy this now</div><p>Seven<br>eight<sub>2</sub>.<!-- no --></p><ul><li>nine<li>ten</ul>
<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><div id="cookie-notice">We use cookies</div><pre>x
 y</pre>"""
TEXT = "Big & bold\n\nOne two three <four> five six.\n\nSeven eight2.\n\nnine\n\nten\n\na b\n\nc\n\nx y"


def weights():
    pages = [PAGE.format(article=f"<article>{INNER}</article>")] * 3
    counts = {}
    for page in pages:
        for feature, inside, outside in extraction.count_features(page):
            a, b = counts.get(feature, (0, 0))
            counts[feature] = a + inside, b + outside
    return extraction.weights_of((f, a, b) for f, (a, b) in counts.items())


def test_layouts():
    for learned in (weights(), {}):
        for article in (f"<article>{INNER}</article>", f"<main><article>{INNER}", f"<div class='content'>{INNER}</div>"):
            assert extraction.extract(PAGE.format(article=article), dict(learned)) == TEXT
    assert extraction.extract(PAGE.format(article="<article></article>"), weights()) == ""
    for page in (None, "", "   ", "<", "<!-- open", "<p", "</p></div>", "<script>x"):
        assert not extraction.extract(page, weights()).strip("<p")
    assert extraction.extract("plain words &amp; no tag " * 3, {}) == " ".join(["plain words & no tag"] * 3)


def test_best_stretch_is_the_best_of_all():
    dice = random.Random(1)
    for _ in range(200):
        scores = [dice.choice([-2.5, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(dice.randint(0, 12))]
        first, end = extraction.best_stretch(scores)
        sums = [sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)]
        assert abs(sum(scores[first:end]) - max([0, *sums])) < 1e-9


def test_markup():
    assert blocks(pieces('<p title="a > b">x</p><p data-a=\'<\'>y')) == ["x", "y"]
    assert blocks(pieces("a<b>b</b>c<br/>d<hr>e &eacute; 1 < 2")) == ["abc d", "e é 1 < 2"]
    assert [p.aside for p in pieces('<div class="mainAd box"><p>x</div>y') if not p.tag] == [True, False]
    assert blocks(p for p in pieces('<article><div class="article-header"><h1>T</h1></div><p>x</p></article><div class="header">no</div>') if p.tag or not p.aside) == ["T", "x"]
    assert [p.aside for p in pieces('<div class="adapted readme"><p>x</div>') if not p.tag] == [False]


def test_pages_give_their_documents_back(spark, small):
    texts = {d["doc_id"]: d["text"] for d in rows(small, "documents")}
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = extraction.extract_text(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        number = re.search(r"/(\d+)[^/]*/?$", r["url"])
        lines = [" ".join(x.split()) for x in texts[int(number[1])].split("\n")]
        assert r["text"].endswith("\n\n".join(x for x in lines if x))


def test_tables(spark):
    page = PAGE.format(article=f"<article>{INNER}</article>")
    pages = spark.createDataFrame([(1, page, "mine"), (1, page, "mine"), (2, None, "mine"), (3, "", "mine"), (4, f"<p>{'word ' * 50_000}</p>", "mine")], "id int, html string, text string")
    got = sorted((r["id"], r["text"]) for r in extraction.extract_text(pages).collect())
    assert got == [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, ("word " * 50_000).strip())]
    assert extraction.extract_text(pages.limit(0)).collect() == []


def test_what_html_says_and_what_names_mean():
    def text(page):
        return extraction.extract(page, weights())

    # A slash before the end of a start tag ends no script, quoted or not.
    for tag in ('<script src="a.js"/>', "<script src=/x/>"):
        assert text(f"<article><p>kept words</p>{tag}var secret = 1;</script><p>more words</p></article>") == "kept words\n\nmore words"
    assert text("<article><div/><p>inside it</p></article>") == "inside it"
    # A listed word as a part of another name says nothing.
    for name in ("share-of-market", "related-work", "commentary", "ad-hoc-methods"):
        assert text(f'<article><p>first words</p><div class="{name}"><p>second words</p></div></article>') == "first words\n\nsecond words"
    for name in ("share-buttons", "site-footer", "comment-list", "nav_left", "box sidebarRight"):
        assert text(f'<article><p>first words</p><div class="{name}"><p>second words</p></div></article>') == "first words"
    # Readers' comments are set aside also where they are articles.
    comment = '<article class="comment"><p>I say it was better before</p></article>'
    assert text(f"<main><article><p>first words</p></article>{comment}</main>") == "first words"


def test_the_mark_is_no_feature():
    """With marks renamed the learned weights find the same text."""
    page = PAGE.format(article=f"<article>{INNER}</article>")
    assert extraction.extract(page.replace("article>", "div>"), weights()) == extraction.extract(page, weights()) == TEXT
    assert not any("in" in f.split() or "out" in f.split() for f in weights())


def test_deep_and_unbalanced_markup_takes_linear_time():
    start = time.process_time()
    n = 100_000
    for page in ("<div>" * n + "</span>" * n + "words", "<div><b>" * n + "</div>" * n, "<p><span>" * n, "</div>" * n + "<a>" * n):
        assert sum(1 for _ in pieces(page)) >= 2 * n
    assert time.process_time() - start < 20
