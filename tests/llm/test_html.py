"""Main text of pages: odd markup, pages of designs it has not seen, linear work, plain versions of its parts."""

import random
import time

import numpy as np
import pytest

from quillspark.llm import html_extract


def test_html_main_text():
    page = """<html><head><title>No</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="content"><h1>Title &amp; more</h1><p>First <b>bold</b>
    para<p>Second<br>line&nbsp;x<!-- c --><script>var a="</p>";</script><div class="ad">Buy</div><p>Third &lt;tag&gt;</div>
    <section class="comments"><p>long reader comment of many words here to tempt the scan into it and beyond</p></section><aside>Side</aside><footer>Foot</footer>"""
    assert html_extract.blocks(page) == ["Title & more", "First bold para", "Second line x", "Third <tag>"]
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>a</nav>") == ""
    assert html_extract.main_text("<article><p>cut off te") == "cut off te" and html_extract.main_text("<p>a<p cla") == "a"
    assert html_extract.main_text("<div>" * 20_000 + "deep") == "deep"


def test_pages_it_did_not_learn_from():
    right = 0
    pages = html_extract.labelled_pages(200, seed=99)
    for page in pages:
        gold, now = [], []
        for kind, value, _ in html_extract.pieces("".join(markup if label else "<hr>" for markup, label in page)):
            if kind == "text":
                now.append(value)
            elif value == "br":
                now.append(" ")
            elif value not in html_extract.INLINE:
                gold, now = [*gold, " ".join("".join(now).split())], []
        right += html_extract.blocks("".join(markup for markup, _ in page)) == [x for x in gold if x]
    assert right >= 0.88 * len(pages)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<article><p>one</p><object data=x><p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><svg><p>two</p><select><p>three</article>", ["one", "two", "three"]),
        ("<article><p>one</p><video src=x><p>two<canvas><p>three", ["one", "two", "three"]),
        ("<article><p>one</p><svg><text>no</text></svg><select><option>no</select><p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><script>if (a<b) '</article>'</script><style>p{}</style><p>two</p></article>", ["one", "two"]),
        ("<form id=aspnetForm><header>Site</header><article><h1>T</h1><p>one two three</p></article><footer>f</footer></form>", ["T", "one two three"]),
        ("<article><p>one two</p><div class='popular-science'><p>Popular science is a genre of many words that explain.</p></div></article>", ["one two", "Popular science is a genre of many words that explain."]),
        ("<article><h1>T</h1><section>x</section><div>y</div><ul><li><a href=x>Ref</a></li></ul><div class=ad>buy now</div></article>", ["T", "x", "y", "Ref"]),
        ("<div class=note>n</div><article><b>x<p>y</article></b></i></p>", ["x", "y"]),
        ("<article><p>a &amp; b&nbsp;c &lt;d&gt; &#233;&#x41;</p></article>", ["a & b c <d> éA"]),
        ("<nav><ul><li><a href=/>Home</a></ul></nav>plain<p>words only</p>", ["plain", "words only"]),
        ("<body><div class=cookie-notice><p>We use cookies on this site</p></div><div id=main><h1>T</h1><p>some words of a story</p></div><div class=footer>f g h</div>", ["T", "some words of a story"]),
    ],
)
def test_odd_pages(page, blocks):
    assert html_extract.blocks(page) == blocks


def test_work_is_linear():
    for page in ("<div>{}" * 1, "<b>{}</i>", "</p>{}", "<b>{}<div>x", "<svg>{}"):
        seconds = []
        for n in (4000, 16_000):
            whole, t = page.replace("{}", "w ") * n, time.process_time()
            html_extract.blocks(whole)
            seconds.append(time.process_time() - t)
        assert seconds[1] < 12 * max(seconds[0], 0.05), page


def test_scan_matches_enumeration():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.randint(-9, 9) for _ in range(rng.randint(1, 9))]
        sums = [(sum(s[i:j]), -i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        a, b = html_extract.region(s)
        assert sum(s[a:b]) == max(0, max(sums)[0])


def test_container_weights_are_a_minimum():
    x = np.random.default_rng(1).normal(size=(200, 4))
    y = (x @ [1.0, -2.0, 0.0, 0.5] + np.random.default_rng(2).normal(size=200) > 0).astype(float)
    w = html_extract.logistic(x, y)
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.3 * w
    assert abs(slope).max() < 1e-6


def test_html_table(spark):
    rows = [(1, "u", "<article>a</article>", "old", 5), (2, None, None, "old", 5), (None, "v", "", "old", 5), (1, "u", "<article>a</article>", "old", 5), (4, "w", "<p>" + "é word " * 100_000, "old", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_extract.extract(pages).select("page_id", "text", "n_chars").collect()), key=str)
    whole = ("é word " * 100_000).strip()
    assert got == sorted([(1, "a", 1), (1, "a", 1), (2, "", 0), (None, "", 0), (4, whole, len(whole))], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0
