import itertools
import random
import re
import time
from html import unescape

import numpy as np

from tessella.llm import html_extract as hx


def test_held_out_pages():
    rng, right, total = random.Random(12345), 0, 0
    pages = [hx.training_page(rng) for _ in range(250)]
    model = hx.trained()
    for source, blocks in pages:
        page = hx.Page(source)
        got = set(hx.main_text(page, model.score(page.features())).split("\n"))
        total += len(blocks)
        right += sum((text in got) == wanted for text, wanted in blocks)
    assert right / total >= 0.97


def test_decoding_is_the_best_choice():
    rng = random.Random(2)
    for _ in range(40):
        page = hx.Page("")
        n = rng.randint(1, 9)
        page.tags, page.parents = ["div"] * n, [-1] + [rng.randrange(k) for k in range(1, n)]
        odds = np.array([rng.uniform(-2, 2) for _ in range(n)])
        score = lambda kept: sum(o for o, k in zip(odds, kept) if k)
        allowed = [k for k in itertools.product((False, True), repeat=n) if all(not k[e] or k[page.parents[e]] for e in range(1, n))]
        got = hx.decode(page, odds)
        assert tuple(got) in allowed and abs(score(got) - max(map(score, allowed))) < 1e-9


def test_parsing():
    runs = lambda s: [t for _, t, _ in hx.Page(s).runs]
    assert runs("<p>a &amp; b&nbsp;c<br>d <b>e</b>f<p>g") == ["a & b c d ef", "g"]
    assert runs("<div>x<script>if (a<b) '</p>'</script>y</div><!-- no --><style>p{}</style>z") == ["xy", "z"]
    assert runs('<p title="a>b">c</p><p>d < e</p><p>f<') == ["c", "d < e", "f<"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert runs("") == [] and runs("   ") == [] and runs("no tags") == ["no tags"]


def by_hand(source):
    """The text of the given tables' article: their other parts stand outside it."""
    inner = re.search(r"(?s)<article>(.*)</article>", source)[1]
    inner = re.sub(r"(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", inner)
    blocks = re.split(r"</?(?:p|h1|div|ul|li|section|aside|form|nav|h2)\b[^>]*>", inner)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in hx.op10_main_text(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[r["page_id"]] == by_hand(r["html"]) for r in pages)


def test_edges(spark):
    long = "<article>" + "<p>A sentence of the story, long enough to count.</p>" * 5000 + "</article>"
    rows = [(1, None, "a", 5), (1, None, "a", 5), (2, "", "b", 5), (None, "<html></html>", "c", 5), (3, long, "d", 5), (4, "<div>" * 3000 + "deep", "e", 5)]
    got = hx.extract(spark.createDataFrame(rows, "page_id long, html string, url string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r["url"]: r for r in got.collect()}
    assert by["a"]["text"] == by["b"]["text"] == by["c"]["text"] == "" and by["a"]["n_chars"] == 0
    assert by["d"]["text"].count("\n") == 4999 and by["d"]["n_chars"] == len(by["d"]["text"])
    assert got.count() == 6 and hx.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_elements_that_close_themselves_and_content_elements():
    page = lambda inner: hx.Page(f"<html><body><article>{inner}</article></body></html>")
    texts = lambda inner: [t for _, t, _ in page(inner).runs]
    assert texts("<svg class='i'/><p>Kept text one.</p>") == ["Kept text one."]
    assert texts("<math/><p>a</p><svg><title/><path d='x'/></svg><p>b</p>") == ["a", "b"]
    assert texts("<p>x <math><mi>y</mi></math> z</p><noscript><p>n</p></noscript><object>o</object>") == ["x y z", "n", "o"]
    assert texts("<svg><style>.a{}</style><title>t</title></svg><script/>gone</script><p>c</p>") == ["c"]


def test_column_with_a_dot(spark):
    df = spark.createDataFrame([(1, "<article><p>Some text of a page, long enough.</p></article>", "v")], "page_id long, html string, `a.b` string")
    assert hx.extract(df).columns == ["page_id", "a.b", "text", "n_chars"]


def test_deep_nesting_closed_again():
    """100,000 open elements, all closed, in seconds."""
    n, began = 100_000, time.monotonic()
    page = hx.Page("<div>" * n + "<p>within" + "</div>" * n + "<p>after</p>")
    assert time.monotonic() - began < 20
    assert [r[1] for r in page.runs] == ["within", "after"] and len(page.tags) == n + 3 and page.parents[-1] == 0
