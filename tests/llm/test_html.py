"""Extraction against a plain extractor of its own, and pages that once lost text."""

import os
import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from dyadflow.llm import html, html_blocks, html_model

BREAKS = set("p div article section main header footer nav aside ul ol li h1 h2 h3 h4 h5 h6 blockquote pre table tr td th body html head title form".split())
LEFT_OUT = {"script", "style", "nav", "header", "footer", "aside", "form", "title"}


class Plain(HTMLParser):
    """Text between block-level tags, by the standard library's parser; with `main`, that inside <article> only and without
    what LEFT_OUT and class="ad" hold."""

    def __init__(self, main=False):
        super().__init__()
        self.main, self.out, self.now, self.open = main, [], [], []

    def flush(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.flush()
        if tag == "br":
            self.now.append(" ")
        elif tag not in html_blocks.VOID:
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.flush()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        inside = not self.main or ("article" in tags and not tags & LEFT_OUT and ("div", "ad") not in self.open)
        if inside and not tags & {"script", "style"}:
            self.now.append(data)


def plain(page, main=False):
    p = Plain(main)
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def well_formed(r):
    def inside(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            x = r.random()
            if x < 0.4 or not depth:
                out.append(r.choice(["plain  text", " a &amp; b ", "\n", "é &#233;", "x<br>y", "<!-- no <p> -->", "<b>bold</b>", "<script>var x='<p>'</script>", "1 &lt; 2"]))
            elif x < 0.5:
                out.append(f"<a href='/x'>{r.choice(['one', 'two words'])}</a>")
            else:
                t = r.choice(["div", "section", "article", "ul", "blockquote", "h2"])
                out.append(f"<{t} class='c{r.randrange(9)}'>{inside(depth - 1)}</{t}>")
        return "".join(out)

    return inside(5)


def test_blocks_are_those_of_a_plain_parser():
    r = random.Random(3)
    for _ in range(300):
        page = well_formed(r)
        assert [b.text for b in html_blocks.blocks_of(page)] == plain(page)


def test_no_text_is_lost():
    texts = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert texts("<p>İ</p><SCRIPT>x</SCRIPT><p>tail text</p>") == ["İ", "tail text"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> be five.</p>") == ["Let x=5 be five."]
    assert texts("<p>a<noscript>b</noscript>c<object>d</object><svg><text>e</text></svg></p>") == ["a", "b", "c", "d", "e"]
    deep = html_blocks.blocks_of("<div>" * 5000 + "<article><p>in" + "</div>" * 5000)
    assert [t for t, _ in deep[0].path][-2:] == ["article", "p"] and deep[0].node.depth == 5002


def test_features_read_every_word_and_every_element():
    row = lambda page: html_model.features(html_blocks.blocks_of(page))[0].tolist()
    head = "w " * 40
    assert row(f"<p>{head}one") != row(f"<p>{head}two") and row("<p>" + "x" * 30 + "a") != row("<p>" + "x" * 30 + "b")
    inside = "<div>" * 300
    assert row(f"{inside}<article>x") != row(f"{inside}<section>x")
    assert row("<div class='" + "mt-4 " * 50 + "sidebar'>x") != row("<div class='" + "mt-4 " * 50 + "content'>x")


def test_odd_pages(spark):
    page = "<article><h1>T</h1>" + "<p>Some words of text, and more.</p>" * 20_000 + "</article>"
    rows = [(None, None, None), (1, "u", ""), (1, "u", page), (1, "u", page), (2, None, "<"), (3, "v", "<div>" * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS label")
    got = [r.text for r in html.extract(d).collect()]
    assert sorted(map(len, got))[:3] == [0, 0, 0] and sum(t.count("\n") == 20_000 for t in got) == 2
    assert html.extract(d.limit(0)).count() == 0


def test_a_stored_model_is_the_trained_one(spark):
    first, again = html.stored_model(spark), html.stored_model(spark)
    assert all((first.w[k] == again.w[k]).all() for k in first.w) and first.w.keys() == again.w.keys()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="needs the test tables")
def test_pages_that_the_generator_did_not_make(spark):
    """Whole texts of whole pages against the plain extractor, which knows these pages' tags."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    got = html.main_texts([p or "" for p in pages], html.stored_model(spark))
    same = sum("\n".join(plain(p or "", True)) == t for p, t in zip(pages, got, strict=True))
    assert same >= 0.99 * len(pages), f"{same} of {len(pages)}"
