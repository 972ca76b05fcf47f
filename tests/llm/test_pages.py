"""Main text: time that grows with the page, unclosed scripts, strangers inside the article, the given pages."""

import os
import random
import time
from html.parser import HTMLParser

import pytest

from stationwatch.llm import html_extract

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize("piece", ['<p "', '<p a="', '<a b=">"', "<p ", "<button>", "</x>", "<div>x", "<!--", "<![CDATA[", "&amp", "<p class   "])
def test_long_pages_take_time_in_proportion(piece):
    began = time.process_time()
    html_extract.leaf_blocks("<div>" * 100 + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 10


def test_unclosed_scripts_are_no_text():
    for tag in ("script", "style", "textarea"):
        assert [b[0] for b in html_extract.leaf_blocks(f"<body><p>seen</p><{tag}>var a = 1; if (a < 2) b()<p>unseen")] == ["seen"]
    assert [b[0] for b in html_extract.leaf_blocks('<body><p title="a > b">x &amp; y<br>z<p>1 < 2<button>no</button> <b>bold</b>')] == ["x & y z", "1 < 2 bold"]


def _sentences(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("ba be di do ku".split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(n)]


def test_strangers_inside_the_article(spark):
    """Comments, adverts and notices that are descendants of the article's own element."""
    s = _sentences(400, 3)
    pages = []
    for i in range(40):
        a, b = " ".join(s[i : i + 4]), " ".join(s[50 + i : 53 + i])
        pages.append((i, f"<article><h1>{s[i]}</h1><p>{a}</p><div class='ad'>{s[200 + i]}</div><p>{b}</p><section class='comments'><h3>Two said</h3><div class='comment'><p>{s[300 + i]}</p></div></section></article><footer>{s[9]}</footer>", f"{s[i]} {a} {b}"))
    df = spark.createDataFrame([p[:2] for p in pages], "page_id long, html string")
    field = html_extract.fit(spark.createDataFrame([(i, f"<p>{' '.join(s[i : i + 9])}") for i in range(200)], "page_id long, html string"), made=400)
    found = {r.page_id: r.text for r in html_extract.extract(df, field).collect()}
    assert sum(found[i] == wanted for i, _, wanted in pages) >= 36


class _Article(HTMLParser):
    """An independent reading of the given pages, whose article element holds the article and nothing else."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts += [" "] if tag in ("p", "h1", "br", "ul", "li", "div", "blockquote") else []

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts += [" "] if tag in ("p", "h1", "ul", "li", "div", "blockquote") else []

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the given tables are not here")
def test_given_pages(spark):
    df = spark.read.parquet(PAGES)
    rows = df.collect()
    found = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    right = 0
    for r in rows:
        parser = _Article()
        parser.feed(r["html"] or "")
        right += found[r.page_id] == " ".join("".join(parser.parts).split())
    assert right >= 0.98 * len(rows)
