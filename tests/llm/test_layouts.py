"""Pages whose main text stands in other elements than article and main."""

from __future__ import annotations

import re

import pytest

from railyard.llm import html_extract

SF = "/root/testdata/sf0.01"


def renamed(page, opening, closing):
    return re.sub("</(article|main)>", closing, re.sub("<(article|main)[^>]*>", opening, page))


def marked_text(page):
    found = html_extract.blocks(page)
    return html_extract.main_text(found, html_extract.structural_marks(found))


@pytest.mark.parametrize("opening, closing", [("<div>", "</div>"), ("<div class=entry>", "</div>"), ("<table><tr><td>", "</td></tr></table>")])
def test_pages_without_article_or_main_keep_their_text(spark, opening, closing):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = {i: marked_text(h) for i, h in pages}
    table = spark.createDataFrame([(i, "u", renamed(h, opening, closing)) for i, h in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.digest(table).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_unmarked_pages_have_no_labels_of_their_own():
    assert html_extract.structural_marks(html_extract.blocks("<div><p>some text</p></div>")) is None
    assert html_extract.structural_marks(html_extract.blocks("<nav>a</nav><article><p>b</p></article>")).tolist() == [0, 1]
