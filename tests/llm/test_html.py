"""Extraction against another parser, awkward markup, and that densities decide."""

import html.parser
import os

import pyarrow.parquet as pq
import pytest

from braidflow.llm import html_extraction as extraction

TREE = extraction.grow(extraction.labelled_blocks())
PAGES = "/root/testdata/sf0.01/pages.parquet"


class Article(html.parser.HTMLParser):
    """The text inside article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in extraction.BLOCK:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in extraction.BLOCK:
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no pages here")
def test_equals_another_parser():
    for page in pq.read_table(PAGES).column("html").to_pylist():
        other = Article()
        other.feed(page)
        other.close()
        assert extraction.extract(page, TREE) == " ".join(x for b in other.blocks if (x := " ".join("".join(b).split())))


TEXT = "This is a paragraph of the article that has quite a number of words in it, so that nobody would take it for a menu."


def page(inner, head=""):
    return f"<html><body><nav><a href=/>Home</a></nav>{head}<article><h1>A title</h1><p>{TEXT}</p>{inner}<p>{TEXT}</p></article><footer>All rights reserved</footer></body></html>"


@pytest.mark.parametrize("inner", ["<p data-x=don't>{}</p>", '<div class="search-theory"><p>{}</p></div>', '<section id="related-work"><p>{}</p></section>', '<p class="hidden-markov">{}</p>', '<div aria-label="Search trees"><p>{}</p></div>', "<p title='hidden one'>{}</p>", "<p a='x>y' b=\"p>q\" c=r\"s>{}</p>"])
def test_text_of_the_article_stays(inner):
    assert extraction.extract(page(inner.format(TEXT)), TREE) == f"A title {TEXT} {TEXT} {TEXT}"


def test_formulas_stay():
    assert extraction.extract(page(f"<p>{TEXT} <math><mi>x</mi>+<mn>1</mn></math></p>"), TREE) == f"A title {TEXT} {TEXT} x+1 {TEXT}"


@pytest.mark.parametrize("inner", ['<div class="comment-list"><p>{}</p></div>', '<div class="ad">{}</div>', '<aside><p>{}</p></aside>', '<div id="cookie-notice">{}</div>', "<form><p>{}</p></form>", "<p hidden>{}</p>", "<script>{}</script>", "<div style='display: none'>{}</div>"])
def test_the_rest_goes(inner):
    assert extraction.extract(page(inner.format("Buy one of these now and get another one")), TREE) == f"A title {TEXT} {TEXT}"


def test_densities_decide_where_no_element_says_anything():
    """Nothing but div, p and a: menus and footers go by their link densities and word counts, and those around them."""
    links = "".join(f"<div><a href=/{k}>Section {k}</a></div>" for k in range(6))
    found = f"<body>{links}<div>{TEXT}</div><div>{TEXT} {TEXT}</div><div>A short one.</div><div>{TEXT}</div>{links}<div>Imprint</div></body>"
    assert extraction.extract(found, TREE) == f"{TEXT} {TEXT} {TEXT} A short one. {TEXT}"

    def used(tree):
        return set() if isinstance(tree, int) else {extraction.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    assert {"words", "links"} <= used(TREE) and used(TREE) & {"words_before", "words_after", "links_before", "links_after"}


def test_repeated_pages_and_clashing_names(spark):
    rows = [(1, "u", page(""), "x", 3)] * 2 + [(None, None, None, None, None), (2, "u", "", "x", 3)]
    out = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in out) == sorted([("1", f"A title {TEXT} {TEXT}", len(f"A title {TEXT} {TEXT}"))] * 2 + [("None", "", 0), ("2", "", 0)])
