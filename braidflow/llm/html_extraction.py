"""HTML extraction: flat text blocks classified by a decision tree.

A page is read once into flat blocks of text between block-level tags. Each has its word count, its
link density, those of its neighbours, and what its open elements say of it. A small decision tree,
trained at start on the labelled table below, tells the main text from the rest; no feature decides by itself. A
class, id or role counts as a hint if one of its names is made of the words of HINTS and FRAMES alone and has
one of HINTS: "comment-list" does, "related-work" doesn't.

Defined cases: a null or empty page gives an empty text; a tag that is never closed (or a quoted value in it) is
dropped with what follows it; values without quotes may hold quotes; markup errors and unknown elements are read as
browsers do where that is simple; repeated pages each get their row; other columns do not matter.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from braidflow.llm.common import slices, table

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio canvas".split())
RAW = set("script style title textarea iframe noembed noframes noscript xmp template svg object".split())
BOILERPLATE = set("nav footer aside form menu dialog select button head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that tell what a container holds.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead toolbar comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search pager pagination copyright skip toc hidden".split()
)

# Words that say no more than that something is a container.
FRAMES = set("box block wrapper wrap container list area section inner outer item items bar site page main global top bottom left right posts post articles links link button buttons form text title policy message slot unit col column row panel body thread entry secondary primary holder group content user reader latest more icons icon module placeholder".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_OTHER = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boilerplate", "hinted", "in_article", "page_has_article", "heading")

#: words, links, words_before, links_before, words_after, links_after, boilerplate, hinted, in_article, page_has_article, heading -> main text
LABELLED = """
6 1.0 0 0 6 1.0 1 0 0 1 0 0
1 1.0 1 1.0 1 1.0 1 0 0 1 0 0
1 1.0 1 1.0 1 1.0 1 0 0 0 0 0
9 0.0 1 1.0 12 0.0 1 0 0 1 0 0
24 0.1 60 0.0 0 0.0 1 0 0 1 0 0
11 0.1 40 0.0 0 0.0 1 0 0 0 0 0
30 0.0 10 0.0 40 0.0 1 0 1 1 0 0
14 0.0 30 0.0 55 0.0 1 0 1 1 0 0
60 0.0 30 0.0 25 0.0 1 0 0 0 0 0
8 0.0 1 1.0 11 0.0 0 1 0 1 0 0
7 0.0 1 1.0 45 0.0 0 1 0 1 0 0
15 0.2 40 0.0 60 0.0 0 1 1 1 0 0
22 0.0 70 0.0 35 0.0 0 1 1 1 0 0
80 0.0 20 0.0 30 0.0 0 1 1 1 0 0
45 0.0 0 0.0 50 0.0 0 1 0 0 0 0
5 0.0 90 0.0 12 0.0 0 1 0 0 0 0
12 0.0 8 0.0 30 0.0 0 0 1 1 1 1
5 0.0 40 0.0 50 0.0 0 0 1 1 1 1
1 0.0 40 0.0 1 0.0 0 0 1 1 0 1
2 0.0 1 0.0 3 0.0 0 0 1 1 0 1
3 0.0 60 0.0 0 0.0 0 0 1 1 0 1
60 0.0 1 0.0 40 0.0 0 0 1 1 0 1
130 0.1 60 0.0 2 0.0 0 0 1 1 0 1
25 0.4 50 0.0 30 0.0 0 0 1 1 0 1
10 0.7 50 0.0 30 0.0 0 0 1 1 0 1
4 1.0 55 0.0 60 0.0 0 0 1 1 0 1
9 0.0 1 1.0 50 0.0 0 0 0 1 0 0
30 0.0 60 0.0 0 0.0 0 0 0 1 0 0
3 1.0 4 1.0 5 1.0 0 0 0 1 0 0
55 0.0 10 0.0 12 0.0 0 0 0 1 0 0
8 0.0 0 0.0 12 0.0 0 0 0 1 1 0
70 0.0 12 0.0 65 0.0 0 0 0 0 0 1
40 0.1 8 0.0 30 0.0 0 0 0 0 0 1
25 0.2 30 0.0 40 0.0 0 0 0 0 0 1
16 0.0 45 0.0 50 0.0 0 0 0 0 0 1
6 0.0 50 0.0 45 0.0 0 0 0 0 0 1
2 0.0 35 0.0 60 0.0 0 0 0 0 0 1
4 0.0 60 0.0 30 0.0 0 0 0 0 1 1
8 0.0 2 1.0 55 0.0 0 0 0 0 1 1
7 0.0 0 0.0 40 0.0 0 0 0 0 1 1
3 0.0 2 1.0 2 1.0 0 0 0 0 1 0
5 0.0 3 1.0 1 1.0 0 0 0 0 0 0
2 1.0 3 1.0 2 1.0 0 0 0 0 0 0
4 0.9 50 0.0 3 1.0 0 0 0 0 0 0
18 0.8 2 1.0 5 1.0 0 0 0 0 0 0
35 0.9 5 1.0 40 1.0 0 0 0 0 0 0
4 0.0 1 0.0 3 0.0 0 0 0 0 0 0
5 0.0 3 0.0 0 0.0 0 0 0 0 0 0
3 0.0 0 0.0 2 1.0 0 0 0 0 0 0
5 0.0 4 0.0 3 0.0 1 0 1 1 0 0
3 0.0 2 0.0 40 0.0 1 0 1 1 0 0
12 0.5 3 0.0 8 0.0 1 0 1 1 0 0
40 0.0 8 0.0 6 0.0 1 0 1 1 0 0
4 0.0 30 0.0 9 0.0 1 0 1 1 1 0
65 0.1 12 0.0 90 0.0 1 0 1 1 0 0
2 1.0 2 1.0 30 0.0 1 0 1 1 0 0
5 0.0 4 0.0 3 0.0 0 1 1 1 0 0
3 0.0 2 0.0 40 0.0 0 1 1 1 0 0
12 0.5 3 0.0 8 0.0 0 1 1 1 0 0
40 0.0 8 0.0 6 0.0 0 1 1 1 0 0
4 0.0 30 0.0 9 0.0 0 1 1 1 1 0
65 0.1 12 0.0 90 0.0 0 1 1 1 0 0
2 1.0 2 1.0 30 0.0 0 1 1 1 0 0
35 0.0 60 0.0 45 0.0 1 0 0 0 0 0
12 0.0 60 0.0 3 0.0 1 0 0 0 0 0
35 0.0 60 0.0 45 0.0 0 1 0 0 0 0
12 0.0 60 0.0 3 0.0 0 1 0 0 0 0
50 0.0 60 0.0 3 0.0 1 0 0 0 0 0
50 0.0 60 0.0 3 0.0 0 1 0 0 0 0
20 0.0 25 0.0 30 0.0 0 1 0 0 0 0
20 0.0 25 0.0 30 0.0 1 0 0 0 0 0
90 0.0 30 0.0 6 0.0 0 0 0 0 0 1
33 0.0 0 0.0 4 0.0 0 0 0 0 0 1
48 0.1 3 1.0 2 1.0 0 0 0 0 0 1
28 0.0 6 0.0 5 0.0 0 0 0 0 0 1
14 0.0 20 0.0 22 0.0 0 0 0 0 0 1
45 0.0 28 0.0 31 0.0 0 0 1 1 0 1
2 0.0 3 0.0 33 0.0 0 0 1 1 0 1
80 0.0 70 0.0 60 0.0 0 0 1 1 0 1
6 0.0 7 0.0 35 0.0 0 0 0 1 0 0
60 0.0 50 0.0 70 0.0 0 0 0 1 0 0
12 0.0 30 0.0 4 1.0 0 0 1 1 0 1
5 0.0 12 0.0 3 0.8 0 0 1 1 0 1
30 0.1 2 0.0 2 1.0 0 0 1 1 0 1
2 0.0 9 0.0 6 0.6 0 0 1 1 1 1
40 0.0 35 0.0 0 0.0 0 0 0 0 0 1
25 0.0 45 0.0 1 1.0 0 0 0 0 0 1
34 0.0 1 0.0 1 0.0 0 0 0 0 0 1
22 0.0 4 0.0 2 0.0 0 0 0 0 0 1
2 0.0 4 0.0 2 0.0 0 0 0 0 0 0
1 1.0 30 0.0 40 0.0 0 0 0 0 0 0
6 1.0 40 0.0 33 0.0 0 0 0 0 0 0
3 0.0 1 1.0 1 1.0 0 0 0 0 0 0
3 0.0 46 0.0 24 0.0 0 0 0 0 0 1
5 0.0 22 0.0 23 0.0 0 0 0 0 0 1
2 0.0 70 0.0 18 0.0 0 0 0 0 0 1
24 0.0 3 0.0 2 1.0 0 0 0 0 0 1
"""


def labelled_blocks() -> np.ndarray:
    return np.array([[float(x) for x in line.split()] for line in LABELLED.split("\n") if line])


def grow(rows: np.ndarray, depth: int = 8):
    """A tree by least Gini impurity: a leaf is a class, a node (feature, bound, at most, above)."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= bound
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound), left)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, bound, left = best
    return f, bound, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)


def classify(tree, block: tuple) -> int:
    while not isinstance(tree, int):
        f, bound, low, high = tree
        tree = low if block[f] <= bound else high
    return tree


def _hinted(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and _NONE.search(value):
            return True
        if name in ("class", "id", "role"):
            for x in value.split():
                parts = {w.lower() for w in _PART.findall(x)}
                if parts & HINTS and parts <= HINTS | FRAMES:
                    return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """The page's text blocks in order: text, words, words in links, boilerplate, hinted, in article, heading."""
    out: list[tuple] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, hinted
    n_boiler = n_hinted = n_article = n_links = n_headings = 0

    def count(item: tuple[str, bool, bool], by: int) -> None:
        nonlocal n_boiler, n_hinted, n_article, n_links, n_headings
        name, boiler, hinted = item
        n_boiler += by * boiler
        n_hinted += by * hinted
        n_article += by * (name in ("article", "main"))
        n_links += by * (name == "a")
        n_headings += by * (name in HEADINGS)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, text.count(" ") + 1, sum(len(x.split()) for x in linked), n_boiler > 0, n_hinted > 0, n_article > 0, n_headings > 0))
            parts.clear()
            linked.clear()

    def close(at: int) -> None:
        for item in stack[at:]:
            count(item, -1)
        del stack[at:]

    def say(text: str) -> None:
        if text:
            text = _html.unescape(text)
            parts.append(text)
            if n_links:
                linked.append(text)

    at = 0
    while (to := page.find("<", at)) >= 0:
        say(page[at:to])
        found = _TAG.match(page, to)
        if not found:
            after = page[to + 1 : to + 2]
            if other := _OTHER.match(page, to):
                at = other.end()
            elif after.isascii() and after.isalpha():
                at = len(page)
            else:
                say("<")
                at = to + 1
            continue
        at = found.end()
        end, name, attributes = found[1], found[2].lower(), found[3]
        if end:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("body", "html"):
                    break
            continue
        if name in RAW and not attributes.endswith("/"):
            if name in ("textarea", "iframe", "object", "svg"):
                say(" ")
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" and name != "br" or stack[k][0] == name == "li":
                    close(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in HEADINGS:
                    break
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name == "a" and n_links:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    close(k)
                    break
        boiler = name in BOILERPLATE or name == "header" and not n_article
        item = (name, boiler, bool(attributes) and name not in ("html", "body", "article", "main") and _hinted(attributes))
        stack.append(item)
        count(item, 1)
    say(page[at:])
    flush()
    return out


def extract(page: str | None, tree) -> str:
    """The page's main text: the blocks that the tree takes, joined by one space."""
    found = blocks(page or "")
    article = any(b[5] for b in found)
    density = [b[2] / b[1] for b in found]
    kept = []
    for k, (text, words, _, boiler, hinted, inside, heading) in enumerate(found):
        before = (found[k - 1][1], density[k - 1]) if k else (0, 0.0)
        after = (found[k + 1][1], density[k + 1]) if k + 1 < len(found) else (0, 0.0)
        if classify(tree, (words, density[k], *before, *after, boiler, hinted, inside, article, heading)):
            kept.append(text)
    return " ".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tree = grow(labelled_blocks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
