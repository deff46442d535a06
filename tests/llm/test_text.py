"""Scores, counts, packing, mixing and extraction: exact round trips, brute force, held-out accuracy."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidflow.llm import html_extraction, mixing, ngram_quality, packing, quality_classifier, token_counts
from tests.llm.conftest import SCHEMA, document, prose

PIECES = ["a", "The", " ", "  ", "\n", "\t", "é", "▁", "<s>", "<|endoftext|>", "'s", "12", "tion", "　", "\xa0", "😀", "!!", "\r\n", "\x00", "."]
TEXT = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)


@pytest.fixture(scope="module")
def pieces():
    with open(token_counts.default_model(), "rb") as f:
        proto = f.read()
    return token_counts.PieceCounter(proto, token_counts.frequent_lengths(proto, ["the", "a"]), room=50)


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    with open(packing.default_tokenizer()) as f:
        spec = f.read()
    return packing.BpeIds(spec, room=50), Tokenizer.from_str(spec)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_are_the_librarys(pieces, text):
    assert pieces.count(text) == len(pieces.pieces.encode(text))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(bpe, text):
    ours, library = bpe
    assert ours.ids(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_token_counts(odd, none, pieces):
    got = sorted((tuple(r) for r in token_counts.token_counts(odd, limit=200, frequent=16).collect()), key=repr)
    want = []
    for r in odd.collect():
        n = len(pieces.pieces.encode(r["text"] or ""))
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 200))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(none).count() == 0


def test_packing_round_trip(odd, none, bpe):
    ours, _ = bpe
    rows = packing.pack(odd).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(ours.ids(r["text"] or "").astype("<u4"))
    pieces = defaultdict(Counter)
    for r in rows:
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for doc_id, found in pieces.items():
        assert sum(k[1] * n for k, n in found.items()) == sum(map(len, texts[doc_id]))
        for start, length, crc, total in found:
            assert any(len(x) == total and zlib.crc32(x[start : start + length].tobytes()) == crc for x in texts[doc_id])
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    short = 0
    for parts in windows.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        size = sum(n for _, n in parts)
        assert size <= packing.WINDOW
        short += size < packing.WINDOW
    assert short <= 1
    assert packing.pack(none).count() == 0


def test_neighbours_share_words():
    items = [np.array(x, "<u2") for x in ([5, 6, 7, 7], [8, 9, 10], [7, 6, 11], [5, 12])]
    index = packing.Index(items, np.ones(20), 3.0)
    assert index.neighbours(0).tolist()[:2] == [0, 2]
    filled = list(packing.fill([4, 3, 3, 2], index, 9))
    assert filled[0][0][0] == 0 and filled[0][1][0] == 2
    assert sum(n for w in filled for _, _, n in w) == 12


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    covered = {p for k, x in enumerate(windows) if often[x] > 1 for p in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bé", " ", "\n", "$", "*a b c d e f g h i ", "\x0b", "\xa0", "x y z u v w q r "]), max_size=20).map("".join))
def test_base_statistics(text):
    assert ngram_quality.base_statistics(text.encode()) == base(text)


def test_ngram_quality(odd, none):
    rows = ngram_quality.ngram_quality(odd).collect()
    texts = Counter((r["doc_id"], *base(r["text"] or "")) for r in odd.collect())
    assert Counter(tuple(r)[:6] for r in rows) == texts
    for r in rows:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        assert (r["log2_ppl"] is None) == (r["n_words"] == 0)
    assert all(r["kept"] for r in rows if r["doc_id"] in range(40))
    assert ngram_quality.ngram_quality(none).count() == 0


def test_quality_on_held_out_documents(spark):
    junk = lambda k: " ".join(x + "$$$***"[k % 4 :] for x in prose(k, 80).split())
    rows = [document(k, prose(k, 100) if k % 3 else junk(k)) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score_quality(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)


def test_quality_of_odd_documents(odd, none, labels):
    model = quality_classifier.fit(odd, labels, 30)
    rows = quality_classifier.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality_classifier.keep_good(odd, model).columns == odd.columns
    nothing = quality_classifier.fit(none, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score_quality(odd, nothing).collect()} == {0.5}
    assert quality_classifier.score_quality(none, model).count() == 0


def test_mixing_meets_its_targets(spark, odd, none):
    rows = [document(k, " ".join(f"{'xyz'[k % 3]}{(k * 7 + j * j) % 50}" for j in range(30 + k % 40)), "xyz"[k % 3]) for k in range(600)]
    rows += [document(600, "x1 x2 x3 x4 " * 8 + "y1 y2 y3 y4 " * 8, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labelled = docs.where("doc_id < 300").select("doc_id", docs["lang"].alias("domain"))
    targets = {"x": 0.6, "y": 0.3, "z": 0.1}
    got = mixing.mix(docs, labelled, targets).collect()
    p, t, r = np.array([x["posteriors"] for x in got]), np.array([x["n_tokens"] for x in got]), np.array([x["rate"] for x in got])
    assert np.abs((t * r) @ p / t.sum() - [0.6, 0.3, 0.1]).max() < 0.005 and (r >= 0).all()
    assert all(x["domain"] == "xyz"[x["doc_id"] % 3] for x in got if x["doc_id"] < 600)
    both = next(x for x in got if x["doc_id"] == 600)
    assert 0.4 < both["posteriors"][0] < 0.6 and 0.4 < both["posteriors"][1] < 0.6
    repeated = Counter(x["doc_id"] for x in mixing.repeat(docs, labelled, targets).collect())
    assert repeated == Counter({x["doc_id"]: x["copies"] for x in got if x["copies"]})
    assert mixing.mix(odd, labelled, targets).count() == odd.count() and mixing.repeat(odd, labelled, targets).columns == odd.columns
    assert {x["rate"] for x in mixing.mix(odd, labelled.limit(0), targets).collect()} == {1.0}
    assert mixing.mix(none, labelled, targets).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site for many good reasons.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph with an <a href=x>inline</a> link<b>ed</b> word.<p>Erin.<br>
<div class="ad">Buy this now.</div><p>Last &lt;one&gt;&nbsp;here 5 < 6.</p><section id="comments"><p>Nice article, thank you very much for it!</p></section></article>
<form><label>Mail</label><input></form><!-- no --><footer>&copy; us</footer>"""


def test_extraction(spark):
    tree = html_extraction.grow(html_extraction.labelled_blocks())
    assert html_extraction.extract(PAGE, tree) == "Title & more First paragraph with an inline linked word. Erin. Last <one> here 5 < 6."
    assert all(html_extraction.classify(tree, tuple(r[:-1])) == r[-1] for r in html_extraction.labelled_blocks())
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (None, "u", "<p", "x"), (4, "u", "<" * 3000, "x"), (5, "u", "<div " * 3000, "x"), (6, "u", "<b>" * 5000 + "x", "x")]
    got = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]


def test_pages_without_an_article():
    tree = html_extraction.grow(html_extraction.labelled_blocks())
    body = " ".join(["word"] * 40)
    page = f"<nav><a href=a>One</a> <a href=b>Two</a></nav><div>{body}</div><div>{body} more</div><footer>Imprint of the site</footer>"
    assert html_extraction.extract(page, tree) == f"{body} {body} more"
