"""The n-gram model against a plain one: dictionaries, one document at a time, no hashing and no shards."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from braidflow.llm import ngram_quality
from braidflow.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string"


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(180):
        lang = ("en", "de", None)[k % 3]
        n = rng.choice((1, 3, 25, 60, 90))
        rows.append((k, " ".join(rng.choice(words[: 20 + k % 40]) for _ in range(n)), lang))
    rows += [(200, None, "en"), (201, "", None), (202, "only here " * 15, "xx"), (203, rows[7][1], rows[7][2]), (204, "The the THE " * 9, "en"), (7, rows[7][1], rows[7][2]), (None, rows[8][1], "de")]
    rows += [(300, " ".join(f"odd{j}" for j in range(90)), "en")]
    return rows


def plain_bits(rows):
    """Of each row its mean bits, by the formulas of the module's docstring."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(lang or "", (text or "").translate(lower).split()) for _, text, lang in rows]
    pairs = Counter((lang, v, w) for lang, ws in texts for v, w in zip(["<s>", *ws], ws, strict=False))
    before = Counter((lang, w) for lang, v, w in pairs)

    def discount(counts):
        n = Counter(min(c, 5) for c in counts)
        return ngram_quality.discounts([n[1], n[2], n[3], n[4]])

    d2 = {lang: discount([c for (x, _, _), c in pairs.items() if x == lang]) for lang in {x for x, _ in texts}}
    d1 = {lang: discount([c for (x, _), c in before.items() if x == lang]) for lang in d2}
    ones = defaultdict(list)
    for (lang, _), c in before.items():
        ones[lang].append(c)
    follow = defaultdict(dict)
    for (lang, v, w), c in pairs.items():
        follow[lang, v][w] = c
    out = []
    for lang, ws in texts:
        own = Counter(zip(["<s>", *ws], ws, strict=False))
        bits = 0.0
        for (v, w), m in own.items():
            left = {x: c - own[v, x] for x, c in follow[lang, v].items()}
            total, d = sum(left.values()), d2[lang]
            c1 = before[lang, w]
            p = (c1 - d1[lang][min(c1, 3)]) / sum(ones[lang]) + sum(d1[lang][min(c, 3)] for c in ones[lang]) / sum(ones[lang]) / len(ones[lang])
            if total:
                p = (max(left[w] - d[min(left[w], 3)], 0) + sum(d[min(c, 3)] for c in left.values()) * p) / total
            bits -= m * math.log2(p)
        out.append(bits / len(ws) if ws else None)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def scored(spark, rows):
    return ngram_quality.ngram_quality(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()


def test_perplexity_equals_plain_model(rows, scored):
    want = sorted((str(d), x) for (d, _, _), x in zip(rows, plain_bits(rows), strict=True) if x is not None)
    got = sorted((str(r["doc_id"]), r["log2_ppl"]) for r in scored if r["log2_ppl"] is not None)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want, strict=True))
    assert all(r["log2_ppl"] is None and r["base_failed"] and not r["kept"] for r in scored if r["doc_id"] in (200, 201))


def test_bands_equal_plain_bands(rows, scored):
    """kept follows from the plain model's perplexities and percentiles."""
    bits = plain_bits(rows)
    failed = {str(r["doc_id"]): r["base_failed"] for r in scored}
    by = defaultdict(list)
    for (d, _, lang), x in zip(rows, bits, strict=True):
        if x is not None and not failed[str(d)]:
            by[lang or ""].append(math.floor(x * ngram_quality.BINS + 0.5))
    at = lambda own, share: sorted(own)[math.ceil(share * len(own)) - 1] / ngram_quality.BINS
    want = {}
    for (d, text, lang), x in zip(rows, bits, strict=True):
        if failed[str(d)]:
            want[str(d)] = False
            continue
        own, wider = by[lang or ""], math.sqrt(1 + ngram_quality.SHORT / len(text.split()))
        mid = at(own, 0.5)
        want[str(d)] = mid - ngram_quality.LOWER * wider * (mid - at(own, 0.05)) <= x <= mid + ngram_quality.UPPER * wider * (at(own, 0.95) - mid)
    assert {str(r["doc_id"]): r["kept"] for r in scored} == want
    assert any(not failed[d] and not kept for d, kept in want.items()) and any(want.values())


@pytest.mark.parametrize("bounds", [{"chunk_words": 50, "rounds": 1, "shards": 7}, {"chunk_words": 1000, "rounds": 4, "shards": 1}])
def test_bounds_change_nothing(spark, rows, scored, bounds, monkeypatch):
    monkeypatch.setattr(ngram_quality, "MERGE_PAIRS", 100)
    again = ngram_quality.ngram_quality(spark.createDataFrame(rows, SCHEMA).repartition(3), **bounds).collect()
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["kept"], r["log2_ppl"])
    assert sorted(map(key, again), key=str) == sorted(map(key, scored), key=str)


def test_one_context_in_a_third_of_all_pairs(spark):
    """A hot context's shard is copied to several tasks, and the result is that of one shard."""
    rows = [(k, " ".join(f"the x{(k * 7 + j) % 50}" for j in range(20)), "en") for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).select(F.xxhash64("doc_id").alias("rk"), "lang", "text")
    key = lambda df: sorted(map(tuple, df.collect()))
    found = [key(ngram_quality.perplexities(docs, Scratch(spark, "hot"), 100, 2, n)) for n in (1, 9)]
    assert found[0] == found[1] and len(found[0]) == 60


def test_empty_table(spark):
    assert ngram_quality.ngram_quality(spark.createDataFrame([], SCHEMA)).count() == 0
