"""Token ids against the library on all short strings of awkward pieces; the index against plain BM25."""

import itertools
import math
import random
from collections import Counter

import numpy as np

from braidflow.llm import packing

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    spec = open(packing.default_tokenizer()).read()
    own, library = packing.BpeIds(spec), Tokenizer.from_str(spec)
    pieces = [*SPACES, "᠎", "​", "a", "Ab", "9", "é", "é", "日本", "'s", "'", "don't", "!", "...", "’", "🙂", " a"]
    texts = ["".join(x) for k in (1, 2) for x in itertools.product(pieces, repeat=k)]
    few = [" ", "\n", "\xa0", "\t", "　", "\x1c", "\r", "a", "b!", "'s", "9"]
    texts += ["".join(x) for k in (3, 4) for x in itertools.product(few, repeat=k)]
    texts += ["".join(x) for x in itertools.product(SPACES, few, SPACES)]
    texts += ["a\n\xa0\xa0b", "\n\xa0 \xa0 b", "<|endoftext|> a", "x" * 300]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(text).tolist() == [*want.ids, packing.END_ID], repr(text)


def test_neighbours_rank_as_plain_bm25():
    rng = random.Random(2)
    items = [np.array([rng.randrange(40) for _ in range(rng.choice((3, 20, 60)))], "<u2") for _ in range(50)]
    df = Counter(t for x in items for t in set(x.tolist()))
    idf = np.array([math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) for t in range(40)])
    mean = sum(map(len, items)) / len(items)
    index = packing.Index(items, idf, mean)
    for k in range(0, 50, 7):
        plain = []
        for x in items:
            tf = Counter(x.tolist())
            norm = packing.K1 * (1 - packing.B + packing.B * len(x) / mean)
            plain.append(sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(items[k].tolist()) if t in tf))
        ranked = [plain[j] for j in index.neighbours(k)]
        assert all(a >= b - 1e-9 for a, b in itertools.pairwise(ranked)) and sorted(index.neighbours(k)) == list(range(50))


def test_forgetting_used_items_changes_no_rank():
    rng = random.Random(3)
    items = [np.array([rng.randrange(60) for _ in range(rng.choice((1, 3, 20, 60)))], "<u2") for _ in range(80)]
    idf = np.linspace(0.1, 3, 60)
    index, whole = packing.Index(items, idf, 20.0), packing.Index(items, idf, 20.0)
    used = np.zeros(80, bool)
    for share in (0, 0.3, 0.7, 1):
        used |= np.array([rng.random() < share for _ in items])
        index.forget(used)
        assert len(index.owner) == sum(len(np.unique(x)) for x, gone in zip(items, used, strict=True) if not gone)
        for k in range(0, 80, 9):
            assert index.neighbours(k, np.flatnonzero(~used)).tolist() == [j for j in whole.neighbours(k) if not used[j]]


def test_fill_forgets_and_takes_every_item_once():
    rng = random.Random(4)
    items = [np.array([rng.randrange(500) for _ in range(rng.randint(1, 600))], "<u2") for _ in range(200)]
    index = packing.Index(items, np.ones(500), 300.0)
    before = len(index.owner)
    windows = list(packing.fill([len(x) for x in items], index, packing.WINDOW))
    assert len(index.owner) < before / 2
    assert all(sum(n for *_, n in w) == packing.WINDOW for w in windows[:-1])
    for k, x in enumerate(items):
        pieces = sorted((at, n) for w in windows for j, at, n in w if j == k)
        assert sum(n for _, n in pieces) == len(x) and [at for at, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]


def test_every_other_space_is_known():
    assert sorted(packing.OTHER_SPACE) == sorted(x for x in SPACES if x not in " \n")
