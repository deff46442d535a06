"""Windows of 51 words, counted plainly, before and after."""

import random

from braidflow.llm import substring_dedup
from tests.llm.conftest import SCHEMA, document

WINDOW = substring_dedup.MIN_WORDS + 1


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(rng.choice((51, 52, 60, 90, 200))) for _ in range(25)]
    short = [prose(45) for _ in range(10)]
    texts = []
    for _ in range(70):
        parts = [prose(rng.randint(5, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(1, 60))]
        parts += [rng.choice(short), prose(rng.randint(1, 40))]
        texts.append(" ".join(" ".join(p) for p in parts))
    own = " ".join(prose(60))
    texts += [f"{own} {' '.join(prose(30))} {own}", "again " * 400, texts[3], texts[5].replace(" ", "\n", 40)]
    return texts


def windows(text):
    words = text.split()
    return {tuple(words[k : k + WINDOW]) for k in range(len(words) - WINDOW + 1)}


def test_no_window_stays_in_two_documents(spark):
    texts = corpus()
    docs = spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    before = [windows(t) for t in texts]
    shared = {w for k, x in enumerate(before) for w in x if any(w in y for y in before[:k])}
    assert len(shared) > 500
    after = [windows(got[k]["text"]) for k in range(len(texts))]
    for k in range(len(texts)):
        earlier = set().union(*before[:k])
        touched = bool(before[k] & earlier)
        assert (got[k]["n_spans"] > 0) == touched, k
        if not touched:
            assert got[k]["text"] == texts[k]
    first = {}
    for k, x in enumerate(after):
        for w in x & shared:
            assert first.setdefault(w, k) == k
    words = [set(got[k]["text"].split()) for k in range(len(texts))]
    for k, t in enumerate(texts):
        assert set(t.split()) <= set().union(*words[: k + 1])  # what is deleted stands in an earlier document
    assert got[70]["text"] == texts[70] and got[71]["text"] == texts[71]  # repeats within one document stay


def test_rows_without_id_and_repeated_rows(spark):
    texts = corpus()
    a, b = texts[3], f"{texts[3]} and more of it"
    docs = spark.createDataFrame([document(None, a), document(None, b), document(None, a), document(5, a), document(5, a), document(6, "x y")], SCHEMA).repartition(3)
    got = substring_dedup.substring_dedup(docs).collect()
    of = lambda d, t=None: [r for r in got if r["doc_id"] == d and (t is None or r["text"] == t)]
    assert len(got) == 6 and len(of(5)) == 2 and all(r["n_spans"] > 0 and r["source_ids"] == [] for r in of(5)) and len(of(6, "x y")) == 1
    assert sum(r["n_spans"] == 0 for r in of(None)) in (1, 2)  # the first of both texts stays
