"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from braidflow.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from braidflow.llm.common import word_hashes
from tests.llm.conftest import SCHEMA, document, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root(k)].append(r["doc_id"])
    found = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(r["doc_id"], len(s), found[root(k)], r["doc_id"] == found[root(k)]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_words_are_those_of_bytes():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\x0b", "\x0c", "\xa0", "é", " ", "\x1c"]) for _ in range(rng.randint(0, 30))).encode()
        words = text.split()
        got = word_hashes(text)
        assert len(got) == len(words) and len(set(got.tolist())) == len(set(words))


def test_long_texts_are_cut_at_white_space(monkeypatch):
    from braidflow.llm import common

    text = b" ".join(b"w%d" % k for k in range(3000)) + b" " + b"y" * 700 + b" z"
    whole = word_hashes(text)
    monkeypatch.setattr(common, "SEGMENT", 64)
    assert np.array_equal(whole, word_hashes(text))


def test_exact(odd, none):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    want = []
    for r in rows:
        body = (r["text"] or "").translate(LOWER)
        keep = max((x for x in groups[body] if x is not None), default=None)
        want.append((r["doc_id"], keep, len(groups[body]), r["doc_id"] == keep, hashlib.sha256(body.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd, capacity=2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_directory_doubles(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(400)] + [5] * 1
    made = exact_dedup.build_directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity=8)
    buckets = made.bucket(np.array(keys, np.int64).view(np.uint64))
    assert np.bincount(buckets).max() <= 8 and len(made.prefixes) > 50
    assert sum(2.0**-d for d, _ in made.prefixes) == 1.0


def test_near(odd, none):
    want = components(odd.collect())
    got = [tuple(r) for r in near_dedup.near_dedup(odd).drop("rk").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert near_dedup.near_dedup(none).count() == 0


def test_near_groups_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(5)
    rows = []
    for k in range(60):  # drifting copies: neighbours are alike, ends aren't
        words = prose(900 + k // 30, 150).split()
        for _ in range(k % 30 // 2):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        rows.append(document(k, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in near_dedup.near_dedup(docs).drop("rk").collect()]
    assert sorted(got) == sorted(components(docs.collect()))


def test_keep_one_keeps_columns(odd):
    out = near_dedup.keep_one(odd)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 1 in kept and not {100, 101, 102, 103, 104} & set(kept) and {200, 201, 202, 300} <= set(kept)


def test_odd_sketches_estimate():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.85, 0.95):
        x = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
        n = int(len(x) * share)
        a, b = x[: (len(x) + n) // 2], x[(len(x) - n) // 2 :]
        sketches = [near_dedup.odd_sketch(near_dedup.minhash(s)) for s in (a, b)]
        got = near_dedup.estimate(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert abs(got - share) < near_dedup.MARGIN
    assert near_dedup.linked(np.arange(17, dtype=np.uint64), np.arange(20, dtype=np.uint64))
    assert not near_dedup.linked(np.arange(16, dtype=np.uint64), np.arange(20, dtype=np.uint64))


def lines_left(rows, least, chars):
    """Plain line dedup: marks by windows of least lines."""
    docs = sorted({(r["doc_id"], r["text"] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    bare = {d: [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(d[1].split("\n"))] for d in docs}
    filled = {d: [(k, x) for k, x in v if x] for d, v in bare.items()}
    seen, gone = {}, defaultdict(set)
    for d in docs:
        for p in range(len(filled[d]) - least + 1):
            w = tuple(x for _, x in filled[d][p : p + least])
            if sum(map(len, w)) >= chars and seen.setdefault(w, (d, p)) != (d, p):
                gone[d].update(k for k, _ in filled[d][p : p + least])
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) for d in docs}


def test_lines(spark, none):
    rng = random.Random(8)
    rows = [document(k, "\n".join(rng.choice(["aa bb cc dd ee", "ff gg hh ii jj", "kk ll mm nn oo", "", " ", "pp qq rr ss tt "]) for _ in range(rng.randint(0, 9)))) for k in range(30)]
    rows += [rows[3], document(None, rows[4][1]), document(77, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for least in (1, 2, 3, 5):
        want = lines_left(docs.collect(), least, 20)
        out = line_dedup.line_dedup(docs, least, 20)
        assert out.columns == [*docs.columns, "n_lines", "n_removed_lines"]
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert got == sorted(((r[0], want[r[0], r[1] or ""]) for r in rows), key=repr)
    assert line_dedup.line_dedup(none).count() == 0


def test_lines_of_odd_documents(odd):
    out = line_dedup.keep_rest(odd)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert not {100, 101, 102, 103, 104} & set(kept)  # copies that held nothing else
    assert {1, 200, 201, 202, 203, 300} <= set(kept)


def test_chunks_fall_into_step_again():
    text = prose(4, 2000).encode()

    def cut(t):
        ends = substring_dedup.chunk_ends(t)
        return [t[p:q] for p, q in zip([0, *ends[:-1]], ends, strict=True)]

    a, b = cut(text), cut(text[:3000] + b"inserted" + text[3000:])
    assert len({*a} & {*b}) >= len({*a}) - 4
    assert max(map(len, a)) <= substring_dedup.MAX_CHUNK and b"".join(a) == text


def test_substrings(spark, odd, none):
    passage = " ".join(f"passage{k * 37 % 101}" for k in range(70))
    short = " ".join(f"short{k}" for k in range(20))
    rows = [document(k, f"{prose(1000 + k, 60)} {short} {prose(2000 + k, 30)}\n{passage} {prose(3000 + k, 40)}é") for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    text = {r[0]: r[1] for r in rows}
    assert got[0]["text"] == text[0] and got[0]["n_spans"] == 0
    for k in range(1, 12):
        assert passage not in got[k]["text"] and short in got[k]["text"]
        assert got[k]["text"].replace(" ", "").replace("\n", "") == text[k].replace(passage, "").replace(" ", "").replace("\n", "")
        assert 0 in got[k]["source_ids"] and max(got[k]["source_ids"]) < k
    out = substring_dedup.substring_dedup(odd)
    assert out.count() == odd.count()
    by = {(r["doc_id"], r["n_spans"]) for r in out.collect()}
    assert (1, 0) in by or (None, 0) in by
    assert substring_dedup.substring_dedup(none).count() == 0
