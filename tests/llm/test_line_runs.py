"""Whole runs of lines: min_chars holds for a run's total."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidflow.llm import line_dedup
from braidflow.llm.common import Scratch
from tests.llm.conftest import SCHEMA, document


def lines_left(rows, least, chars):
    """Every window of least lines and more that has chars characters, by brute force."""
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, gone = {}, defaultdict(set)
    for d in docs:
        filled = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(d[1].split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for p in range(len(filled)):
            for q in range(p + least, len(filled) + 1):
                w = tuple(x for _, x in filled[p:q])
                if sum(map(len, w)) >= chars and seen.setdefault(w, (d, p)) != (d, p):
                    gone[d].update(k for k, _ in filled[p:q])
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) for d in docs}


def test_a_long_run_of_short_lines(spark):
    run = "\n".join(f"ln{k:04d}" for k in range(90))
    docs = spark.createDataFrame([document(1, run), document(2, f"own one\n{run}\nown two")], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in line_dedup.keep_rest(docs).collect()}
    assert got == {1: run, 2: "own one\nown two"}


def test_whole_runs_against_brute_force(spark):
    rng = random.Random(11)
    line = lambda: rng.choice(["a", "bb", "ccc", "dddd ee", "ffffff gggg", "", " ", "hh "])
    rows = [document(k, "\n".join(line() for _ in range(rng.randint(0, 25)))) for k in range(40)]
    rows += [rows[3], document(None, rows[4][1]), document(77, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, chars in ((1, 12), (2, 20), (4, 9)):
        want = lines_left(rows, least, chars)
        got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs, least, chars, whole=True).collect()), key=repr)
        assert got == sorted(((r[0], want[r[0], r[1] or ""]) for r in rows), key=repr)


def longest_runs(rows):
    """For each line with text, the most lines from it that stand earlier too, by brute force."""
    docs = {r[0]: [x.strip(" \t\r\x0b\x0c") for x in (r[1] or "").split("\n") if x.strip(" \t\r\x0b\x0c")] for r in rows}
    places = sorted((d, p) for d, v in docs.items() for p in range(len(v)))
    out = {}
    for at, (d, p) in enumerate(places):
        for e, q in places[:at]:
            n = 0
            while p + n < len(docs[d]) and q + n < len(docs[e]) and docs[d][p + n] == docs[e][q + n]:
                n += 1
            if n > out.get((d, p), (0, 0))[0]:
                out[d, p] = (n, sum(map(len, docs[d][p : p + n])))
    return out


def runs_of(spark, rows, least):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = line_dedup.repeated_runs(docs, Scratch(spark, "runs"), least).collect()
    assert len(found) == len({(r["doc_id"], r["pos"]) for r in found})
    return {(r["doc_id"], r["pos"]): (r["n"], r["chars"]) for r in found}


@pytest.fixture
def rounds(monkeypatch):
    done, plain = [], line_dedup._doubled
    monkeypatch.setattr(line_dedup, "_doubled", lambda suffixes, scratch, depth: done.append(depth) or plain(suffixes, scratch, depth))
    return done


def test_runs_come_out_whole(spark, rounds):
    run = [f"line number {k}" for k in range(90)]
    versions = [document(10 + k, "\n".join(run[: 30 + k])) for k in range(3)]  # each holds the one before and goes on
    rows = [document(1, "\n".join(run)), document(2, "\n".join(["own", *run[:57], "end"])), *versions, document(20, "\n".join(["same"] * 9))]
    for least in (1, 2, 4):
        assert runs_of(spark, rows, least) == {k: v for k, v in longest_runs(rows).items() if v[0] >= least}
    assert rounds[:6] == [1, 2, 4, 8, 16, 32] and runs_of(spark, rows, 2)[2, 1][0] == 57


def test_runs_against_brute_force(spark):
    rng = random.Random(12)
    line = lambda: rng.choice(["a", "bb", "ccc", "dddd ee", "", "hh "])
    rows = [document(k, "\n".join(line() for _ in range(rng.randint(0, 30)))) for k in range(25)]
    rows += [document(100 + k, rows[k][1]) for k in range(0, 10, 2)] + [document(77, None)]
    for least in (1, 3):
        assert runs_of(spark, rows, least) == {k: v for k, v in longest_runs(rows).items() if v[0] >= least}


def test_the_query_doubles_until_no_rank_repeats(spark, rounds):
    from braidflow.llm.queries import QUERIES

    QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.01").count()
    assert len(rounds) > 3 and rounds == [2**k for k in range(len(rounds))]


def test_lines_of_rows_that_share_an_id(spark):
    """As in the SQL, places are of doc_id and line, so rows of one id that share a place keep it both."""
    shared = "a line of some length\nanother one of that length"
    rows = [document(5, shared + "\nx"), document(5, shared + "\ny"), document(6, "z\n" + shared)]
    got = sorted(r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [shared + "\nx", shared + "\ny", "z"]


def test_the_pipelines_stage_doubles_until_no_rank_repeats(spark, rounds):
    import corpus_pipeline

    run = [f"l{k:02d}" for k in range(40)]  # any two of its lines have six characters
    docs = spark.createDataFrame([document(1, "\n".join(run)), document(2, "\n".join(["own", *run, "end"])), document(3, "\n".join(["few", *run[:10], "of them"]))], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "").collect()}
    assert got == {1: "\n".join(run), 2: "own\nend", 3: "\n".join(["few", *run[:10], "of them"])}  # 30 characters stay
    assert rounds == [1, 2, 4, 8, 16, 32]


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_the_array_and_its_neighbours_common_prefixes(spark):
    rng = random.Random(13)
    line = lambda: rng.choice(["a", "bb", "ccc", "dddd ee", "hh"])
    texts = {k: [line() for _ in range(rng.randint(0, 20))] for k in range(12)} | {20: ["same"] * 9, 21: ["own"], 22: [f"l{k}" for k in range(40)], 23: [f"l{k}" for k in range(39)]}
    docs = spark.createDataFrame([(k, k, "\n".join(v)) for k, v in texts.items()], "rk long, doc_id long, text string").repartition(3)
    suffixes = [texts[k][p:] for k in texts for p in range(len(texts[k]))]
    for least in (1, 2, 3):
        array, prefixes = line_dedup.suffix_array(docs, Scratch(spark, "array"), least)
        array = {r["at"]: texts[r["doc_id"]][r["pos"] :] for r in array.collect()}
        assert len(array) <= len(suffixes) and sum(any(shared(x, y) >= least for y in suffixes if y is not x) for x in suffixes) <= len(array)
        places, got = sorted(array), {r["at"]: (r["n"], r["chars"]) for r in prefixes.collect()}
        near = {q: shared(array[p], array[q]) for p, q in zip(places, places[1:])}
        assert got == {q: (n, sum(map(len, array[q][:n]))) for q, n in near.items() if n >= least}
        for i, p in enumerate(places):  # in order: any two share the least of what neighbours between them share
            for j in range(i + 1, len(places)):
                assert shared(array[p], array[places[j]]) == min(near[q] for q in places[i + 1 : j + 1])


def test_runs_over_narrow_ranges_of_the_array(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RANGE", 4)
    monkeypatch.setattr(line_dedup, "WIDER", 2)
    run = [f"line {k}" for k in range(30)]
    order = random.Random(14).sample(range(12), 12)
    rows = [document(k, "\n".join(run[: 12 + k])) for k in range(12)] + [document(20 + k, "\n".join(run[x:])) for k, x in enumerate(order)]
    rows += [document(40 + k, "two\nlines") for k in range(20)] + [document(70, "\n".join(["same"] * 25))]
    assert runs_of(spark, rows, 2) == {k: v for k, v in longest_runs(rows).items() if v[0] >= 2}
