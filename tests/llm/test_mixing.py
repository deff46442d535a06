"""Rates against a plain solution of the same least squares by coordinate descent."""

import random

import numpy as np

from braidflow.llm import mixing
from tests.llm.conftest import SCHEMA, document

VOCABULARY = {"de": "der die das und nicht ist mit für", "en": "the of and to in that is was", "es": "el los que una para con por del", "fr": "le les des une dans pour qui est"}


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(90):
        own = [list(VOCABULARY)[k % 4], *rng.choices(list(VOCABULARY), k=k % 3 // 2)]
        rows.append(document(k, " ".join(rng.choice(VOCABULARY[rng.choice(own)].split()) for _ in range(rng.choice((5, 40, 200)))), own[0]))
    return [*rows, document(100, None), document(101, "")]


def solved(p, n, wanted, sweeps=4000):
    """min over r >= 0 of sum_d (S_d - T_d)^2 / (total share_d) + ridge sum_i n_i (r_i - 1)^2, one rate at a time."""
    start, total = n @ p, n.sum()
    share, target, r = np.maximum(start / total, 1e-3), wanted * total, np.ones(len(n))
    reached = start.copy()
    for _ in range(sweeps):
        for i in np.flatnonzero(n):
            slope = p[i] @ ((reached - target) / (total * share)) + mixing.RIDGE * (r[i] - 1)
            bend = n[i] * (p[i] ** 2 / (total * share)).sum() + mixing.RIDGE
            new = max(0.0, r[i] - slope / bend)
            reached += n[i] * p[i] * (new - r[i])
            r[i] = new
    return r, reached


def test_rates_equal_least_squares(spark):
    docs = spark.createDataFrame(texts(3), SCHEMA).repartition(3)
    labelled = docs.where("doc_id % 3 < 2").selectExpr("doc_id", "lang AS domain")
    rows = mixing.mix(docs, labelled, mixing.TARGETS).orderBy("doc_id").collect()
    p, n = np.array([r["posteriors"] for r in rows]), np.array([float(r["n_tokens"]) for r in rows])
    names = sorted(mixing.TARGETS)
    wanted = np.array([mixing.TARGETS[d] for d in names])
    want, reached = solved(p, n, wanted)
    got = np.array([r["rate"] for r in rows])
    assert np.abs((n * got) @ p - reached).max() < 2e-3 * n.sum()
    assert np.abs((n * got) @ p / n.sum() - wanted).max() < 5e-3
    assert np.abs(got - want)[n > 0].max() < 0.02


def test_model_counts_whole_texts(spark):
    """A document whose language changes after many thousand words counts with all of it."""
    long = " ".join(["the of and to"] * 8000 + ["der die das und"] * 8000)
    docs = spark.createDataFrame([document(0, long, "en"), document(1, VOCABULARY["de"] * 3, "de"), document(2, "der die das", "de")], SCHEMA)
    model = mixing.fit_domains(docs, docs.selectExpr("doc_id", "lang AS domain"), ["de", "en"])
    der = mixing._buckets(b"der")[0]
    assert np.exp(model.log_words[der, 1]) > 0.1 and model.prior.tolist() == [2 / 3, 1 / 3]
