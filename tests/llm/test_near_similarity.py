"""The similarity as a parameter of near dedup: links between 80 and 85 %."""

import numpy as np

import corpus_pipeline
from braidflow.llm import near_dedup
from tests.llm.conftest import SCHEMA, document
from tests.llm.test_dedup import shingles


def test_bands_follow_the_similarity():
    assert near_dedup.bands_for(85) == near_dedup.BANDS
    for percent in (70, 80, 85):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= 2.5e-7
    assert not near_dedup.linked(np.arange(33, dtype=np.uint64), np.arange(40, dtype=np.uint64))
    assert near_dedup.linked(np.arange(33, dtype=np.uint64), np.arange(40, dtype=np.uint64), 80)


def test_links_between_80_and_85(spark):
    rows = []
    for k in range(20):
        words = [f"d{k}w{n}" for n in range(104)]
        other = list(words)
        other[30] = other[60] = "x"  # 90 of 110 shingles
        rows += [document(2 * k, " ".join(words)), document(2 * k + 1, " ".join(other))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    even = list(range(0, 40, 2))
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(docs, 80).where("kept").collect()) == even
    assert near_dedup.near_dedup(docs).where("kept").count() == 40
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == even
