"""The pipeline's stages on odd documents, each against its own operator."""

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from braidflow.llm import line_dedup, mixing, near_dedup, packing, quality_classifier


@pytest.fixture(scope="module")
def folder(odd, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = quality_classifier.score_quality(docs, model).where("predicted = 1").count()
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality classifier"](spark, docs, folder)
    assert first.count() == good and first.columns == docs.columns
    second = stages["line dedup"](spark, docs, folder)
    assert key(second) == key(line_dedup.line_dedup(docs).where("n_lines = 0 OR n_removed_lines < n_lines"))
    third = stages["near dedup"](spark, docs, folder)
    kept = near_dedup.near_dedup(docs, corpus_pipeline.NEAR_PERCENT).where("kept").collect()
    assert third.count() == len({r["root"] for r in kept if r["root"] is not None}) + sum(r["root"] is None for r in kept)
    assert third.columns == docs.columns and third.where("doc_id = 12").count() == 1
    fourth = stages["mixing"](spark, docs, folder)
    rates = mixing.mix(docs, mixing.language_labels(docs, spark.read.parquet(f"{folder}/labels.parquet")), mixing.TARGETS)
    want = Counter()
    for r in rates.collect():
        want[r["doc_id"]] += r["copies"]
    assert fourth.columns == docs.columns and Counter(r["doc_id"] for r in fourth.collect()) == +want
    last = stages["packing"](spark, docs, folder).collect()
    whole = {}
    for r in last:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    assert sum(map(sum, whole.values())) == sum(r["length"] for r in packing.pack(docs).collect()) and len({k for k, _ in whole}) == docs.select("doc_id").distinct().count()


def test_without_labels_and_on_empty_tables(spark, folder, odd, none, labels, tmp_path):
    for name, docs, known in (("unlabelled", odd, labels.limit(0)), ("empty", none, labels)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        known.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/unlabelled/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality classifier"](spark, docs, f"{tmp_path}/unlabelled").count() == docs.count()
    assert stages["mixing"](spark, docs, f"{tmp_path}/unlabelled").count() == docs.count()
    assert corpus_pipeline.run(spark, f"{tmp_path}/unlabelled").count() > 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert "sequence_id" in out.columns and out.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
