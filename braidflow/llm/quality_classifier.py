"""Quality classifier: how much better a dictionary of good text compresses a document than one of bad text.

Two raw zstandard dictionaries are cut from labelled good and bad documents, one piece of each from a place
that its id's hash names, anywhere in the whole text. A text is compressed whole, block by block, so that none of it
becomes its own dictionary: once with each dictionary. The difference of the two compressed sizes, divided by
the text's length, is the only input of the score: a logistic curve, fitted on the whole texts of other labelled
documents than those in the dictionaries and weighted so that it is calibrated to the share of good labels among
all that may be learned from.

The model is fitted on a bounded sample of labelled rows: SAMPLE_PER_CLASS of each class, those with the
smallest hashes of their ids. The executors read the sample's texts; the driver gets PIECE_BYTES of each document
of one half and a number of each of the other.

Defined cases: a null text counts as empty, and its difference is zero; a document
without doc_id is not held out and not learned from; of several texts of a doc_id the largest is learned from; of
several labels of a document the largest counts; without labels of both classes there is no curve: every score is
the share of good ones, 0.5 without any, and keep_good, which has no ground to reject a document, keeps all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm.common import byte_texts, slices, table

SAMPLE_PER_CLASS = 2000
DICTIONARY_BYTES = 262_144
PIECE_BYTES = 400
BLOCK_BYTES = 64
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # intercept, difference
    prior: float = 0.5


def difference(good: bytes, bad: bytes) -> Callable[[bytes], float]:
    """A function from a text's bytes to its compressed size with the bad dictionary less that with the good one, by its length."""
    import zstandard

    def compressor(content: bytes):
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    by_good, by_bad = compressor(good), compressor(bad)

    def measure(text: bytes) -> float:
        blocks = [text[at : at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)]
        return (sum(map(len, map(by_bad, blocks))) - sum(map(len, map(by_good, blocks)))) / max(1, len(text))

    return measure


def scorer(model: QualityModel) -> Callable[[bytes], float]:
    if not model.weights:
        return lambda text: model.prior
    measure, (w0, w1) = difference(model.good, model.bad), model.weights

    def score(text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, w0 + w1 * measure(text)))))

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a little shrinkage, on standardised columns; weights for the raw columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    raw = w[1:] / scale
    return (float(w[0] - raw @ mean), *map(float, raw))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    known = labels.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(quality AS INT) AS quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return QualityModel(b"", b"", (), prior)
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)))  # at most 2 * per_class short rows
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    sample = rows.groupBy("doc_id", "quality", "half").agg(F.max("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            places = zip(byte_texts(batch.column("text")), batch.column("doc_id").to_pylist(), strict=True)
            pieces = [x[(at := did * 2654435761 % 2**32 % max(1, len(x) - PIECE_BYTES + 1)) : at + PIECE_BYTES] for x, did in places]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(pieces, pa.binary())], names=["doc_id", "quality", "piece"])

    pieces = sample.where("half = 0").mapInArrow(cut, "doc_id long, quality int, piece binary").collect()
    pieces.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"]))
    bad, good = (b"".join(r["piece"] for r in pieces if r["quality"] == q)[:DICTIONARY_BYTES] for q in (0, 1))
    if not good or not bad:
        return QualityModel(b"", b"", (), prior)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = difference(good, bad)
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([measure(x) for x in byte_texts(batch.column("text"))], pa.float64())], names=["doc_id", "quality", "x"])

    found = sorted(sample.where("half = 1").mapInArrow(measured, "doc_id long, quality int, x double").collect())
    x, y = np.array([[r["x"]] for r in found]), np.array([float(r["quality"]) for r in found])
    if len(set(y.tolist())) < 2:
        return QualityModel(b"", b"", (), prior)
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    return QualityModel(good, bad, _logistic(x, y, weight), prior)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in slices(batches):
            scores = [score(x) for x in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; all of them where the model has no curve."""
    if not model.weights:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in slices(batches):
            yield batch.filter(pc.greater_equal(pa.array([score(x) for x in byte_texts(batch.column(at))], pa.float64()), threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
