"""Mixing sources to target weights by soft membership.

1. A labelled table (doc_id, domain) and the texts of its documents give a word model of each domain:
   hashed words, smoothed counts. It is fitted on the whole texts of a bounded sample, the SAMPLE_DOCS labelled
   documents with the smallest hashes of their ids; the executors count, the driver gets BUCKETS counts a domain.
2. Every document is read whole, BLOCK words at a time; each block has a posterior over domains, and the
   document's is their mean by words. So a text of two domains belongs to both.
3. Nonnegative rates r minimise, by projected gradient, the squared relative misses of the expected
   domain totals S_d = sum of tokens * posterior_d * rate against the targets, plus RIDGE times the
   token-weighted squared distance of the rates from one. Gradients are taken per token, so a document's
   rate depends on its posterior and on the misses of the rounds before alone: each round is one
   aggregation of as many sums as there are domains, and the driver keeps only those.
4. A rate becomes that many copies: its whole part, and one more where a hash of the row falls below
   its fraction.

Tokens are words [^\\x20\\x09-\\x0D]+. The target total is that of the input.

Defined cases: a null or empty text has no tokens, the prior as posterior, and a rate like any other;
labels without domain or document are left out; a domain without labelled text can't be met and its
target goes to the others; without any labels all rates are one; repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm.common import Scratch, byte_texts, fresh, slices, table, word_hashes

SAMPLE_DOCS = 4000
BUCKETS = 1 << 16
BLOCK = 32
SMOOTHING = 0.1
RIDGE = 1e-3
ROUNDS = 60
CLOSE = 1e-5
#: Shares of tokens by language, the domains of the registered query.
TARGETS = {"en": 0.40, "de": 0.25, "fr": 0.20, "es": 0.15}


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    prior: np.ndarray
    log_words: np.ndarray  # BUCKETS x domains


def _buckets(text: bytes) -> np.ndarray:
    return (word_hashes(text.lower()) % np.uint64(BUCKETS)).astype(np.int64)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DomainModel | None:
    """labelled: doc_id, domain. Of several labels of a document the least counts."""
    known = labelled.selectExpr("CAST(doc_id AS LONG) AS doc_id", "domain").where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").join(F.broadcast(known), "doc_id")  # SAMPLE_DOCS short rows; of several texts of a doc_id the largest
    sample = rows.groupBy("doc_id", "domain").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(domains), BUCKETS + 1), np.int64)  # the last is the number of documents
        for batch in slices(batches, 64):
            for domain, text in zip(batch.column("domain").to_pylist(), byte_texts(batch.column("text")), strict=True):
                k = domains.index(domain)
                counts[k, :BUCKETS] += np.bincount(_buckets(text), minlength=BUCKETS)
                counts[k, BUCKETS] += 1
        k, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(counts[k, bucket])], names=["k", "bucket", "n"])

    counts = np.zeros((len(domains), BUCKETS + 1))
    for r in sample.select("domain", "text").mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["k"], r["bucket"]] = r["n"]  # BUCKETS + 1 numbers a domain
    number = counts[:, BUCKETS]
    found = np.flatnonzero(number)
    if not len(found):
        return None
    words = counts[found, :BUCKETS].T + SMOOTHING
    return DomainModel(tuple(domains[k] for k in found), number[found] / number.sum(), np.log(words / words.sum(0)))


def posterior(model: DomainModel, text: bytes) -> tuple[int, np.ndarray]:
    """A text's number of words, and its mean posterior over blocks of words."""
    words = _buckets(text)
    if not len(words):
        return 0, model.prior
    starts = np.arange(0, len(words), BLOCK)
    score = np.add.reduceat(model.log_words[words], starts) + np.log(model.prior)
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return len(words), (p * np.diff(np.append(starts, len(words)))[:, None]).sum(0) / len(words)


def rates(p: np.ndarray, steps: list[np.ndarray], ridge: float) -> np.ndarray:
    """Replays the rounds' projected gradient steps for documents with posteriors p."""
    r = np.ones(len(p))
    for miss in steps:
        r = np.maximum(0.0, r - (p @ miss + ridge * (r - 1)) / (1 + ridge))
    return r


def _members(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [posterior(model, x) for x in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array([n for n, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.float64()))], names=["doc_id", "rk", "n_tokens", "posteriors"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_rates(members: DataFrame, targets: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The misses of each round, from which rates() gives any document its rate."""
    width = len(targets)

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                p = _matrix(batch.column("posteriors"), width)
                total += (batch.column("n_tokens").to_numpy() * rates(p, steps, ridge)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{k}" for k in range(width)])

        partial = members.select("n_tokens", "posteriors").mapInArrow(run, ", ".join(f"s{k} double" for k in range(width)))
        return np.array([x or 0.0 for x in partial.agg(*(F.sum(f"s{k}") for k in range(width))).first()])

    at_first = sums([])
    total = at_first.sum()
    if not total:
        return []
    share = np.maximum(at_first / total, 1e-3)
    reached, steps, before = at_first, [], np.full(width, np.inf)
    for _ in range(rounds):
        miss = (reached - targets * total) / total
        if np.abs(miss - before).max() < CLOSE:  # the ridge leaves a small miss, so it settles short of zero
            break
        before = miss
        steps.append(miss / share)
        reached = sums(steps)
    return steps


def whole(r: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rates as whole numbers of copies: one more than the whole part where a hash falls below the fraction."""
    return np.floor(r).astype(np.int64) + (u % 1_000_003 / 1_000_003 < r - np.floor(r))


def _weights(model: DomainModel, targets: dict[str, float]) -> np.ndarray:
    wanted = np.array([targets[d] for d in model.domains])
    return wanted / wanted.sum()


def repeat(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Every document as often as its copies say, with all its columns; the texts aren't shuffled."""
    spark = docs.sparkSession
    model = fit_domains(docs, labelled, sorted(targets))
    if model is None:
        return docs
    scratch = Scratch(spark, "mixing")
    shared = spark.sparkContext.broadcast(model)
    rk = F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rk.alias("rk"), "text")
    members = scratch.write(rows.mapInArrow(_members(shared), "doc_id long, rk long, n_tokens long, posteriors array<double>"), "members")
    steps = fit_rates(members, _weights(model, targets))
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = np.array([posterior(shared.value, x)[1] for x in byte_texts(batch.column(at))]).reshape(-1, len(shared.value.domains))
            copies = whole(rates(p, steps, RIDGE), batch.column(width).to_numpy())
            yield batch.select(range(width)).take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    schema = docs.schema
    return docs.withColumn(fresh(docs.columns, "u")[0], F.xxhash64(rk, F.lit(11))).mapInArrow(run, schema)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per document: doc_id, rk, n_tokens, domain (the likeliest), posteriors (by sorted domain), rate, copies."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"), "text")
    model = fit_domains(docs, labelled, sorted(targets))
    if model is None:
        return rows.select("doc_id", "rk", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posteriors"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    shared = spark.sparkContext.broadcast(model)
    members = scratch.write(rows.mapInArrow(_members(shared), "doc_id long, rk long, n_tokens long, posteriors array<double>"), "members")
    steps = fit_rates(members, _weights(model, targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column("posteriors"), len(model.domains))
            r = rates(p, steps, RIDGE)
            copies = whole(r, batch.column("u").to_numpy())
            domain = pa.array([model.domains[k] for k in p.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), batch.column("n_tokens"), domain, batch.column("posteriors"), pa.array(r), pa.array(copies)], names=["doc_id", "rk", "n_tokens", "domain", "posteriors", "rate", "copies"])

    model = DomainModel(model.domains, model.prior, np.empty(0))  # its names suffice from here on
    return members.withColumn("u", F.xxhash64("rk", F.lit(11))).mapInArrow(run, "doc_id long, rk long, n_tokens long, domain string, posteriors array<double>, rate double, copies long")


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: the labelled documents, with their language as domain."""
    ids = labels.selectExpr("CAST(doc_id AS LONG) AS doc_id").distinct()
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "lang AS domain").join(ids, "doc_id", "left_semi")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, language_labels(docs, table(spark, sf_dir, "labels")), TARGETS).drop("rk")
