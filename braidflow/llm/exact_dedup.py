"""Exact dedup: an extendible-hash index on files of the shared folder.

A text's fingerprint is the 64-bit hash of its normalised form (A-Z lower-cased). The directory starts with one
bucket and doubles while a bucket that still holds several fingerprints is over a page of BUCKET_BYTES; the
overfull bucket is split by its next bit, to MAX_DEPTH bits at most, which bounds the directory. Records of repeated
fingerprints go, with their texts, to the bucket that the directory names. Each owner task takes a range of
buckets, and so of keys, in key order, chains the different texts that meet under one fingerprint by
comparing their bytes, and writes its part of the index: for each fingerprint its buckets' chain. A document then
finds its group by its fingerprint; where a chain has several texts, by the digest of the one that it equals.

Copies are combined before they are dealt out, so that a text that a third of all rows share reaches
its owner once for each batch read. Fingerprints that occur once need no bucket entry.

Defined cases: a null text counts as empty; a null doc_id loses to any other and is kept only in a
group of nulls; repeated rows each get a row; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm.common import Scratch, lower_ascii, slices, table

BUCKET_BYTES, ENTRY_BYTES = 32_768, 64
BUCKET_ENTRIES = BUCKET_BYTES // ENTRY_BYTES
MAX_DEPTH = 20
FLUSH_BYTES = 8 << 20


class Directory:
    """Sorted lower bounds of the buckets' key ranges; a bucket's local depth is its prefix length."""

    def __init__(self, prefixes: list[tuple[int, int]]):
        self.prefixes = sorted(prefixes, key=lambda p: p[1] << (64 - p[0]) if p[0] else 0)
        self.bounds = np.array([p << (64 - d) if d else 0 for d, p in self.prefixes], np.uint64)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, side="right").astype(np.int32) - 1


def build_directory(keys: DataFrame, capacity: int = BUCKET_ENTRIES, step: int = 6) -> Directory:
    """Doubles the directory until no bucket of several fingerprints is over capacity.

    keys has one row per repeated fingerprint. Each round counts only the buckets that were overfull,
    by the next step bits, so the driver gets a number per bucket, 2^MAX_DEPTH at most, and never a key.
    """
    done: list[tuple[int, int]] = []
    overfull, depth = [(0, 0)], 0
    while overfull and depth < MAX_DEPTH:
        before, depth = depth, min(depth + step, MAX_DEPTH)
        prefix = F.shiftrightunsigned("key", 64 - depth)
        kept = keys
        if overfull != [(0, 0)]:
            parents = keys.sparkSession.createDataFrame([(p,) for _, p in overfull], "parent long")
            kept = keys.withColumn("parent", F.shiftrightunsigned("key", 64 - before)).join(F.broadcast(parents), "parent", "left_semi")
        counts = {r["p"]: r["n"] for r in kept.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
        again = []
        for _, parent in overfull:
            stack = [(before, parent)]
            while stack:
                d, p = stack.pop()
                low, high = p << (depth - d), (p + 1) << (depth - d)
                n = sum(counts.get(x, 0) for x in range(low, high))
                if n <= capacity or d >= MAX_DEPTH:
                    done.append((d, p))
                elif d == depth:
                    again.append((d, p))
                else:
                    stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        overfull = again
    return Directory(done + overfull)


def _combine(directory: Directory):
    """Texts of one fingerprint met in the same batch become one record: bucket, key, text, n, keep_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], list] = {}
        held = 0

        def flush():
            keys = np.fromiter((k for k, _ in found), np.int64, len(found))
            return pa.RecordBatch.from_arrays(
                [pa.array(directory.bucket(keys.view(np.uint64))), pa.array(keys), pa.array([t for _, t in found], pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
                names=["bucket", "key", "body", "n", "keep_id"],
            )

        for batch in slices(batches):
            for key, body, doc_id in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "doc_id")), strict=True):
                if (old := found.get((key, body))) is None:
                    found[key, body] = [1, doc_id]
                    held += len(body) + 200
                else:
                    old[0] += 1
                    if old[1] is None or doc_id is not None and doc_id > old[1]:
                        old[1] = doc_id
            if held > FLUSH_BYTES:
                yield flush()
                found.clear()
                held = 0
        if found:
            yield flush()

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes records in (bucket, key) order; a fingerprint's chain has an entry for each different text."""
    at, chain, out = None, {}, []

    def entries():
        return [(at[0], at[1], k, len(chain), hashlib.sha256(body.encode()).hexdigest(), v[0], v[1]) for k, (body, v) in enumerate(chain.items())]

    def made():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "key", "chain", "chains", "text_sha256", "n", "keep_id"])

    for batch in slices(batches, 256):
        for bucket, key, body, n, doc_id in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "body", "n", "keep_id")), strict=True):
            if at != (bucket, key):
                if at is not None:
                    out += entries()
                at, chain = (bucket, key), {}
                if len(out) >= 8192:
                    yield made()
                    out = []
            if (old := chain.get(body)) is None:
                chain[body] = [n, doc_id]
            else:
                old[0] += n
                if old[1] is None or doc_id is not None and doc_id > old[1]:
                    old[1] = doc_id
    if at is not None:
        out += entries()
    if out:
        yield made()


def build_index(docs: DataFrame, digests: DataFrame, scratch: Scratch, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The index files: bucket, key, place in the chain, its length, text_sha256, n, keep_id for every fingerprint that repeats."""
    repeated = scratch.write(digests.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    directory = build_directory(repeated, capacity)
    body = lower_ascii(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).withColumn("key", F.xxhash64("body"))
    rows = rows.join(repeated.select("key"), "key", "left_semi").select("key", "body", "doc_id")
    records = rows.mapInArrow(_combine(directory), "bucket int, key long, body string, n long, keep_id long")
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = (F.col("bucket").cast("long") * owners / len(directory.prefixes)).cast("int")  # ranges of buckets, so of keys
    owned = records.repartitionById(owners, owner).sortWithinPartitions("bucket", "key")
    index = owned.mapInArrow(_own, "bucket int, key long, chain int, chains int, text_sha256 string, n long, keep_id long")
    return scratch.write(index, "index")


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    body = lower_ascii(F.coalesce("text", F.lit("")))
    digests = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), F.unhex(F.sha2(body, 256)).alias("sha")), "digests")
    index = build_index(docs, digests, scratch, capacity).select("key", "chains", F.unhex("text_sha256").alias("of"), "n", "keep_id")
    found = digests.join(index, (digests["key"] == index["key"]) & ((index["chains"] == 1) | (digests["sha"] == index["of"])), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
