"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where its top bits are zero, so that chunks depend
on the bytes around their ends alone and fall into step again after an insertion. Chunks are compared
by 64-bit digests. The first chunk of a digest (by doc_id, then position) stays; those in other documents that
follow each other as in the first one's are a run. A run is extended on both sides by
comparing bytes with the text around its source, and trimmed to whole words. Stretches of
more than MIN_WORDS words that repeat across documents are deleted.

A byte that is deleted equals one in an earlier document, so one copy of everything stays. Before a run
is used, another hash of all its bytes is compared with its source's, so a chance collision of digests
deletes nothing.

Defined cases: a null text counts as empty and is returned empty; rows without doc_id come first, in an order of
their own, each text a document; rows of the same doc_id are one document, so they are no copies of each other;
what repeats within one document alone stays; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm.common import _SPACE, Scratch, byte_texts, release, slices, table

MIN_CHUNK, MAX_CHUNK, BITS = 20, 128, 4
CONTEXT = 320
MIN_WORDS = 50
NO_ID, NO_IDS = -(2**63), 2**61  # the first key of rows without doc_id, and how many there are
SLICES_BITS = 16

_GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where the text's chunks end, in order; the last is the text's end."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # the hash of the last 16 bytes, each shifted by its distance
        rolled = h.copy()
        rolled[k:] += h[:-k] << np.uint32(k) if n > k else 0
        h = rolled
    ends, at = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while end - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if end - at >= MIN_CHUNK:
            at = end
            ends.append(at)
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in slices(batches, 128):
        digests, ids, starts, sizes = [], [], [], []
        for did, data in zip(batch.column("did").to_pylist(), byte_texts(batch.column("text")), strict=True):
            ends = chunk_ends(data)
            begins = [0, *ends[:-1]]
            digests += [digest(data[a:b]) for a, b in zip(begins, ends)]  # noqa: B905
            ids.append(np.full(len(ends), did, np.int64))
            starts += begins if ends else []
            sizes += [b - a for a, b in zip(begins, ends)]  # noqa: B905
        yield pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=["digest", "did", "start", "size"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's later chunks, in order, to runs with the same distance from the same source."""
    for batch in slices(batches):
        out = []
        for did, chunks in zip(batch.column("did").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            run = None
            for c in chunks:
                if run and run[2] == c["start"] and run[3] == c["src"] and c["src_start"] - c["start"] == run[4] - run[1]:
                    run[2] += c["size"]
                else:
                    run = [did, c["start"], c["start"] + c["size"], c["src"], c["src_start"]]
                    out.append(run)
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["did", "start", "stop", "src", "src_start"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each wanted slice of a source: what stands on both sides of it, and another hash of the slice itself."""
    import xxhash

    for batch in slices(batches, 64):
        src, start, stop, left, right, check = [], [], [], [], [], []
        for did, data, wanted in zip(batch.column("src").to_pylist(), byte_texts(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            for x in wanted:
                a, b = x["src_start"], x["src_stop"]
                src.append(did)
                start.append(a)
                stop.append(b)
                left.append(data[max(0, a - CONTEXT) : a])
                right.append(data[b : b + CONTEXT])
                check.append(xxhash.xxh3_64_intdigest(data[a:b], 9))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(np.array(check, np.uint64).view(np.int64))], names=["src", "src_start", "src_stop", "before", "after", "check"])


def _alike(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def _whole(context: bytes, n: int, next_byte: bytes) -> bool:
    """Whether a word ends after n bytes of a source's context and before the document's next byte."""
    return (n == len(context) or _SPACE[context[n]]) and (not next_byte or _SPACE[next_byte[0]])


def repeated_spans(data: bytes, runs: list[dict]) -> list[tuple[int, int, set[int]]]:
    """Stretches of whole words, more than MIN_WORDS of them, that runs and their contexts cover."""
    import xxhash

    spans = []
    for r in runs:
        a, b = r["start"], r["stop"]
        if xxhash.xxh3_64_intdigest(data[a:b], 9) != r["check"] % 2**64:
            continue
        before, after = r["before"][::-1], r["after"]
        back, ahead = _alike(data[max(0, a - len(before)) : a][::-1], before), _alike(data[b : b + len(after)], after)
        a, b = a - back, b + ahead
        # where the two texts part, only words that end in both are the source's; beyond the context they may go on
        parted = back < CONTEXT and not _whole(before, back, data[:a][-1:])
        while parted and a < b and not _SPACE[data[a]]:
            a += 1
        parted = ahead < CONTEXT and not _whole(after, ahead, data[b : b + 1])
        while parted and b > a and not _SPACE[data[b - 1]]:
            b -= 1
        spans.append((a, b, r["src"]))
    merged: list[list] = []
    for a, b, src in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
            merged[-1][2].add(src)
        else:
            merged.append([a, b, {src}])
    out = []
    for a, b, sources in merged:
        if a and not _SPACE[data[a - 1]]:
            while a < b and not _SPACE[data[a]]:
                a += 1
        if b < len(data) and not _SPACE[data[b]]:
            while b > a and not _SPACE[data[b - 1]]:
                b -= 1
        if a and b < len(data) and not _SPACE[data[a - 1]] and not _SPACE[data[b]]:
            a += 1  # the white space that parts what stays
        if len(data[a:b].split()) > MIN_WORDS:
            out.append((a, b, sources))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        texts, removed, spans_out, sources_out = [], [], [], []
        for data, runs in zip(byte_texts(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            spans = repeated_spans(data, runs) if runs else []
            kept, at = [], 0
            for a, b, _ in spans:
                kept.append(data[at:a])
                at = b
            texts.append(b"".join([*kept, data[at:]]).decode())
            removed.append(sum(b - a for a, b, _ in spans))
            spans_out.append(len(spans))
            sources_out.append(sorted(x for x in set().union(*(s for _, _, s in spans)) if x >= NO_ID + NO_IDS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans_out, pa.int64()), pa.array(removed, pa.int64()), pa.array(sources_out, pa.list_(pa.int64()))], names=["doc_id", "text", "n_spans", "removed_bytes", "source_ids"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text (what is left of it), n_spans, removed_bytes, source_ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_IDS))).alias("did"), text.alias("text"))
    chunks = rows.select("did", "text").mapInArrow(_chunks, "digest long, did long, start int, size int")
    first = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("did", "start")).alias("first")).where("n > 1").select("digest", "first")
    later = chunks.join(first, "digest").where(F.col("did") != F.col("first.did"))
    later = later.select("did", "start", "size", F.col("first.did").alias("src"), F.col("first.start").alias("src_start")).distinct()
    listed = later.groupBy("did").agg(F.sort_array(F.collect_list(F.struct("start", "size", "src", "src_start"))).alias("chunks"))
    runs = scratch.write(listed.mapInArrow(_runs, "did long, start int, stop int, src long, src_start int"), "runs")
    release(spark)

    runs = runs.withColumn("src_stop", F.expr("src_start + stop - start"))
    sources = runs.select("src", "src_start", "src_stop").distinct()
    wanted = sources.groupBy("src", F.shiftright("src_start", SLICES_BITS).alias("part")).agg(F.collect_list(F.struct("src_start", "src_stop")).alias("wanted"))  # a stretch of a source's text at a time
    beside = rows.select(F.col("did").alias("src"), "text").join(wanted, "src").select("src", "text", "wanted")
    contexts = scratch.write(beside.mapInArrow(_contexts, "src long, src_start int, src_stop int, before binary, after binary, check long"), "contexts")
    release(spark)

    of_doc = runs.join(contexts, ["src", "src_start", "src_stop"]).groupBy("did").agg(F.collect_list(F.struct("start", "stop", "src", "before", "after", "check")).alias("runs"))
    of_doc = scratch.write(of_doc, "of_doc")
    return rows.join(of_doc, "did", "left").select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, text string, n_spans long, removed_bytes long, source_ids array<long>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
