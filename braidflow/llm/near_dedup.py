"""MinHash near-dedup with odd sketches.

1. A document's set is that of its 5-word shingles. Bands of ROWS MinHash samples each make its band
   keys, and the first SAMPLES samples, folded into a bitmap by parity, its odd sketch. Documents with
   equal sets are one class from here on.
2. Classes that meet under a band key are tied to the least class there: a star, never all pairs.
   The components of these ties hold every pair that any band proposes.
3. Each such component is cut into blocks of at most about BLOCK classes, and each pair of blocks is
   one small group. In it the population counts of XORed sketches estimate the similarity of all its
   pairs at once; in falling order of the estimate, pairs of classes not yet connected are confirmed
   on their full sets. A group returns a tree of confirmed links, so at most a row for each class.
4. The components of the confirmed links are the result.

The similarity is a parameter, and the size filter, the sketch's bound and the number of bands follow from
it. A pair at the bound itself is proposed by some band with probability 1 - (1 - 0.85^8)^48 = 1 - 2.4e-7 at
85 % (at a lower similarity there are more bands, so that no more is missed), and passes the sketch's bound,
six standard deviations of the samples below it, all but surely; a link that is reported was confirmed on
full sets of 64-bit shingle hashes.

Defined cases: a document without words (or with a null text) has an empty set and is linked with
nothing; one of fewer than five words has one shingle; repeated rows are copies of each other, and
each gets a row; component_id is the least doc_id that isn't null, and kept compares null-safely;
other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm.common import Scratch, byte_texts, fresh, mix64, shingle_hashes, slices, table, word_hashes
from braidflow.operators.graph import connected_components

WIDTH = 5
PERCENT = 85
BANDS, ROWS = 48, 8
SKETCH_BITS = 1024
MARGIN = 0.11
BLOCK = 256
SAMPLES = BANDS * ROWS


@cache
def _family(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**63, bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64)
    return factors, shifts, rng.integers(1, 2**63, (bands, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int) -> int:
    """So many bands that a pair at the similarity is missed no more often than one at PERCENT by BANDS; BANDS at least."""
    missed = BANDS * math.log1p(-((PERCENT / 100) ** ROWS))
    return BANDS if percent >= PERCENT else math.ceil(missed / math.log1p(-((percent / 100) ** ROWS)))


def margin_for(percent: int) -> float:
    """MARGIN, by the standard deviation of the samples' share at the similarity."""
    return MARGIN * math.sqrt(percent * (100 - percent) / (PERCENT * (100 - PERCENT))) if percent < PERCENT else MARGIN


def minhash(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    factors, shifts, _ = _family(bands)
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 128):
        np.minimum(least, (shingles[at : at + 128, None] * factors + shifts).min(0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    bands = len(samples) // ROWS
    keys = (mix64(samples).reshape(bands, ROWS) * _family(bands)[2]).sum(1, dtype=np.uint64)
    return mix64(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits: the parity of how many of the first SAMPLES samples fall on each."""
    places = mix64(samples[:SAMPLES] ^ _family(BANDS)[1]) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64)


def estimate(odd_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two XORed sketches."""
    share = np.minimum(odd_bits / SKETCH_BITS, 0.4999)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-2 * share)


def shingles_of(text: bytes) -> np.ndarray:
    return shingle_hashes(word_hashes(text.lower()), WIDTH)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets' intersection is at least percent of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(bands_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cids, sizes, bands = [], [], []
            for text in byte_texts(batch.column("text")):
                s = shingles_of(text)
                sizes.append(len(s))
                if len(s):
                    digest = mix64(np.array([s.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix64(s ^ np.uint64(PERCENT))) + np.uint64(len(s))], np.uint64))
                    cids.append(int(digest.view(np.int64)[0]))
                    bands.append(band_keys(minhash(s, bands_each)))
                else:
                    cids.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "rk", "cid", "n_shingles", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        sets = [shingles_of(x) for x in byte_texts(batch.column("text"))]
        sketches = [odd_sketch(minhash(s)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("coarse"), batch.column("blocks"), pa.array(sketches, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "coarse", "blocks", "sketch", "shingles"])


def confirm(cids: list[int], sketches: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A tree of confirmed links. side: pairs within one side of two different blocks are another group's."""
    parent = list(range(len(cids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    found_a, found_b, found_j = [], [], []
    for k in range(len(cids) - 1):
        j = estimate(np.bitwise_count(sketches[k + 1 :] ^ sketches[k]).sum(1, dtype=np.int64))
        near = (j >= percent / 100 - margin_for(percent)) & (100 * np.minimum(sizes[k + 1 :], sizes[k]) >= percent * np.maximum(sizes[k + 1 :], sizes[k]))
        if side[0] != side[-1]:
            near &= side[k + 1 :] != side[k]
        to = np.flatnonzero(near)
        found_a.append(np.full(len(to), k))
        found_b.append(to + k + 1)
        found_j.append(j[to])
    if not found_a:
        return []
    a, b, j = map(np.concatenate, (found_a, found_b, found_j))
    links = []
    for x in np.argsort(-j, kind="stable"):
        p, q = int(a[x]), int(b[x])
        rp, rq = root(p), root(q)
        if rp != rq and linked(sets[p], sets[q], percent):
            parent[max(rp, rq)] = min(rp, rq)
            links.append((cids[p], cids[q]))
    return links


def _confirm_group(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("cid", "ascending")])
        rows: dict[int, tuple[int, bytes, bytes]] = {}
        for side, cid, sketch, shingles in zip(*(group.column(c).to_pylist() for c in ("side", "cid", "sketch", "shingles")), strict=True):
            rows.setdefault(cid, (side, sketch, shingles))
        links = []
        if len(rows) > 1:
            sketches = np.stack([np.frombuffer(v[1], np.uint64) for v in rows.values()])
            links = confirm(list(rows), sketches, [np.frombuffer(v[2], np.uint64) for v in rows.values()], np.array([v[0] for v in rows.values()]), percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and rk, the row's key, and root, its group's (null without words). percent: the least similarity of a link."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"), "text")
    sig = scratch.write(rows.mapInArrow(_signatures(bands_for(percent)), "doc_id long, rk long, cid long, n_shingles long, bands array<long>"), "signatures")

    bands = sig.where("cid IS NOT NULL").select(F.explode("bands").alias("band"), "cid")
    shared = bands.groupBy("band").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least <> most").select("band", "least")
    ties = bands.join(shared, "band").where("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    coarse = connected_components(ties, scratch, "coarse")

    blocks = coarse.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = coarse.join(blocks, "root").select(F.col("node").alias("cid"), F.col("root").alias("coarse"), "blocks")
    classes = scratch.write(sig.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least_doc"), F.min("rk").alias("rk")), "classes")
    needed = members.join(classes.select("cid", "rk"), "cid")
    texts = rows.select("rk", "text").join(needed, "rk").select("cid", "coarse", "blocks", "text")
    sets = texts.mapInArrow(_sets, "cid long, coarse long, blocks int, sketch binary, shingles binary")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("coarse", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "cid", "sketch", "shingles")
    links = dealt.groupBy("coarse", "i", "j").applyInArrow(_confirm_group(percent), "a long, b long")
    roots = connected_components(links, scratch, "links")

    placed = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least_doc", F.coalesce("root", "cid").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_doc").alias("component"))
    ids = placed.join(least, "root").select("cid", "component", "root")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = sig.select("doc_id", "rk", "n_shingles", "cid").join(ids, "cid", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "rk", "root")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with all its columns, also where rows repeat or have no doc_id; documents without words all stay."""
    (rk,) = fresh(docs.columns, "rk")
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    kept = near_dedup(docs, percent).where("kept")
    rows = kept.groupBy("root", "rk").agg(F.count("*").alias("n"))
    chosen = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("rk", "n")).alias("x")).select("x.rk", "x.n")
    scratch = Scratch(docs.sparkSession, "stay")
    stay = scratch.write(chosen.unionByName(rows.where("root IS NULL").select("rk", F.lit(1).cast("long").alias("n"))), "stay").withColumnRenamed("rk", rk)
    repeated = scratch.write(stay.where("n > 1").select(rk), "repeated")  # few as a rule; its size decides how it is joined
    keyed = docs.withColumn(rk, key)
    once = keyed.join(stay.where("n = 1").select(rk), rk, "left_semi")
    again = keyed.join(repeated, rk, "left_semi").dropDuplicates([rk])
    return once.unionByName(again).select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("rk", "root")
