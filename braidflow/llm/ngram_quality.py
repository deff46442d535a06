"""Quality rules: base statistics, and a modified Kneser-Ney model with perplexity bands by language.

Counting. Words are lower-cased (A-Z) and hashed with their language, so a word of two languages is two
words. Every n-gram of every text is counted: no vocabulary and no array has a bound that drops any. A
task counts the word pairs of its texts, a start mark before each, and sends each shard of the contexts
one sorted array of hashed words with a sorted array of pairs and counts, as deltas under zstandard. The
owner of a shard merges what all tasks sent into one row of the model's table in the shared folder. A word's
continuation count, the number of different words before it, adds up in the same way.

Model. Modified Kneser-Ney of order 2. Discounts (D1, D2, D3+) of each order come from the counts of counts
of a language (languages are told apart by SLOT_BITS bits of their hash here, so two of very many may share
their discounts and unigram totals, and no table of theirs exceeds 2^SLOT_BITS rows). A document's own counts are
withheld when it is scored: with c' = c - own occurrences,

    p(w | v) = (c'(v w) - D(c'(v w)))+ / c'(v) + S'(v) / c'(v) * p1(w),   S'(v) = sum over w of D(c'(v w)),
    p1(w) = (cc(w) - D(cc(w))) / sum of cc + (sum of D(cc)) / sum of cc / number of words,

and p = p1 where nothing else follows v. So a document is no evidence for itself, and a word that it alone has is
scored by p1, which every word of the corpus has: there is no unknown word.

Scoring. No array is broadcast. In ROUNDS rounds, each for a part of the shards, the documents send their pairs with
the places of the documents to the shards that own them; the owners answer with each document's bits, as whole numbers of 2^-20
bit, so that sums don't depend on their order, on CHUNK_WORDS, on ROUNDS or on the number of shards. A shard with a very
frequent context gets as many tasks as its share asks for, each with its own copy of the shard.

Verdict. A document's log2 perplexity must lie within its language's band: the median of all
documents that pass the base rules, plus or minus WIDTH times the spread from the median to the 5th
or 95th percentile, wider for short documents by sqrt(1 + SHORT / words). Percentiles are of values rounded to
1/BINS bit. Languages come from the lang column; null is a language of its own, the same as the empty one.

Defined cases: a null text has no words; a text without words fails the base rules and has no perplexity; a
language none of whose documents passes them has no band, and its documents are judged by the base rules alone; repeated
rows each get a row; other columns do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidflow.llm.common import _SPACE, Scratch, byte_texts, mix64, release, slices, table, word_hashes

CHUNK_WORDS = 2_500_000
MERGE_PAIRS = 4_000_000
MAX_SHARDS = 4096
ROUNDS = 3
SLOT_BITS = 16
SCALE = 1 << 20
BINS = 100
LOWER, UPPER = 3.5, 1.8
SHORT = 100
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.uint64(0x5354415254)
_LOW = np.uint64(64 - SLOT_BITS)
_U = np.uint64


# ---- sorted arrays under zstandard


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as planes of their bytes, without the planes that are zero throughout."""
    import zstandard

    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        planes = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T
        used = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head.append(struct.pack("<QB", len(a), used))
        body.append(np.ascontiguousarray(planes[:used]).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n_arrays, at = data[0], 1
    sizes = [struct.unpack_from("<QB", data, at + 9 * k) for k in range(n_arrays)]
    at += 9 * n_arrays
    out = []
    for n, used in sizes:
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :used] = np.frombuffer(data, np.uint8, n * used, at).reshape(used, n).T
        at += n * used
        out.append(planes.view("<u8").ravel())
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=_U(0))


def sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint64)


def _starts(a: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)


def _narrow(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted pairs first * n + second, the words that occur, and the pairs in places among these."""
    first, second = pairs // _U(n), pairs % _U(n)
    there = np.zeros(n, bool)
    there[first] = True
    there[second] = True
    place = np.cumsum(there) - 1
    used = np.flatnonzero(there)
    return used, place[first].astype(np.uint64) * _U(len(used)) + place[second].astype(np.uint64)


class Pairs:
    """A shard: sorted hashed words, sorted pairs of their places (first * number of words + second), counts."""

    def __init__(self, words=None, pairs=None, counts=None):
        self.words = np.empty(0, np.uint64) if words is None else words
        self.pairs = np.empty(0, np.uint64) if pairs is None else pairs
        self.counts = np.empty(0, np.int64) if counts is None else counts

    @staticmethod
    def of(blob: bytes) -> Pairs:
        words, pairs, counts = unsqueeze(blob)[:3]
        return Pairs(sums(words), sums(pairs), counts.astype(np.int64))

    def blob(self) -> bytes:
        return squeeze(deltas(self.words), deltas(self.pairs), self.counts)

    def recoded(self, words: np.ndarray) -> np.ndarray:
        """The pairs, by their places among other words that hold all of these."""
        if not len(self.pairs):
            return self.pairs
        place = np.searchsorted(words, self.words).astype(np.uint64)
        n = _U(len(self.words))
        return place[self.pairs // n] * _U(len(words)) + place[self.pairs % n]

    @staticmethod
    def merged(parts: list[Pairs]) -> Pairs:
        words = np.unique(np.concatenate([p.words for p in parts]))
        pairs = np.concatenate([p.recoded(words) for p in parts])
        counts = np.concatenate([p.counts for p in parts])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = _starts(pairs)
        return Pairs(words, pairs[first], np.add.reduceat(counts, first) if len(first) else counts)


# ---- what tasks send


def language_key(lang: str) -> np.uint64:
    return _U(zlib.crc32(lang.encode()) & ((1 << SLOT_BITS) - 1)) << _LOW


def keyed(words: np.ndarray, lang: str) -> np.ndarray:
    """Words with their language: its slot above, a hash of both below."""
    own = mix64(words ^ mix64(np.array([zlib.crc32(lang.encode()) + (len(lang) << 32)], np.uint64)))
    return (own >> _U(SLOT_BITS)) | language_key(lang)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(words ^ _U(0xA5A5)) % _U(shards)).astype(np.int64)


class Chunk:
    """Whole documents' words, until there are enough to send."""

    def __init__(self):
        self.keys: list[int] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int, lang: str, text: bytes) -> None:
        words = word_hashes(text.lower())
        if len(words):
            self.keys.append(key)
            self.texts.append(keyed(np.concatenate(([_START], words)), lang))
            self.size += len(words)

    def pairs(self, shards: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """The words, and for each shard (of a part of them) its sorted pairs, one for each occurrence, and the documents they are in."""
        words, places = np.unique(np.concatenate(self.texts), return_inverse=True)
        n = len(words)
        sizes = np.array([len(t) for t in self.texts])
        ends = np.cumsum(sizes)
        inside = np.ones(len(places), bool)
        inside[ends - 1] = False
        owners = shard_of(words, shards)
        at = np.flatnonzero(inside & (owners % parts == part)[places])
        first = places[at]
        pairs = first.astype(np.uint64) * _U(n) + places[at + 1].astype(np.uint64)
        owner = owners[first]
        doc = np.repeat(np.arange(len(sizes)), sizes)[at]
        order = np.lexsort((pairs, owner))  # stable, so documents rise within a pair
        bounds = np.searchsorted(owner[order], np.arange(shards + 1))
        return words, [(k, pairs[o], doc[o]) for k in range(shards) if len(o := order[bounds[k] : bounds[k + 1]])]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    own = Chunk()
    for batch in slices(batches):
        for key, lang, text in zip(batch.column("rk").to_pylist(), batch.column("lang").to_pylist(), byte_texts(batch.column("text")), strict=True):
            own.add(key, lang, text)
            if own.size >= size:
                yield own
                own = Chunk()
    if own.size:
        yield own


_MESSAGE = "owner int, kind int, source long, blob binary"


def _message(owner: int, kind: int, source: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([kind], pa.int32()), pa.array([source], pa.int64()), pa.array([blob], pa.binary())], names=["owner", "kind", "source", "blob"])


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in slices(batches, 16):
        yield from zip(*(batch.column(c).to_pylist() for c in ("owner", "kind", "source", "blob")), strict=True)


def _counted(shards: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            words, parts = chunk.pairs(shards)
            for k, pairs, _ in parts:
                first = _starts(pairs)
                used, own = _narrow(pairs[first], len(words))
                yield _message(k, 0, 0, Pairs(words[used], own, np.diff(np.append(first, len(pairs)))).blob())

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, parts, loose = None, [], 0
    for shard, _, _, blob in _messages(batches):
        if shard != at:
            if parts:
                yield _message(at, 0, 0, Pairs.merged(parts).blob())
            at, parts, loose = shard, [], 0
        parts.append(Pairs.of(blob))
        loose += len(parts[-1].pairs)
        if loose > max(MERGE_PAIRS, len(parts[0].pairs)):
            parts, loose = [Pairs.merged(parts)], 0
    if parts:
        yield _message(at, 0, 0, Pairs.merged(parts).blob())


def _dealt(messages: DataFrame, owners: int) -> DataFrame:
    """Every owner's messages to a task of its own, in order."""
    return messages.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner", "kind", "source")


# ---- counts of counts, discounts, unigrams


def discounts(n: np.ndarray) -> np.ndarray:
    """D0 to D3+ of a language from its numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


_STATS = ["n1", "n2", "n3", "n4", "types", "total"]


def _slot_stats(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Of each language's slot: how many counts are 1, 2, 3 and 4, how many there are, and their sum."""
    slots, at = np.unique((words >> _LOW).astype(np.int64), return_inverse=True)
    columns = [np.bincount(at[counts == k], minlength=len(slots)) for k in (1, 2, 3, 4)]
    columns += [np.bincount(at[counts > 0], minlength=len(slots)), np.bincount(at, counts, len(slots)).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(slots), *(pa.array(c.astype(np.int64)) for c in columns)], names=["slot", *_STATS])


def _tallied(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """At most 2^SLOT_BITS rows for the driver."""
    found = rows.mapInArrow(run, "slot long, " + ", ".join(f"{c} long" for c in _STATS)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in _STATS))
    return {r["slot"]: np.array([r[c] for c in _STATS], np.int64) for r in found.collect()}


def _pair_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, blob in _messages(batches):
        own = Pairs.of(blob)
        yield _slot_stats(own.words[own.pairs // _U(len(own.words))], own.counts)


def _asks(shards: int):
    """From each shard to the owners of its words: the words, and before how many of the shard's contexts' each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _, blob in _messages(batches):
            own = Pairs.of(blob)
            before = np.bincount((own.pairs % _U(len(own.words))).astype(np.int64), minlength=len(own.words))
            to = shard_of(own.words, shards)
            for k in np.unique(to).tolist():
                yield _message(k, 0, shard, squeeze(deltas(own.words[to == k]), before[to == k]))

    return run


def _word_owner(answer):
    """Runs answer(words, continuation counts, asked) for each shard of words; asked: (source, its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, []

        def made():
            every = np.concatenate([w for _, w, _ in asked])
            words, place = np.unique(every, return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, _, c in asked]).astype(float), len(words)).astype(np.int64)
            yield from answer(at, words, counts, [(s, w) for s, w, _ in asked])

        for shard, _, source, blob in _messages(batches):
            if shard != at:
                if asked:
                    yield from made()
                at, asked = shard, []
            words, before = unsqueeze(blob)
            asked.append((source, sums(words), before))
        if asked:
            yield from made()

    return run


def unigrams(words: np.ndarray, counts: np.ndarray, stats: dict[int, np.ndarray]) -> np.ndarray:
    """p1 of words by their continuation counts."""
    slots, at = np.unique((words >> _LOW).astype(np.int64), return_inverse=True)
    out = np.empty(len(words))
    for k, slot in enumerate(slots.tolist()):
        n = stats[slot]
        d, own = discounts(n[:4]), at == k
        total, rest = max(1, n[5]), n[4] - n[0] - n[1]
        back = (d[1] * n[0] + d[2] * n[1] + d[3] * rest) / total
        c = counts[own]
        out[own] = (c - d[np.minimum(c, 3)]) / total + back / max(1, n[4])
    return out


# ---- scoring


class Shard:
    """A shard ready to score: contexts' totals and their numbers of pairs that occur once, twice, more often."""

    def __init__(self, blob: bytes, stats: dict[int, np.ndarray], word_stats: dict[int, np.ndarray], shards: int):
        self.own = Pairs.of(blob)
        n = len(self.own.words)
        self.p1, self.word_stats, self.owner = np.full(n, np.nan), word_stats, shard_of(self.own.words, shards)
        first = (self.own.pairs // _U(max(1, n))).astype(np.int64)
        c = self.own.counts
        self.total = np.bincount(first, c, n).astype(np.int64)
        self.few = np.stack([np.bincount(first[(c == k) if k < 3 else (c >= 3)], minlength=n) for k in (1, 2, 3)])
        slots, at = np.unique((self.own.words >> _LOW).astype(np.int64), return_inverse=True)
        by_slot = np.stack([discounts(stats[s][:4]) if s in stats else np.zeros(4) for s in slots.tolist()]) if n else np.zeros((0, 4))
        self.discount, self.slot = by_slot, at

    def answer(self, owner: int, counts: np.ndarray) -> None:
        """The continuation counts of the shard's words that the owner has, in their order."""
        at = self.owner == owner
        self.p1[at] = unigrams(self.own.words[at], counts, self.word_stats)

    def bits(self, blob: bytes) -> bytes:
        """Of a message: its documents' places, their bits (whole numbers of 1 / SCALE), their numbers of pairs, and the keys that came with it."""
        words, pairs, docs_each, doc, times, keys = unsqueeze(blob)
        message = Pairs(sums(words), sums(pairs))
        pairs = message.recoded(self.own.words)
        at = np.searchsorted(self.own.pairs, pairs)
        n = _U(len(self.own.words))
        each = docs_each.astype(np.int64)
        v, w = (np.repeat((x).astype(np.int64), each) for x in (pairs // n, pairs % n))
        c = np.repeat(self.own.counts[at], each)
        doc, m = doc.astype(np.int64), times.astype(np.int64)
        rest = c - m
        d = self.discount[self.slot[v]]
        _, group = np.unique(doc * len(self.own.words) + v, return_inverse=True)
        total = self.total[v] - np.bincount(group, m)[group].astype(np.int64)
        mass = np.zeros(len(m))
        for k in (1, 2, 3):
            is_in = lambda x: (x == k) if k < 3 else (x >= 3)  # noqa: B023, E731
            left = np.bincount(group, is_in(rest).astype(float) - is_in(c).astype(float))[group]
            mass += d[:, k] * (self.few[k - 1][v] + left)
        seen = np.maximum(rest - d[np.arange(len(rest)), np.minimum(rest, 3)], 0)
        p = np.where(total > 0, (seen + mass * self.p1[w]) / np.maximum(total, 1), self.p1[w])
        q = np.rint(-np.log2(p) * SCALE) * m
        there, at = np.unique(doc, return_inverse=True)
        return squeeze(there, np.bincount(at, q).astype(np.int64), np.bincount(at, m).astype(np.int64), keys)


def _sent(shards: int, size: int, extra: dict[int, tuple[int, int]], part: int, of: int):
    """The documents' pairs, for the shards of a part that own them: pairs, how many documents have each, those documents, how often.

    The first message of a chunk brings its documents' keys. extra: of a copied shard its first further owner and their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            words, parts = chunk.pairs(shards, part, of)
            keys = np.array(chunk.keys, np.int64).view(np.uint64)
            source = int(mix64(keys + np.arange(len(keys), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
            for k, pairs, doc in parts:
                entry = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1]))))
                times = np.diff(np.append(entry, len(pairs)))
                pairs, doc = pairs[entry], doc[entry]
                first = _starts(pairs)
                used, own = _narrow(pairs[first], len(words))
                at, n = extra.get(k, (0, 0))
                copy = source % (n + 1)
                yield _message(at + copy - 1 if copy else k, 2, source, squeeze(deltas(words[used]), deltas(own), np.diff(np.append(first, len(pairs))), doc, times, keys))
                keys = keys[:0]

    return run


def _scored(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for owner, kind, source, blob in _messages(batches):
            if kind == 0:
                at, shard = owner, Shard(blob, *shared.value, shards)
            elif at != owner:
                raise ValueError(f"no shard at {owner} before what is sent to it")
            elif kind == 1:
                shard.answer(source, unsqueeze(blob)[0].astype(np.int64))
            else:
                yield _message(owner, 3, source, shard.bits(blob))

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents, from what all shards answered."""
    at, parts = None, []

    def made() -> pa.RecordBatch:
        keys = next(p[3] for p in parts if len(p[3])).view(np.int64)
        bits, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for there, b, m, _ in parts:
            bits[there.astype(np.int64)] += b.astype(np.int64)
            n[there.astype(np.int64)] += m.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, bits, n)], names=["rk", "bits", "n"])

    for _, _, source, blob in _messages(batches):
        if source != at:
            if parts:
                yield made()
            at, parts = source, []
        parts.append(unsqueeze(blob))
    if parts:
        yield made()


def perplexities(docs: DataFrame, scratch: Scratch, chunk_words: int = CHUNK_WORDS, rounds: int = ROUNDS, shards: int | None = None) -> DataFrame:
    """docs: rk, lang, text -> rk, bits (in 1 / SCALE), n: of every text with words; equal rows add up."""
    spark = docs.sparkSession
    shards = shards or max(1, min(MAX_SHARDS, docs.rdd.getNumPartitions() // 2))
    counted = docs.mapInArrow(_counted(shards, chunk_words), _MESSAGE)
    pairs = scratch.write(_dealt(counted, shards).mapInArrow(_merged, _MESSAGE), "pairs")
    del counted
    release(spark)
    pair_stats = _tallied(pairs, _pair_stats)
    asks = scratch.write(pairs.mapInArrow(_asks(shards), _MESSAGE), "asks")

    def tally(_, words, counts, __):
        yield _slot_stats(words, counts)

    word_stats = _tallied(_dealt(asks, shards), _word_owner(tally))

    def tell(shard, words, counts, asked):
        for source, own in asked:
            yield _message(source, 1, shard, squeeze(counts[np.searchsorted(words, own)]))

    answers = scratch.write(_dealt(asks, shards).mapInArrow(_word_owner(tell), _MESSAGE), "answers")
    scratch.drop("asks")

    def volume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _, blob in _messages(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([int(Pairs.of(blob).counts.sum())])], names=["shard", "n"])

    volumes = {r["shard"]: r["n"] for r in pairs.mapInArrow(volume, "shard long, n long").collect()}  # MAX_SHARDS rows at most
    mean = sum(volumes.values()) / max(1, shards)
    owners, extra = shards, {}
    for k, n in sorted(volumes.items()):
        if more := int(n // (2 * mean)):
            extra[k] = (owners, more)
            owners += more
    model = pairs.unionByName(answers).withColumn("of", F.col("owner"))
    if extra:
        to = F.coalesce(*(F.when(F.col("owner") == k, F.array(F.lit(k), *(F.lit(at + j) for j in range(n)))) for k, (at, n) in extra.items()), F.array("owner"))
        model = model.withColumn("owner", F.explode(to))
    shared = spark.sparkContext.broadcast((pair_stats, word_stats))
    out = None
    for k in range(rounds):
        sent = docs.mapInArrow(_sent(shards, chunk_words, extra, k, rounds), _MESSAGE)
        answered = _dealt(model.where(F.col("of") % rounds == k).drop("of").unionByName(sent), owners).mapInArrow(_scored(shared, shards), _MESSAGE)
        added = answered.repartition("source").sortWithinPartitions("source").mapInArrow(_added, "rk long, bits long, n long")
        done = scratch.write(added, f"bits-{k}")
        out = done if out is None else out.unionByName(done)
        del sent, answered, added
        release(spark)
    scratch.drop("pairs", "answers")
    return out.groupBy("rk").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n"))


# ---- base statistics and verdict


def base_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    a = np.frombuffer(text, np.uint8)
    words = word_hashes(text)
    chars = int((~_SPACE[a] & ((a & 0xC0) != 0x80)).sum())
    symbols = int(_SYMBOL[a].sum())
    seen, duplicates = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line.split(None, 1):
            seen.add(line)
    repeated = 0
    if len(words) > WINDOW:
        n = len(words) - WINDOW + 1
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
            again = twice[at] == h
            cover = np.zeros(len(words) + 1, np.int64)
            cover[:n] += again
            cover[WINDOW:] -= again
            repeated = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), chars, symbols, duplicates, repeated


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, rk, lang, the base statistics, base_failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base = [base_statistics(x) for x in byte_texts(batch.column("text"))]
            columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
            failed = pa.array([b[0] < MIN_WORDS or 100 * b[4] > MAX_REPEAT_PERCENT * b[0] for b in base], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), batch.column("lang"), *columns, failed], names=["doc_id", "rk", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])

    return docs.mapInArrow(run, "doc_id long, rk long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")


def bands(scored: DataFrame) -> DataFrame:
    """lang, low, mid, high: percentiles 5, 50 and 95 of log2_ppl of the documents that pass the base rules, at a resolution of 1 / BINS."""
    binned = scored.where("NOT base_failed AND log2_ppl IS NOT NULL").groupBy("lang", F.round(F.col("log2_ppl") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    own = W.partitionBy("lang")  # 64 * BINS rows at most
    placed = binned.select("lang", "bin", F.sum("n").over(own.orderBy("bin")).alias("upto"), F.sum("n").over(own).alias("all"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) / BINS
    return placed.groupBy("lang").agg(at(0.05).alias("low"), at(0.5).alias("mid"), at(0.95).alias("high"))


def ngram_quality(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, chunk_words: int = CHUNK_WORDS, rounds: int = ROUNDS, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, log2_ppl. The last three parameters bound memory and disk, and change no result."""
    scratch = Scratch(docs.sparkSession, "ngram")
    doc_id, lang = F.col("doc_id").cast("long"), F.coalesce("lang", F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, lang, "text").alias("rk"), lang.alias("lang"), "text")
    found = perplexities(rows.select("rk", "lang", "text"), scratch, chunk_words, rounds, shards)
    base = base_columns(rows)
    scored = base.join(found, "rk", "left").withColumn("log2_ppl", F.col("bits") / F.col("n") / SCALE).drop("rk", "bits", "n")
    scored = scratch.write(scored, "scored")
    rows = scored.join(scratch.write(bands(scored), "bands"), "lang", "left")  # its size decides how it is joined
    wider = F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    low = F.col("mid") - lower * wider * (F.col("mid") - F.col("low"))
    high = F.col("mid") + upper * wider * (F.col("high") - F.col("mid"))
    within = F.coalesce(F.col("log2_ppl").between(low, high), F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"), "log2_ppl")


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality(table(spark, sf_dir, "documents"))
