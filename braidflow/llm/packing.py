"""Packing: windows filled with lexical neighbours from a sharded BM25 inverted index.

Each document is tokenised and ended by an end id; its ids are written once to the shared folder.
Full windows of a long document are sequences by themselves, and what is left of it, less than a
window, is an item. Items are range-partitioned by a lexical signature (the least hash of their
rarer terms, then the row's own key), so that texts with common vocabulary meet in a shard and a hot
signature is cut by the second key. A task takes its rows SHARD items at a time and builds for each
shard an inverted index over token ids, weighted by BM25 with document frequencies and the mean length
of the whole corpus. The first unused item is a seed; its best unused neighbours fill its window, those
that fit whole first, then one that is cut; what is cut off stays an item. Only the last sequence of
a task has padding.

Defined cases: a null or empty text is one end id; repeated rows are packed each; a null doc_id is
packed like any other; special tokens' strings in a text are what the library makes of them.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm.common import Scratch, mix64, slices, table

WINDOW = 2048
END_ID = 1
SHARD = 1024
TASK_TOKENS = 8_000_000
CACHE_ENTRIES = 600_000
LONGEST_CACHED = 64
K1, B = 1.2, 0.75
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
COMMON_IDS = 1000  # the first merges of a byte-level vocabulary are its most frequent
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space besides the space and the line end, and what else has a text cut at spaces alone.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNEVEN = ("  ", " \n", "\n ", "\n\n", *OTHER_SPACE)


class Ids(dict):
    """Word -> its ids, with a prefix put before it, as little-endian bytes. Forgets all when full."""

    def __init__(self, prefix: str, code: str, piece, library, room: int, marks: Ids | None = None):
        super().__init__()
        self.prefix, self.code, self.piece, self.library, self.room = prefix, code, piece, library, room
        self.marks = self if marks is None else marks

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # letters are one part
            ids = array(self.code, self.piece((self.prefix + word).encode())).tobytes()
        else:
            letters = word.rstrip(MARKS)
            if letters and len(letters) < len(word) and letters[-1].isalpha():  # letters end where marks begin
                again = letters in self
                ids = self[letters] + self.marks[word[len(letters) :]]
                if not again:  # rare words would fill the room once more with marks
                    return ids
            else:
                ids = array(self.code, self.library(self.prefix + word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.room:
                self.clear()
            self[word] = ids
        return ids


class BpeIds:
    """A text's ids, word by word.

    The library's pre-tokenizer never joins a character that isn't white space with a space that follows it, so a
    text's ids are those of its words, each with the space before it. A single line end between two characters
    that aren't white space is a part by itself. Where two white space characters meet or others than the space
    and the line end occur, the text is cut at spaces after words alone. For words of letters the file's merges are run as ranks by tiktoken, which is
    faster on short parts; all else, and texts with an added token's string, go to the library.
    """

    def __init__(self, spec: str, room: int = CACHE_ENTRIES):
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        self.encode = library.encode
        model = json.loads(spec)
        self.added = [x["content"] for x in model["added_tokens"]]
        self.kind = "<u2" if max(model["model"]["vocab"].values()) < 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(c): b for b, c in [(b, b) for b in plain] + [(b, 256 + k) for k, b in enumerate(others)]}
        ranks = {bytes(byte_of[c] for c in x): i for x, i in model["model"]["vocab"].items() if x not in self.added}
        piece = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bare = Ids("", self.code, piece, library.encode, room // 4)
        self.spaced = Ids(" ", self.code, piece, library.encode, room, self.bare)
        self.line = self.bare["\n"]
        self.end = np.array([END_ID], self.kind).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, and the end id."""
        if any(map(text.__contains__, self.added)):
            return np.array([*self.encode(text, add_special_tokens=False).ids, END_ID], self.kind)
        return np.frombuffer(b"".join(self.parts(text)) + self.end, self.kind)

    def parts(self, text: str) -> list[bytes]:
        if not text:
            return []
        out: list[bytes] = []
        if text[-1] in " \n" or any(map(text.__contains__, UNEVEN)):
            return list(map(self.bare.__getitem__, cut(text)))
        for line in text.split("\n"):
            words = iter(line.split(" "))
            out.append(self.bare[next(words)])
            out += map(self.spaced.__getitem__, words)
            out.append(self.line)
        out.pop()
        return out


def cut(text: str) -> list[str]:
    """A text cut before each space that follows a character that isn't white space."""
    out, run = [], ""
    for k, x in enumerate(text.split(" ")):
        run += " " + x if k else x
        if x and not x[-1].isspace():
            out.append(run)
            run = ""
    return [*out, run] if run else out


def _squeeze(ids: np.ndarray) -> bytes:
    import zstandard

    global _compressor
    if _compressor is None:
        _compressor = zstandard.ZstdCompressor(level=1)
    return _compressor.compress(ids.tobytes())


def _unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    global _decompressor
    if _decompressor is None:
        _decompressor = zstandard.ZstdDecompressor()
    return np.frombuffer(_decompressor.decompress(blob), kind)


_compressor = _decompressor = None


def _tail(ids: np.ndarray) -> np.ndarray:
    return ids[len(ids) // WINDOW * WINDOW :]


def _tokenised(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BpeIds(spec.value)
        order = mix64(np.arange(1 << 16 if bpe.kind == "<u2" else 1 << 20, dtype=np.uint64)) >> np.uint64(2)
        order[:COMMON_IDS] += np.uint64(1 << 62)  # after all others
        for batch in slices(batches, 256):
            blobs, sizes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.ids(text or "")
                blobs.append(_squeeze(ids))
                sizes.append(len(ids))
                tail = _tail(ids)
                signatures.append(int(order[tail if len(tail) else ids[:1]].min()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(sizes, pa.int64()), pa.array(signatures, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "rk", "doc_tokens", "signature", "ids"])

    return run


def _frequencies(kind: str):
    """How many items of the task have each token id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16 if kind == "<u2" else 1 << 20, np.int64)
        for batch in slices(batches):
            for blob in batch.column("ids").to_pylist():
                counts[_tail(_unsqueeze(blob, kind))] += 1  # once for each id, however often it occurs
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["term", "df"])

    return run


class Index:
    """A shard's inverted index: for each token id the items that have it, with their BM25 weights."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.terms, weights, owners = [], [], []
        for k, ids in enumerate(items):
            term, count = np.unique(ids, return_counts=True)
            self.terms.append(term)
            weights.append(idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * len(ids) / mean_length)))
            owners.append(np.full(len(term), k, np.int64))
        term = np.concatenate(self.terms)
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.term, self.first = np.unique(term[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(order)))
        self.n = len(items)

    def neighbours(self, k: int, among: np.ndarray | None = None) -> np.ndarray:
        """The shard's items (those of among, which rise) by falling BM25 score for item k's terms; those that share none come last, in order."""
        at = np.searchsorted(self.term, self.terms[k])
        size = self.size[at]
        postings = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.owner[postings], self.weight[postings], self.n)
        if among is None:
            return np.argsort(-score, kind="stable")
        return among[np.argsort(-score[among], kind="stable")]

    def forget(self, used: np.ndarray) -> None:
        """Drops the postings of used items; the scores of the others stay as they are, to the bit."""
        stays = ~used[self.owner]
        before = np.concatenate(([0], np.cumsum(stays)))
        self.size = before[self.first + self.size] - before[self.first]
        self.first = np.cumsum(self.size) - self.size
        self.owner, self.weight = self.owner[stays], self.weight[stays]


def fill(lengths: list[int], index: Index, room: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length); only the last may be short. room: what the first may hold."""
    left = np.array(lengths, np.int64)
    window: list[tuple[int, int, int]] = []
    held = len(lengths)  # items that the index still has

    def take(k: int) -> None:
        nonlocal room
        n = min(room, int(left[k]))
        window.append((k, lengths[k] - int(left[k]), n))
        room -= n
        left[k] -= n

    for seed in range(len(lengths)):
        while left[seed]:
            take(seed)
            if room:
                unused = np.flatnonzero(left)
                if 4 * len(unused) < 3 * held:
                    index.forget(left == 0)
                    held = len(unused)
                ranked = index.neighbours(seed, unused)
                sizes = left[ranked]
                at = 0
                while room and len(fits := np.flatnonzero(sizes[at:] <= room)):
                    at += int(fits[0]) + 1
                    take(int(ranked[at - 1]))
                if room and len(rest := ranked[left[ranked] > 0]):
                    take(int(rest[0]))
            if not room:
                yield window
                window, room = [], WINDOW
    if window:
        yield window


def _packed(corpus, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        idf, mean_length = corpus.value
        task = TaskContext.get().partitionId() << 40
        filled, whole, room, out = 0, 0, WINDOW, []  # sequences that are filled have even numbers, whole windows odd ones

        def piece(doc: tuple, start: int, ids: np.ndarray, sequence: int, offset: int) -> None:
            out.append((doc[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc[1], task + sequence, offset))

        def shard(docs: list[tuple], items: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal room, filled
            if items:
                for window in fill([len(x) for x in items], Index(items, idf, mean_length), room):
                    for k, start, n in window:
                        piece(docs[k], docs[k][2] + start, items[k][start : start + n], 2 * filled, WINDOW - room)
                        room -= n
                    if not room:
                        filled, room = filled + 1, WINDOW
            columns = list(zip(*out, strict=True)) or [()] * len(NAMES)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=NAMES)

        docs, items = [], []
        for batch in slices(batches, 256):
            for doc_id, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids")), strict=True):
                ids = _unsqueeze(blob, kind)
                for at in range(0, n - WINDOW + 1, WINDOW):
                    piece((doc_id, n), at, ids[at : at + WINDOW], 2 * whole + 1, 0)
                    whole += 1
                if len(tail := _tail(ids)):
                    docs.append((doc_id, n, n - len(tail)))
                    items.append(tail)
                if len(items) == SHARD:
                    yield shard(docs, items)
                    docs, items = [], []
        yield shard(docs, items)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    spec = Path(tokenizer or default_tokenizer()).read_text()
    kind = BpeIds(spec).kind
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"), "text")
    tokens = scratch.write(rows.mapInArrow(_tokenised(shared), "doc_id long, rk long, doc_tokens long, signature long, ids binary"), "tokens")

    items = (F.col("doc_tokens") % WINDOW > 0).cast("long")
    size = tokens.agg(F.sum("doc_tokens").alias("all"), F.sum(items).alias("items"), F.sum(F.col("doc_tokens") % WINDOW).alias("tails")).first()
    n, total = size["items"] or 0, size["all"] or 0
    counted = tokens.mapInArrow(_frequencies(kind), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = np.zeros(len(json.loads(spec)["model"]["vocab"]) + 1024)
    for r in counted.collect():  # a row for each token id of the vocabulary at most
        idf[r["term"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    corpus = spark.sparkContext.broadcast((idf, max(1.0, (size["tails"] or 0) / max(1, n))))
    tasks = max(1, -(-total // TASK_TOKENS))
    dealt = tokens.select("signature", "rk", "doc_id", "doc_tokens", "ids").repartitionByRange(tasks, "signature", "rk", "doc_id").sortWithinPartitions("signature", "rk", "doc_id")
    return dealt.mapInArrow(_packed(corpus, kind), ", ".join(f"{c} long" for c in NAMES))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
