"""Token counts: a two-tier table of pre-token lengths in front of the tokenizer.

No piece of the vocabulary holds a space mark after another character, so no merge crosses from a
word to the space before the next one: a text's tokens are those of its pre-tokens (a run of spaces
with what follows up to the next space), each counted alone. The first tier is a broadcast hash table from
frequent pre-tokens to their lengths in tokens, FREQUENT entries of LONGEST_CACHED characters at most, encoded once.
They are found by Misra-Gries summaries of every text, one of fixed size for each task, merged without any
shuffle of pre-tokens. The second tier is a bounded cache in
each worker for what it meets besides. Either only saves work; counts are the tokenizer's own.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts that contain the space mark
U+2581 itself are encoded whole; repeated rows and null doc_ids each get their row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from braidflow.llm.common import Scratch, slices, table

FREQUENT = 8192
CACHE_ENTRIES = 400_000
LONGEST_CACHED = 64
LIMIT = 4096
MARK = "▁"
_PRETOKEN = re.compile(" +[^ ]+| +$")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their first space mark (the library puts one before each text)."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [x[1:] for x in _PRETOKEN.findall(" " + text)]


class PieceCounter(dict):
    """Pre-token -> number of tokens. Starts from the table of frequent ones and goes back to it when full."""

    def __init__(self, model: bytes, lengths: dict[str, int] | None = None, room: int = CACHE_ENTRIES):
        import sentencepiece

        super().__init__()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = any(MARK in self.pieces.id_to_piece(i).lstrip(MARK) for i in range(self.pieces.get_piece_size()))
        self.first = lengths or {}
        self.room = room + len(self.first)
        self.update(self.first)

    def _count(self, pretoken: str) -> int:
        return len(self.pieces.encode(pretoken)) if pretoken else 1

    def __missing__(self, pretoken: str) -> int:
        n = self._count(pretoken)
        if len(pretoken) <= LONGEST_CACHED:
            if len(self) >= self.room:
                self.clear()
                self.update(self.first)
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.whole or MARK in text:
            return len(self.pieces.encode(text))
        return sum(map(self.__getitem__, pretokens(text)))


def _prune(counts: Counter, size: int) -> Counter:
    """Misra-Gries: the size largest stay, less the largest count of those that go."""
    if len(counts) <= size:
        return counts
    ranked = counts.most_common(size + 1)
    least = ranked[-1][1]
    return Counter({k: n - least for k, n in ranked[:-1] if n > least})


def _summary(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], names=["pretokens", "counts"])


def frequent_pretokens(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """At most size pre-tokens, those with the largest Misra-Gries counts over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pretokens(text))
            if len(counts) > 16 * size:
                counts = _prune(counts, 4 * size)
        counts = Counter({k: n for k, n in counts.items() if len(k) <= LONGEST_CACHED})
        yield _summary(_prune(counts, size))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 1):
            counts.update(dict(zip(batch.column(0).to_pylist()[0], batch.column(1).to_pylist()[0], strict=True)))
            counts = _prune(counts, size)
        yield _summary(counts)

    schema = "pretokens array<string>, counts array<long>"
    scratch = Scratch(docs.sparkSession, "frequent")
    summaries, level = scratch.write(docs.select("text").mapInArrow(count, schema), "0"), 0
    while (parts := summaries.rdd.getNumPartitions()) > 1 and level < 8:
        level += 1
        fewer = scratch.write(summaries.mapInArrow(merge, schema), str(level))
        if fewer.rdd.getNumPartitions() >= parts:
            break
        summaries = fewer
    merged = summaries.coalesce(1).mapInArrow(merge, schema).collect()
    scratch.drop(*map(str, range(level + 1)))
    return [x for row in merged for x in row["pretokens"]]


def frequent_lengths(model: bytes, pretokens: list[str]) -> dict[str, int]:
    """The first tier: how many tokens each frequent pre-token has."""
    counter = PieceCounter(model)
    return {x: counter[x] for x in pretokens}


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. The text is read whole."""
    spark = docs.sparkSession
    proto = Path(model or default_model()).read_bytes()
    shared = spark.sparkContext.broadcast((proto, frequent_lengths(proto, frequent_pretokens(docs, frequent))))  # FREQUENT short entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(*shared.value)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
