"""What the text operators share: scratch tables, byte-level word splitting and hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from braidflow.shared import Scratch, release, scratch_root, table

__all__ = ["Scratch", "byte_texts", "fresh", "lower_ascii", "mix64", "release", "scratch_root", "shingle_hashes", "slices", "table", "word_hashes"]


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, changed where a table already has them, so that its own columns stay apart."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound what a Python worker holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---- words as [^\x20\x09-\x0D]+ of UTF-8 bytes, hashed without a Python step per word

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD6E8FEB86659FD93
_UNSTEP = pow(_STEP, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SEGMENT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, step in enumerate((_STEP, _UNSTEP)):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def _segment_word_hashes(a: np.ndarray) -> np.ndarray:
    space = _SPACE[a]
    inside = np.concatenate(([False], ~space, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Long texts are taken by segments cut at white space."""
    if len(data) <= SEGMENT:
        return _segment_word_hashes(np.frombuffer(data, np.uint8))
    a, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(a):
        end = min(at + SEGMENT, len(a))
        while end < len(a) and not (gaps := np.flatnonzero(_SPACE[a[at:end]])).size:
            end = min(end + SEGMENT, len(a))
        if end < len(a):
            end = at + int(gaps[-1]) + 1
        parts.append(_segment_word_hashes(a[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct hashes, sorted, of width-word shingles; fewer words make one shingle of them all."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h = h * np.uint64(_STEP) + words[k : k + n]
    return np.unique(mix64(h + np.uint64(min(width, len(words)) * int(_ODD) % 2**64)))
