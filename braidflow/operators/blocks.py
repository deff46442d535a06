"""Pairs of near vectors by blocks: points lie in blocks of neighbours, and pairs of blocks are compared as matrices.

A block is one row: its points' ids, multiplicities and vectors as bytes, and the box that they lie in. Ranges of the
places that vary most are cut in halves until a block is small, so boxes are small where the vectors allow it; two blocks whose
boxes are further apart than the radius are never compared. Where no box tells vectors apart, as in many dimensions, all
pairs of blocks are compared: the work grows with the square of the distinct vectors then, as matrix products.

Distances come from a matrix product; whatever lies within its rounding of the radius is computed again as the
sum of squares that the SQL has, in its order, so that no last bit decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidflow.functions.vectors import total

TOLERANCE = 1e-9
#: Points of a block at most, by the width of the vectors; points that are cut into blocks together; rows of a product at once.
SMALL, LARGE, WIDE = 1024, 2048, 8
SLAB = 16_384
CHUNK = 64
PLACES = 3
ROUNDING = 8 * np.finfo(float).eps
BLOB = "block long, n int, lo array<double>, hi array<double>, ids binary, ms binary, vs binary"


def threshold(eps: float, strict: bool) -> float:
    return eps * eps * (1 - TOLERANCE) if strict else eps * eps * (1 + TOLERANCE)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed from the first place to the last."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        d = x[:, k] - y[:, k]
        out += d * d
    return out


def matrix(batches: list[pa.RecordBatch] | pa.Table, column: str, dims: int) -> np.ndarray:
    parts = [b.column(column) for b in batches]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(float).reshape(-1, dims)


def cut(v: np.ndarray, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    if len(at) <= most:
        yield at
        return
    with np.errstate(all="ignore"):
        spread = np.nan_to_num(v[at].var(0), nan=-1.0, posinf=-1.0)
    half = len(at) // 2
    order = np.argpartition(v[at, int(spread.argmax())], half)
    yield from cut(v, at[order[:half]], most)
    yield from cut(v, at[order[half:]], most)


def box(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the finite vectors; the others are near nothing."""
    v = v[np.isfinite(v).all(1)]
    return (v.min(0), v.max(0)) if len(v) else (np.full(v.shape[1], np.inf), np.full(v.shape[1], np.inf))


def blocked(distinct: DataFrame, dims: int) -> DataFrame:
    """distinct: v, first, m, read from a table -> a row for each block."""
    row = distinct.agg(F.count("*").alias("n"), *(F.var_pop(F.col("v")[k]).alias(f"s{k}") for k in range(dims))).first()
    slabs = -(-row["n"] // SLAB)
    if slabs > 1:
        places = sorted(range(dims), key=lambda k: (-(row[f"s{k}"] or 0.0), k))[:PLACES]
        dealt = distinct.repartitionByRange(slabs, *(F.col("v")[k] for k in places))
    else:
        dealt = distinct.repartition(1)
    most = SMALL if dims <= WIDE else LARGE

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        v = matrix(batches, "v", dims)
        ids, ms = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("first", "m"))
        base = TaskContext.get().partitionId() << 32
        for k, at in enumerate(cut(v, np.arange(len(v)), most)):
            lo, hi = box(v[at])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([base + k], pa.int64()), "n": pa.array([len(at)], pa.int32()), "lo": pa.array([lo.tolist()], pa.list_(pa.float64())), "hi": pa.array([hi.tolist()], pa.list_(pa.float64())),
                "ids": pa.array([ids[at].tobytes()], pa.binary()), "ms": pa.array([ms[at].tobytes()], pa.binary()), "vs": pa.array([v[at].tobytes()], pa.binary()),
            })

    return dealt.select("v", "first", "m").mapInArrow(build, BLOB)


def block_pairs(blocks: DataFrame, eps: float | None = None) -> DataFrame:
    """i, j: the pairs of blocks, i <= j, whose boxes come within eps of each other; all of them without eps."""
    side = lambda i, lo, hi: blocks.select(F.col("block").alias(i), F.col("lo").alias(lo), F.col("hi").alias(hi))
    both = side("i", "la", "ha").crossJoin(side("j", "lb", "hb")).where("i <= j")
    if eps is not None:
        minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
        gap = F.zip_with(minus("la", "hb"), minus("lb", "ha"), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        both = both.where(total(F.transform(gap, lambda x: x * x)) <= eps * eps * (1 + 1e-6))
    return both.select("i", "j")


def compare(blocks: DataFrame, pairs: DataFrame, reduce: Callable[[Points, Points, bool], pa.Table], schema: str) -> DataFrame:
    """reduce(points of i, points of j, whether they are one block) for each pair: a group of its own."""
    dealt = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(blocks.drop("lo", "hi"), "block")

    def run(group: pa.Table) -> pa.Table:
        at = {group.column("block")[r].as_py(): r for r in range(group.num_rows)}
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        a = Points(group, at[i])
        return reduce(a, a if i == j else Points(group, at[j]), i == j)

    return dealt.groupBy("i", "j").applyInArrow(run, schema)


class Points:
    """A block's points."""

    def __init__(self, group: pa.Table, row: int):
        get = lambda c, kind: np.frombuffer(group.column(c)[row].as_buffer(), kind)
        self.block = group.column("block")[row].as_py()
        self.ids, self.ms = get("ids", np.int64), get("ms", np.int64)
        self.v = get("vs", np.float64).reshape(len(self.ids), -1)
        self.once = bool((self.ms == 1).all())
        if "comp" in group.column_names:
            self.comp = get("comp", np.int32)  # the cores come first, by component and id
            self.cores = int((self.comp >= 0).sum())
            self.starts = np.flatnonzero(np.diff(self.comp[: self.cores], prepend=-1))
            self.roots = self.ids[self.starts]


def products(a: Points, b: Points) -> Iterator[tuple[slice, np.ndarray, float]]:
    """Rows of a, their squared distances to b by a product, and how far these may be off."""
    with np.errstate(all="ignore"):
        lo, hi = box(np.concatenate([a.v, b.v]))
        middle = np.where(np.isfinite(lo), (lo + hi) / 2, 0.0)
        x, y = a.v - middle, b.v - middle
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        far = sum(float(s[np.isfinite(s)].max(initial=0.0)) for s in (xx, yy))
        left = np.column_stack([-2 * x, xx, np.ones(len(x))])
        right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), yy]).T)
        for k in range(0, len(x), CHUNK):
            yield slice(k, min(k + CHUNK, len(x))), left[k : k + CHUNK] @ right, ROUNDING * (x.shape[1] + 4) * far


def near(a: Points, b: Points, eps: float, strict: bool) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a, and which points of b are within eps of them."""
    limit = threshold(eps, strict)
    for rows, d2, off in products(a, b):
        sure, found = d2 < limit - off, d2 <= limit + off
        if np.count_nonzero(sure) != np.count_nonzero(found):
            r, c = np.nonzero(found & ~sure)
            exact = squares(a.v[rows][r], b.v[c])
            found[r, c] = exact < limit if strict else exact <= limit
        yield rows, found


def near_matrix(a: Points, b: Points, eps: float, strict: bool) -> np.ndarray:
    out = np.empty((len(a.ids), len(b.ids)), bool)
    for rows, found in near(a, b, eps, strict):
        out[rows] = found
    return out


def components(adjacent: np.ndarray) -> np.ndarray:
    """The component of each node of a square matrix, numbered by their first nodes: each node's row is read once."""
    of = np.full(len(adjacent), -1, np.int32)
    for node in range(len(adjacent)):
        if of[node] >= 0:
            continue
        of[node] = k = of.max() + 1
        front = np.array([node])
        while len(front):
            front = np.flatnonzero(adjacent[front].any(0) & (of < 0))
            of[front] = k
    return of


def counts(blocks: DataFrame, pairs: DataFrame, eps: float, strict: bool) -> DataFrame:
    """block, counts: for each pair of blocks, how many points are near each point of the one in the other."""

    def reduce(a: Points, b: Points, same: bool) -> pa.Table:
        of_a, of_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        for rows, found in near(a, b, eps, strict):
            of_a[rows] = found.sum(1) if b.once else found.astype(float) @ b.ms.astype(float)
            if not same:
                of_b += found.sum(0) if a.once else (a.ms[rows].astype(float) @ found.astype(float)).astype(np.int64)
        out = [(a.block, of_a)] + [(b.block, of_b)] * (not same)
        return pa.table({"block": pa.array([k for k, _ in out], pa.int64()), "counts": pa.array([c.tobytes() for _, c in out], pa.binary())})

    return compare(blocks, pairs, reduce, "block long, counts binary")


def marked(blocks: DataFrame, found: DataFrame, eps: float, least: int, strict: bool) -> DataFrame:
    """blocks and their counts -> blocks with ns, the sums, and comp: each core point's component within its block, -1 for others.

    A point is core from least on. Cores come first in their block, by component and id.
    """
    empty = lambda *cs: [F.lit(None).cast("binary").alias(c) for c in cs]
    rows = blocks.select("block", "ids", "ms", "vs", *empty("counts")).unionByName(found.select("block", *empty("ids", "ms", "vs"), "counts"))

    def run(group: pa.Table) -> pa.Table:
        p = Points(group, next(r for r in range(group.num_rows) if group.column("ids")[r].is_valid))
        ns = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group.column("counts") if c.is_valid)
        ns = np.zeros(len(p.ids), np.int64) + ns
        order = np.lexsort((p.ids, ns < least))
        cores = int((ns >= least).sum())
        p.ids, p.ms, p.v, ns = p.ids[order], p.ms[order], p.v[order], ns[order]
        inner = object.__new__(Points)
        inner.ids, inner.v = p.ids[:cores], p.v[:cores]
        comp = np.full(len(ns), -1, np.int32)
        if cores:
            comp[:cores] = components(near_matrix(inner, inner, eps, strict))
        order = np.concatenate([np.argsort(comp[:cores], kind="stable"), np.arange(cores, len(ns))])
        blob = {"ids": p.ids, "ms": p.ms, "vs": p.v, "ns": ns, "comp": comp}
        return pa.table({"block": pa.array([p.block], pa.int64())} | {c: pa.array([x[order].tobytes()], pa.binary()) for c, x in blob.items()})

    return rows.groupBy("block").applyInArrow(run, "block long, ids binary, ms binary, vs binary, ns binary, comp binary")


def links(blocks: DataFrame, pairs: DataFrame, eps: float, strict: bool) -> DataFrame:
    """core, a, b: links between components of two blocks (core), named by their least ids, and from other points to components."""

    def any_of(found: np.ndarray, starts: np.ndarray, axis: int) -> np.ndarray:
        if not found.size:
            return np.zeros((len(starts), found.shape[1]) if axis == 0 else (found.shape[0], len(starts)), bool)
        return np.maximum.reduceat(found.view(np.uint8), starts, axis).astype(bool)

    def reduce(a: Points, b: Points, same: bool) -> pa.Table:
        out = []
        if a.cores or b.cores:
            found = near_matrix(a, b, eps, strict)
            if not same:
                between = any_of(any_of(found[: a.cores, : b.cores], b.starts, 1), a.starts, 0)
                r, c = np.nonzero(between)
                x, y = a.roots[r], b.roots[c]
                if len(r) > len(a.roots) + len(b.roots):  # as many links as nodes are enough
                    both, n = np.concatenate([a.roots, b.roots]), len(a.roots)
                    square = np.zeros((len(both), len(both)), bool)
                    square[:n, n:], square[n:, :n] = between, between.T
                    of = components(square)
                    heads = np.unique(of, return_index=True)[1]
                    x, y = both, both[heads[of]]
                    x, y = x[x != y], y[x != y]
                out.append((True, x, y))
                r, c = np.nonzero(any_of(np.ascontiguousarray(found[: a.cores, b.cores :]), a.starts, 0))
                out.append((False, b.ids[b.cores :][c], a.roots[r]))
            r, c = np.nonzero(any_of(np.ascontiguousarray(found[a.cores :, : b.cores]), b.starts, 1))
            out.append((False, a.ids[a.cores :][r], b.roots[c]))
        cat = lambda parts, kind: pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))
        return pa.table({"core": pa.array(np.concatenate([np.empty(0, bool), *(np.full(len(x), k) for k, x, _ in out)]).astype(bool)), "a": cat([x for _, x, _ in out], np.int64), "b": cat([y for _, _, y in out], np.int64)})

    return compare(blocks, pairs, reduce, "core boolean, a long, b long")


def unblocked(blocks: DataFrame, dims: int) -> DataFrame:
    """Blocks with ns and comp -> v, first, m, n, and rep: the name of a core point's component in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p = Points(batch, r)
                rep = np.zeros(len(p.ids), np.int64)
                rep[: p.cores] = p.roots[p.comp[: p.cores]]
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, p.v.size + 1, dims, dtype=np.int32)), pa.array(p.v.ravel()))
                ns = np.frombuffer(batch.column("ns")[r].as_buffer(), np.int64)
                yield pa.RecordBatch.from_pydict({"v": v, "first": pa.array(p.ids), "m": pa.array(p.ms), "n": pa.array(ns), "rep": pa.array(rep, mask=p.comp < 0)})

    return blocks.mapInArrow(run, "v array<double>, first long, m long, n long, rep long")
