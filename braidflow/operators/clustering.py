"""Density clustering: DBSCAN's order-free definition, and ways to choose its radius.

A point is core if at least min_samples points lie within eps of it. Clusters are the components of core
points within eps of each other, numbered by their first core point; another point belongs to the first
cluster that has a core point within eps of it, or is noise (-1). Equal vectors are one vertex with a
multiplicity, and what is connected within one block (see blocks.py) is one vertex of the graph, so dense
regions don't make an edge for each pair.

Squares of distances are compared, with a relative tolerance of TOLERANCE: a radius that is itself a distance
between two points holds both, whatever the last bits of an engine's sums.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidflow.functions.vectors import doubles, sqdist
from braidflow.operators import blocks
from braidflow.operators.blocks import TOLERANCE
from braidflow.operators.graph import connected_components
from braidflow.shared import Scratch

GRID_DIMS = 3
HELD_DISTANCES = 100_000
BINS = 16_384


def _cell(v: Column, side: float, places: list[int]) -> Column:
    return F.array(*(F.floor(v[k] / F.lit(side)) for k in places))


def _within(v: Column, w: Column, eps: float, strict: bool) -> Column:
    d = sqdist(v, w)
    return d < eps * eps * (1 - TOLERANCE) if strict else d <= eps * eps * (1 + TOLERANCE)


def grid_places(points: DataFrame, dims: int) -> list[int]:
    """The places in which the vectors vary most, GRID_DIMS at most: those that tell cells apart best."""
    if dims <= GRID_DIMS:
        return list(range(dims))
    row = points.agg(*(F.var_pop(F.col("v")[k]).alias(f"s{k}") for k in range(dims))).first()
    return sorted(sorted(range(dims), key=lambda k: (-(row[f"s{k}"] or 0.0), k))[:GRID_DIMS])


def near_pairs(left: DataFrame, right: DataFrame, eps: float, places: list[int], strict: bool = False) -> DataFrame:
    """Rows of left and right (each with v, and other columns under different names) within eps of each other.

    An equi-join on grid cells of side eps, in the given places of the vectors: each left row looks into its own
    and the neighbouring cells.
    """
    side = eps * (1 + 2 * TOLERANCE)
    steps = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=len(places))))
    spread = left.withColumn("_step", F.explode(steps)).withColumn("_cell", F.zip_with(_cell(F.col("v"), side, places), "_step", lambda a, b: a + b)).drop("_step")
    there = right.withColumnRenamed("v", "_v").withColumn("_cell", _cell(F.col("_v"), side, places))
    return spread.join(there, "_cell").where(_within(F.col("v"), F.col("_v"), eps, strict)).drop("_cell")


def _blocked(points: DataFrame, dims: int, scratch: Scratch) -> DataFrame:
    """points: id, v -> their distinct vectors in blocks, with first (their least id) and m (how many)."""
    distinct = scratch.write(points.groupBy("v").agg(F.min("id").cast("long").alias("first"), F.count("*").alias("m")), "distinct")
    return scratch.write(blocks.blocked(distinct, dims), "blocks")


def _marked(points: DataFrame, eps: float, least: int, dims: int, strict: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The blocks with the neighbours and cores of each vector, and the pairs of blocks that come within eps."""
    cut = _blocked(points, dims, scratch)
    pairs = blocks.block_pairs(cut, eps)
    return scratch.write(blocks.marked(cut, blocks.counts(cut, pairs, eps, strict), eps, least, strict), "marked"), pairs


def neighbour_counts(points: DataFrame, eps: float, dims: int, strict: bool = False, count_self: bool = True) -> DataFrame:
    """points: id, v -> distinct vectors with first (their least id), m (how many), n (neighbours)."""
    scratch = Scratch(points.sparkSession, "neighbours")
    found, _ = _marked(points, eps, 1 << 62, dims, strict, scratch)
    own = 0 if count_self else 1
    return blocks.unblocked(found, dims).where("n > 0").select("v", "first", "m", (F.col("n") - own).alias("n"))


def dbscan(points: DataFrame, eps: float, min_samples: int, dims: int, strict: bool = False, count_self: bool = True, stored: bool = False) -> DataFrame:
    """points: id, v -> id, cluster_id, core. stored: the points are read from a table, so that they needn't be written."""
    scratch = Scratch(points.sparkSession, "dbscan")
    points = points.select("id", "v") if stored else scratch.write(points.select("id", "v"), "points")
    found, pairs = _marked(points, eps, min_samples + (0 if count_self else 1), dims, strict, scratch)
    links = scratch.write(blocks.links(found, pairs, eps, strict), "links")
    joined = connected_components(links.where("core").select("a", "b"), scratch, "cores")
    marked = blocks.unblocked(found, dims)
    roots = marked.where("rep IS NOT NULL").select(F.col("rep").alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = scratch.write(roots, "roots")
    numbers = roots.select("root").distinct().select("root", (F.row_number().over(W.orderBy("root")) - 1).cast("int").alias("cluster_id"))  # a row for each cluster
    clusters = scratch.write(roots.join(numbers, "root").select("node", "cluster_id"), "clusters")

    of_core = clusters.select(F.col("node").alias("rep"), F.col("cluster_id").alias("_own"))
    border = links.where("NOT core").join(clusters, F.col("b") == F.col("node")).groupBy(F.col("a").alias("first")).agg(F.min("cluster_id").alias("_near"))
    placed = marked.join(of_core, "rep", "left").join(border, "first", "left")
    placed = placed.select("v", F.coalesce("_own", "_near", F.lit(-1)).alias("cluster_id"), F.col("rep").isNotNull().alias("core"))
    return points.join(placed, "v").select("id", "cluster_id", "core")


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """cluster_id -> one row: how many clusters, how many noise points."""
    return clustered.agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"), F.count_if(F.col("cluster_id") < 0).alias("n_noise"))


def kth_distances(points: DataFrame, k: int, dims: int) -> DataFrame:
    """points: id, v -> id, kdist, and kdist2, its square: the distance to the k-th nearest point, itself the first.

    Where there are fewer points, k is their number less one, and one at least. The points within a radius are
    found as near_pairs finds them, and the radius doubles for points that have fewer than k so near.
    """
    scratch = Scratch(points.sparkSession, "kth")
    points = scratch.write(points.select("id", "v"), "points")
    places = grid_places(points, dims)
    size = points.agg(F.count("*").alias("n"), *(F.var_pop(F.col("v")[p]).alias(f"s{p}") for p in range(dims)), *(F.max(F.abs(F.col("v")[p])).alias(f"m{p}") for p in range(dims))).first()
    n = size["n"]
    k = min(k, max(1, n - 1))
    extent = 2 * sum((size[f"m{p}"] or 0.0) ** 2 for p in range(dims)) ** 0.5
    eps = max(sum(size[f"s{p}"] or 0.0 for p in range(dims)) ** 0.5 * (k / max(n, 1)) ** (1 / max(1, min(dims, 4))), extent * 2.0**-40, 1e-300)
    todo, parts, round_ = points, [], 0
    while True:
        found = near_pairs(todo, points.select("v"), eps, places).select("id", sqdist(F.col("v"), F.col("_v")).alias("d2"))
        ranked = found.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("d2"))).where(F.col("rn") == k)
        done = scratch.write(ranked.select("id", F.sqrt("d2").alias("kdist"), F.col("d2").alias("kdist2")), f"done-{round_}")
        parts.append(done)
        todo = scratch.write(todo.join(done, "id", "left_anti"), f"todo-{round_}")
        if eps > 2 * extent or todo.isEmpty():
            break
        eps, round_ = 2 * eps, round_ + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def knee_radius(kdists: DataFrame) -> DataFrame:
    """kdists: kdist -> eps: the knee of the sorted curve.

    The curve's first 90 % (4 points at least) is scaled to the unit square; the first point that lies
    furthest under the diagonal is the knee, moved into the 10th to the 87th percentile. Points are ranked by
    ranges of their distance: counts of ranges are added up, and a point's rank is its range's offset and its place in it.
    """
    span = kdists.agg(F.min("kdist").alias("v0"), F.max("kdist").alias("v9"), F.count("*").alias("n")).first()
    if not span["n"]:
        return kdists.sparkSession.createDataFrame([], "eps double")
    width = max((span["v9"] - span["v0"]) / BINS, 1e-300)
    rows = kdists.select("kdist", F.least(F.floor((F.col("kdist") - span["v0"]) / width), F.lit(BINS)).alias("bin"))
    counts = rows.groupBy("bin").agg(F.count("*").alias("c"))
    offsets = counts.select("bin", (F.sum("c").over(W.orderBy("bin")) - F.col("c")).alias("before"))  # BINS + 1 rows at most
    own = F.row_number().over(W.partitionBy("bin").orderBy("kdist")) - 1
    ranked = rows.withColumn("own", own).join(offsets, "bin").select("kdist", (F.col("before") + F.col("own")).alias("i"))
    n = span["n"]
    clip = max(4, int(n * 0.9))
    vn = F.max(F.when(F.col("i") == clip - 1, F.col("kdist")))
    ends = ranked.agg(vn.alias("vn"))
    deviation = F.col("i") / (clip - 1) - (F.col("kdist") - span["v0"]) / (F.col("vn") - span["v0"] + 1e-9)
    knee = ranked.where(F.col("i") < clip).crossJoin(F.broadcast(ends)).agg(F.max_by("i", F.struct(deviation, -F.col("i"))).alias("knee"))  # one row
    at = knee.select(F.greatest(F.lit(n // 10), F.least("knee", F.floor(F.lit(n) * 0.87))).alias("at"))
    return ranked.join(F.broadcast(at), F.col("i") == F.col("at")).select(F.col("kdist").alias("eps"))


def _squares(a: blocks.Points, b: blocks.Points, same: bool):
    """Rows of a and all of b: squared distances by a product, how far off, and which of them are pairs of one block's points counted once."""
    for rows, d2, off in blocks.products(a, b):
        once = np.arange(len(b.ids)) > np.arange(len(a.ids))[rows, None] if same else None
        yield rows, d2, off, once


def percentile_radius(points: DataFrame, share: float = 0.3, default: float = 1.0, floor: float = 1e-6) -> float:
    """The share's percentile of all distances between two points, with linear interpolation.

    The definition asks for all pairs, so the work grows with the square of the distinct vectors: products of blocks.
    Counts of BINS ranges of squares lead to a range with few distances. Of these alone exact values come to the driver, with how many
    pairs lie below them: counted in the same pass, so that the ranges needn't be exact.
    """
    scratch = Scratch(points.sparkSession, "percentile")
    points = scratch.write(points.select("id", doubles("v").alias("v")), "points")
    row = points.first()
    n = points.count()
    pairs = n * (n - 1) // 2
    if not pairs:
        return max(default, floor)
    dims = len(row["v"])
    cut = _blocked(points, dims, scratch)
    spans = cut.agg(*(x for k in range(dims) for x in (F.min(F.col("lo")[k]).alias(f"lo{k}"), F.max(F.col("hi")[k]).alias(f"hi{k}")))).first()
    equal = scratch.read("distinct", points.sparkSession.createDataFrame([], "v array<double>, first long, m long")).agg(F.sum(F.expr("m * (m - 1) div 2")).alias("n")).first()["n"]
    at = (pairs - 1) * share
    first_rank = int(at)
    last_rank = min(first_rank + 1, pairs - 1)
    top = max(sum((spans[f"hi{k}"] - spans[f"lo{k}"]) ** 2 for k in range(dims)), 1e-300) * (1 + 1e-9)
    low, high, below, inside = 0.0, top, 0, pairs
    both = blocks.block_pairs(cut)
    while inside > HELD_DISTANCES and high - low > 1e-10 * top:

        def count(a: blocks.Points, b: blocks.Points, same: bool, low=low, high=high) -> pa.Table:
            c = np.zeros(BINS + 1)
            for rows, d2, _, once in _squares(a, b, same):
                kept = (d2 >= low) & (d2 < high) if low else d2 < high
                kept = kept if once is None else kept & once
                bins = ((d2[kept] - low) * (BINS / (high - low))).astype(np.int64)
                w = None if a.once and b.once else np.outer(a.ms[rows], b.ms)[kept]
                c += np.bincount(np.maximum(bins, 0), w, BINS + 1)[: BINS + 1]
            some = np.flatnonzero(c)
            return pa.table({"k": pa.array(some, pa.int64()), "c": pa.array(c[some].astype(np.int64), pa.int64())})

        c = np.zeros(BINS + 1, np.int64)
        for r in blocks.compare(cut, both, count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
            c[r["k"]] = r["c"]  # BINS + 1 rows at most
        if not low:
            c[0] += equal
        upto = below + np.cumsum(c)
        i, j = (min(int(np.searchsorted(upto, x, "right")), BINS) for x in (first_rank, last_rank))
        below, inside = int(upto[i] - c[i]), int(c[i : j + 1].sum())
        step = (high - low) / BINS
        low, high = low + i * step, min(high, low + (j + 1) * step)

    low, high = low - 1e-11 * top, high + 1e-11 * top

    def within(a: blocks.Points, b: blocks.Points, same: bool) -> pa.Table:
        under, x, w = 0, [np.empty(0)], [np.empty(0, np.int64)]
        for rows, d2, _, once in _squares(a, b, same):
            less, kept = d2 < low, d2 <= high
            if once is not None:
                less, kept = less & once, kept & once
            of = None if a.once and b.once else np.outer(a.ms[rows], b.ms)
            under += np.count_nonzero(less) if of is None else int(of[less].sum())
            r, c = np.nonzero(kept & ~less)
            x.append(blocks.squares(a.v[rows][r], b.v[c]))
            w.append(np.ones(len(r), np.int64) if of is None else of[r, c])
        values, where = np.unique(np.concatenate(x), return_inverse=True)
        many = np.bincount(where, np.concatenate(w), len(values)).astype(np.int64)
        return pa.table({"x": pa.array(np.append(values, -1.0)), "n": pa.array(np.append(many, under), pa.int64())})

    held = {r["x"]: r["n"] for r in blocks.compare(cut, both, within, "x double, n long").groupBy("x").agg(F.sum("n").alias("n")).collect()}
    below = held.pop(-1.0)
    if low <= 0:
        held[0.0] = held.get(0.0, 0) + equal
    else:
        below += equal
    values = sorted(held)
    upto = below + np.cumsum([held[x] for x in values])
    a, b = (math.sqrt(values[int(np.searchsorted(upto, k, "right"))]) for k in (first_rank, last_rank))
    return max(float(a + (b - a) * (at - first_rank)), floor)


def nearest_centroid(points: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """points: id, v -> id, cluster_id, distance of the nearest centroid; ties to the smaller id."""
    from braidflow.functions.vectors import literal

    to = F.array(*(F.struct(F.sqrt(sqdist(F.col("v"), literal(c))).alias("distance"), F.lit(int(k)).alias("cluster_id")) for k, c in centroids))
    return points.select("id", F.array_min(to).alias("x")).select("id", "x.cluster_id", "x.distance")


def centroids(points: DataFrame, dims: int, by: str = "cluster_id") -> DataFrame:
    return points.groupBy(by).agg(F.count("*").alias("size"), F.array(*(F.avg(F.col("v")[k]) for k in range(dims))).alias("centroid"))
