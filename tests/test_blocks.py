"""Near pairs by blocks of points, against all pairs in numpy."""

import time

import numpy as np
import pytest

from braidflow.operators import blocks, clustering, serving
from braidflow.shared import Scratch

SF = "/root/testdata/sf0.001"


def frame(spark, v):
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, v array<double>")


def plain(v, eps, least, strict=False, own=True):
    """id -> cluster_id, core."""
    limit = blocks.threshold(eps, strict)
    near = np.empty((len(v), len(v)), bool)
    for k in range(len(v)):
        d2 = blocks.squares(np.broadcast_to(v[k], v.shape), v)
        near[k] = d2 < limit if strict else d2 <= limit
    core = near.sum(1) - (not own) >= least
    of = np.full(len(v), -1)
    cores = np.flatnonzero(core)
    of[cores] = blocks.components(near[np.ix_(cores, cores)])
    for k in np.flatnonzero(~core):
        of[k] = of[near[k] & core].min(initial=1 << 30)
    return {k: (int(c) if c < 1 << 30 else -1, bool(core[k])) for k, c in enumerate(of)}


def found(df):
    return {r["id"]: (r["cluster_id"], r["core"]) for r in df.collect()}


def test_dense_pool_in_time(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.6, (6000, 6)) + rng.choice((0, 3), (6000, 1))
    points = frame(spark, v)
    began = time.time()
    got = found(clustering.dbscan(points, 0.7, 5, 6))
    assert time.time() - began < 60  # by pairs of rows it took minutes
    assert got == plain(v, 0.7, 5)


@pytest.mark.parametrize("strict,own", [(False, True), (True, False)])
def test_many_small_blocks(spark, monkeypatch, strict, own):
    """Copies, borders, noise and radii that are distances, over several slabs and blocks."""
    monkeypatch.setattr(blocks, "SMALL", 24)
    monkeypatch.setattr(blocks, "SLAB", 150)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(0, 9, (300, 2)), rng.normal(20, 1.5, (300, 2)), rng.integers(0, 9, (60, 2)) * 1.0])
    assert found(clustering.dbscan(frame(spark, v), 1.0, 6, 2, strict, own)) == plain(v, 1.0, 6, strict, own)


def test_far_blocks_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL", 16)
    v = np.random.default_rng(5).uniform(0, 100, (800, 3))
    scratch = Scratch(spark, "t")
    cut = clustering._blocked(frame(spark, v), 3, scratch)
    n = cut.count()
    assert n >= 50 and blocks.block_pairs(cut, 2.0).count() < n * (n + 1) / 2 / 4
    got = {r["first"]: r["n"] for r in clustering.neighbour_counts(frame(spark, v), 5.0, 3).collect()}
    assert got == {k: int((((v - v[k]) ** 2).sum(1) <= 25).sum()) for k in range(len(v))}


def test_vectors_without_finite_values_are_noise(spark):
    v = [[0.0, 0], [0, 0.1], [float("nan"), 0], [float("inf"), 0], [float("inf"), 0]]
    assert found(clustering.dbscan(frame(spark, v), 1.0, 2, 2)) == {0: (0, True), 1: (0, True), 2: (-1, False), 3: (-1, False), 4: (-1, False)}


@pytest.mark.parametrize("values", ["reals", "copies", "whole"])
def test_percentile_of_all_pairs(spark, monkeypatch, values):
    monkeypatch.setattr(clustering, "HELD_DISTANCES", 50)
    monkeypatch.setattr(blocks, "SMALL", 100)
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (700, 4)) if values != "whole" else rng.integers(0, 3, (700, 4)) * 1.0
    if values == "copies":
        v[350:] = v[rng.integers(0, 30, 350)]
    d = np.concatenate([np.sqrt(((v[k + 1 :] - v[k]) ** 2).sum(1)) for k in range(len(v))])
    for share in (0.0, 0.01, 0.3, 1.0):
        assert clustering.percentile_radius(frame(spark, v), share) == pytest.approx(max(np.quantile(d, share), 1e-6), rel=1e-12)


def test_pure_clusters_in_time(spark):
    v = np.random.default_rng(8).normal(0, 1, (4000, 64))
    rows = frame(spark, v).withColumnsRenamed({"id": "row_id", "v": "x"})
    began = time.time()
    got = {r["row_id"]: r["cluster_id"] for r in serving.pure(rows, 64).collect()}
    assert time.time() - began < 60
    z = (v - v.mean(0)) / v.std(0)
    d = np.concatenate([np.sqrt(((z[k + 1 :] - z[k]) ** 2).sum(1)) for k in range(len(z))])
    assert got == {k: c for k, (c, _) in plain(z, np.quantile(d, 0.3), 5).items()}


#: The queries that the findings name: none makes a row for each pair of near rows.
NAMED = ("cluster_centroids", "cluster_labels_mixed", "dbscan_strict", "hybrid_rates_thread", "metric_files", "serve_hybrid_online", "cluster_counts", "confusion_matrix", "hybrid_final_thread", "legacy_bypass", "prediction_files", "serve_pure", "dbscan_clusters", "hybrid_final_cuda", "hybrid_mixed_mpi", "serve_csv", "serve_summary")


@pytest.mark.parametrize("name", NAMED)
def test_no_row_for_each_pair(spark, monkeypatch, name):
    from braidflow.plans.queries import QUERIES

    def refuse(*_, **__):
        raise AssertionError("pairs of rows")

    monkeypatch.setattr(clustering, "near_pairs", refuse)
    assert QUERIES[name](spark, SF).count()
