"""DBSCAN against a plain reference and on its corner cases."""

import math
import random

import pytest

from braidflow.operators import clustering
from braidflow.operators.graph import connected_components
from braidflow.shared import Scratch


def plain(points, eps, least, strict=False, own=True):
    near = lambda a, b: math.dist(a, b) < eps if strict else sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) <= eps * eps
    n = {i: [j for j, q in points.items() if near(p, q)] for i, p in points.items()}
    core = {i for i in points if len(n[i]) - (not own) >= least}
    label, k = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = k
                todo += [y for y in n[x] if y in core]
        k += 1
    for i in points:
        if i not in core:
            label[i] = min((label[j] for j in n[i] if j in core), default=-1)
    return label


@pytest.mark.parametrize("strict,own", [(False, True), (True, False)])
def test_random_points(spark, strict, own):
    rng = random.Random(7)
    points = {k: (round(rng.gauss(rng.choice((0, 4, 8)), 0.6), 2), round(rng.gauss(0, 0.6), 2), round(rng.random(), 1)) for k in range(150)}
    points |= {k: points[k - 150] for k in range(150, 170)}  # equal vectors
    rows = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "id long, v array<double>")
    got = {r["id"]: r["cluster_id"] for r in clustering.dbscan(rows, 0.5, 5, 3, strict, own).collect()}
    assert got == plain(points, 0.5, 5, strict, own)


def rows_of(spark, *points):
    return spark.createDataFrame([(k, [float(x)]) for k, x in enumerate(points)], "id long, v array<double>")


def labels(spark, points, *a, **k):
    return [r["cluster_id"] for r in clustering.dbscan(rows_of(spark, *points), *a, 1, **k).orderBy("id").collect()]


def test_border_goes_to_the_smaller_cluster(spark):
    # the point at 1.2 lies within reach of a core point of either cluster, and is none itself
    points = [0, 0.1, 0.2, 1.2, 2.2, 2.3, 2.4]
    assert labels(spark, points, 1.0, 4) == list(plain({k: (float(x),) for k, x in enumerate(points)}, 1.0, 4).values())


def test_exactly_enough_and_exactly_far(spark):
    assert labels(spark, [0, 1, 2], 1.0, 3) == [0, 0, 0]
    assert labels(spark, [0, 1, 2], 1.0, 3, strict=True, count_self=False) == [-1, -1, -1]


def test_numbers_follow_the_first_core(spark):
    assert labels(spark, [9, 0, 0, 0, 9, 9], 0.5, 3) == [0, 1, 1, 1, 0, 0]


def test_duplicates_are_a_cluster(spark):
    assert labels(spark, [1, 1, 1, 1, 1], 0.1, 5) == [0] * 5


def test_empty_and_single(spark):
    assert labels(spark, [], 1.0, 2) == []
    assert labels(spark, [1], 1.0, 2) == [-1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "t").collect()
    assert {r["node"]: r["root"] for r in found} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_knee_of_a_small_pool(spark):
    eps = clustering.knee_radius(clustering.kth_distances(rows_of(spark, 0, 1, 2, 3, 4, 10, 20, 40), 2, 1)).first()["eps"]
    assert eps == 1.0
