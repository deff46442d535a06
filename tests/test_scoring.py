"""Ties, zeros, thresholds and metric forks on hand-made rows."""

from pyspark.sql import functions as F

from braidflow.functions.vectors import dot, literal, sqdist
from braidflow.operators import hybrid, metrics, scoring
from braidflow.operators.hybrid import PROFILES
from braidflow.operators.models import Fourier, KernelPairs, LinearPairs
from braidflow.operators.taxonomy import PAIRS


def scored(spark, *scores):
    return spark.createDataFrame([(k, 2, list(map(float, s))) for k, s in enumerate(scores)], "row_id long, label int, scores array<double>")


def test_vectors(spark):
    row = spark.range(1).select(dot(literal([1, 2]), literal([3, 4])).alias("d"), sqdist(literal([1, 2]), literal([4, 6])).alias("q")).first()
    assert (row["d"], row["q"]) == (11.0, 25.0)


def test_zero_goes_to_first_or_second(spark):
    rows = scored(spark, [0, 0, 0, 0, 0, 0])
    assert scoring.ballot(rows).first()["votes"] == [3, 2, 1, 0]
    assert scoring.ballot(rows, False).first()["votes"] == [0, 1, 2, 3]


def test_ties(spark):
    # 2-2-1-1: classes 2 and 3 have two votes each; class 3 has the larger margin
    rows = scoring.ballot(scored(spark, [-1, 1, 1, 5, -1, 1], [-1, 1, 1, 1, -1, 1]))
    got = rows.select("votes", scoring.predict("votes").alias("first"), scoring.predict("vote_margin").alias("larger")).collect()
    assert got[0]["votes"] == got[1]["votes"] == [2, 2, 1, 1]
    assert (got[0]["first"], got[0]["larger"]) == (2, 3)
    assert got[1]["larger"] == 2  # equal margins: the lowest class


def test_weighted_rule_differs_over_a_thousand(spark):
    # class 2 wins three pairs narrowly, class 3 two by more than a thousand
    rows = scoring.ballot(scored(spark, [0.1, 0.1, 0.1, 900, 900, 1]))
    got = rows.select(scoring.predict("vote_margin").alias("a"), scoring.predict("weighted").alias("b")).first()
    assert (got["a"], got["b"]) == (2, 3)


def test_threshold_is_sure_in_batch_only(spark):
    row = spark.range(1).select(scoring.confident(F.lit(0.5), 0.5).alias("batch"), scoring.confident(F.lit(0.5), 0.5, True).alias("served")).first()
    assert row["batch"] and not row["served"]


def test_kernel_and_fourier_match_numpy_paths(spark, monkeypatch):
    rows = spark.createDataFrame([(k, 2, [0.1 * k, 0.2, -0.3 * k]) for k in range(7)], "row_id long, label int, x array<double>")
    kernel = KernelPairs(PAIRS, ((((0.0, 0.1, 0.2)), (0.3, 0.2, 0.1)),) * 6, ((1.0, -0.5),) * 6, (0.1,) * 6)
    linear = LinearPairs(PAIRS, tuple(tuple(0.1 * (k + j) for j in range(4)) for k in range(6)), (0.0,) * 6)
    fourier = Fourier.draw(3, 4)
    fourier.check(3, linear)
    native = [scoring.score(rows, kernel).collect(), scoring.score(rows, linear, fourier).collect()]
    monkeypatch.setattr(scoring, "WIDE", 0)
    wide = [scoring.score(rows, kernel).collect(), scoring.score(rows, linear, fourier).collect()]
    for a, b in zip(native, wide, strict=True):
        for x, y in zip(sorted(a), sorted(b), strict=True):
            assert max(abs(p - q) for p, q in zip(x["scores"], y["scores"], strict=True)) < 1e-9


def test_models_survive_their_tables(spark):
    linear = LinearPairs(PAIRS, ((1.0, 2.0),) * 6, (0.5,) * 6)
    assert LinearPairs.of(linear.table(spark)) == linear
    kernel = KernelPairs(PAIRS, (((1.0,), (2.0,)),) * 6, ((0.5, -0.5),) * 6, (0.0,) * 6, 0.05)
    assert KernelPairs.of(kernel.table(spark)) == kernel


def test_metrics_forks(spark):
    rows = spark.createDataFrame([(2, 2), (2, -1), (3, 2), (3, -2), (4, -1), (4, 4), (0, 0), (1, -1), (6, 2)], "label int, final int")
    got = metrics.rates(rows).first().asDict()
    assert got["accuracy_strict"] == 2 / 6 and got["accuracy_restricted"] == 2 / 3
    assert got["detection_novelty"] == got["detection_identification"] == 1 / 3 and got["false_alarm"] == 0.5
    by = {v: {r["class_id"]: r for r in metrics.per_class(rows, v).collect()} for v in ("all", "trained", "restricted")}
    assert by["all"][2]["fp"] == 2 and by["trained"][2]["fp"] == 1
    assert by["trained"][2]["fn"] == 1 and by["restricted"][2]["fn"] == 0
    assert by["all"][5]["f1"] == 0  # never predicted, never true


def test_evaluation_without_pool_or_holdout(spark):
    rows = scored(spark, [5, 5, 5, 1, 1, 1])
    got = hybrid.evaluate(rows, PROFILES["mpi"]).collect()
    assert [(r["route"], r["final"]) for r in got] == [("confident", 2)]


def test_invariants(spark):
    import random

    rng = random.Random(1)
    data = [(k, rng.choice(range(7)), [rng.gauss(0, 1) for _ in range(6)]) for k in range(120)]
    rows = spark.createDataFrame(data, "row_id long, label int, scores array<double>")
    for name in ("mpi", "openmp", "cuda"):
        out = hybrid.evaluate(rows, PROFILES[name], 0.9).collect()
        assert len(out) == len(data) and all(r["final"] is not None for r in out)
        assert {r["route"] for r in out} <= {"holdout", "confident", "normal", "uncertain"}
        assert all(r["final"] == r["pred"] for r in out if r["route"] == "confident")
