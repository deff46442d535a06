"""One-vs-one models: linear pairs in closed form, kernel expansions, random Fourier features.

A model is a handful of pair rows, bounded by classes^2 / 2 and the feature width, so it is collected
and becomes part of the scoring expression. save() and load() keep it as Parquet tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.operators.taxonomy import PAIRS, TRAINED

# Kernel widths and the size of the random projection.
RBF_GAMMA = 0.1
RFF_GAMMA, RFF_SIZE, RFF_SEED = 0.01, 1024, 42


@dataclass(frozen=True)
class LinearPairs:
    """score = w . x + b for each pair; a positive score is for the first class of the pair."""

    pairs: tuple[tuple[int, int], ...]
    w: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    checkpoint: str = "best"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, p, n, list(map(float, w)), float(b)) for k, ((p, n), w, b) in enumerate(zip(self.pairs, self.w, self.b, strict=True))]
        return spark.createDataFrame(rows, "pair int, pos int, neg int, w array<double>, b double").withColumn("checkpoint", F.lit(self.checkpoint))

    @staticmethod
    def of(table: DataFrame) -> LinearPairs:
        rows = table.orderBy("pair").collect()  # a row for each pair
        if len({len(r["w"]) for r in rows}) > 1:
            raise ValueError("pairs of different width")
        return LinearPairs(tuple((r["pos"], r["neg"]) for r in rows), tuple(tuple(r["w"]) for r in rows), tuple(r["b"] for r in rows), rows[0]["checkpoint"] if "checkpoint" in table.columns else "best")


@dataclass(frozen=True)
class KernelPairs:
    """score = sum of alpha * exp(-gamma * |x - sv|^2) + b for each pair. Gamma belongs to the model."""

    pairs: tuple[tuple[int, int], ...]
    vectors: tuple[tuple[tuple[float, ...], ...], ...]
    alphas: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    gamma: float = RBF_GAMMA

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, n, k, list(map(float, v)), float(a), float(b), self.gamma) for (p, n), vs, al, b in zip(self.pairs, self.vectors, self.alphas, self.b, strict=True) for k, (v, a) in enumerate(zip(vs, al, strict=True))]
        return spark.createDataFrame(rows, "ca int, cb int, sv_id int, sv array<double>, alpha double, bias double, gamma double")

    @staticmethod
    def of(table: DataFrame) -> KernelPairs:
        """Support vectors are bounded by the trainer's own limit."""
        by: dict[tuple[int, int], list] = {}
        for r in table.orderBy("ca", "cb", "sv_id").collect():
            by.setdefault((r["ca"], r["cb"]), []).append(r)
        return KernelPairs(tuple(by), tuple(tuple(tuple(r["sv"]) for r in v) for v in by.values()), tuple(tuple(r["alpha"] for r in v) for v in by.values()), tuple(v[0]["bias"] for v in by.values()), next(iter(by.values()))[0]["gamma"])


@dataclass(frozen=True)
class Fourier:
    """x -> sqrt(2 / n) * cos(omega . x + phase)."""

    omega: tuple[tuple[float, ...], ...]
    phase: tuple[float, ...]

    @staticmethod
    def draw(width: int, size: int = RFF_SIZE, gamma: float = RFF_GAMMA, seed: int = RFF_SEED) -> Fourier:
        rng = np.random.default_rng(seed)
        omega = rng.normal(0.0, math.sqrt(2 * gamma), (size, width))
        return Fourier(tuple(map(tuple, omega.tolist())), tuple(rng.uniform(0, 2 * math.pi, size).tolist()))

    @staticmethod
    def formula(width: int, size: int) -> Fourier:
        """A projection by a closed formula of its indices, which SQL can follow."""
        return Fourier(tuple(tuple(math.sin(1.0 + 3 * j + 7 * f) for f in range(width)) for j in range(size)), tuple(1.0 + math.sin(5.0 * j) for j in range(size)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(j, list(o), p) for j, (o, p) in enumerate(zip(self.omega, self.phase, strict=True))], "j int, omega array<double>, phase double")

    @staticmethod
    def of(table: DataFrame, width: int, linear: LinearPairs) -> Fourier:
        """A stored projection, refused where it doesn't fit the features and the weights."""
        rows = table.orderBy("j").collect()  # a row for each random feature
        if not rows or len({len(r["omega"]) for r in rows}) > 1:
            raise ValueError("no projection, or one of unequal rows")
        out = Fourier(tuple(tuple(r["omega"]) for r in rows), tuple(r["phase"] for r in rows))
        out.check(width, linear)
        return out

    def check(self, width: int, linear: LinearPairs) -> None:
        if len(self.omega[0]) != width or len(linear.w[0]) != len(self.omega):
            raise ValueError(f"projection {len(self.omega)} x {len(self.omega[0])} doesn't fit {width} features and {len(linear.w[0])} weights")


def save(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").parquet(path)


def class_moments(rows: DataFrame, label: str = "label", features: str = "x", width: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and population variance vectors of each class: one aggregation, a row for each class."""
    width = width or rows.select(F.size(features).alias("n")).where("n >= 0").first()["n"]
    col = F.col(features)
    stats = rows.groupBy(label).agg(F.array(*(F.avg(col[k]) for k in range(width))).alias("m"), F.array(*(F.var_pop(col[k]) for k in range(width))).alias("v"))
    return {r[label]: (np.array(r["m"]), np.array(r["v"])) for r in stats.collect()}


def centroid_pairs(moments: dict[int, tuple[np.ndarray, np.ndarray]], pairs=PAIRS) -> LinearPairs:
    """Nearest centroid as one-vs-one: w = m_i - m_j, b = -(|m_i|^2 - |m_j|^2) / 2."""
    w = [moments[i][0] - moments[j][0] for i, j in pairs]
    b = [-(float(moments[i][0] @ moments[i][0]) - float(moments[j][0] @ moments[j][0])) / 2 for i, j in pairs]
    return LinearPairs(tuple(pairs), tuple(tuple(x.tolist()) for x in w), tuple(b))


def lda_pairs(moments: dict[int, tuple[np.ndarray, np.ndarray]], pairs=PAIRS) -> LinearPairs:
    """Diagonal discriminants: w = (m_i - m_j) / (v_i + v_j), b = -w . (m_i + m_j) / 2."""
    w = [(moments[i][0] - moments[j][0]) / (moments[i][1] + moments[j][1]) for i, j in pairs]
    b = [-float(x @ (moments[i][0] + moments[j][0])) / 2 for x, (i, j) in zip(w, pairs, strict=True)]
    return LinearPairs(tuple(pairs), tuple(tuple(x.tolist()) for x in w), tuple(b))


def prototype_kernel(rows: DataFrame, per_class: int = 5, gamma: float = RBF_GAMMA, key: str = "row_id") -> KernelPairs:
    """A kernel model whose support vectors are each class's first rows, weighted evenly."""
    from pyspark.sql import Window as W

    first = rows.where(F.col("label").isin(*TRAINED)).withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(key))).where(F.col("rn") <= per_class)
    by = {c: [] for c in TRAINED}
    for r in first.orderBy("label", "rn").collect():  # per_class rows of each class
        by[r["label"]].append(tuple(r["x"]))
    vectors = [(*by[i], *by[j]) for i, j in PAIRS]
    alphas = [(*([1 / len(by[i])] * len(by[i])), *([-1 / len(by[j])] * len(by[j]))) for i, j in PAIRS]
    return KernelPairs(PAIRS, tuple(vectors), tuple(alphas), (0.0,) * len(PAIRS), gamma)
