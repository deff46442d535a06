"""Trainers of pair models.

Each pair's classifier is fitted in a grouped map, one group for each pair, on the balanced sample that
prep.balanced_pair bounds; the linear trainer can also run over all rows, one pass of partial gradient
sums for each step. Random draws come from numpy generators seeded by pair and epoch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidflow.operators.models import RBF_GAMMA, Fourier, KernelPairs, LinearPairs
from braidflow.operators.prep import balanced_pair
from braidflow.operators.registry import cosine_rate
from braidflow.operators.taxonomy import PAIRS

# Class weights of three trainers, by original class id.
CLASS_WEIGHTS = {
    "mpi": {2: 1.971, 3: 1.085, 4: 0.512, 5: 1.631},
    "openmp": {2: 1.4, 3: 1.1, 4: 0.55, 5: 1.3},
    "cuda": {2: 2.464, 3: 1.8, 4: 0.491, 5: 4.637},
}
EPOCHS, BATCH, PEAK, LEAST, L2 = 200, 512, 0.05, 0.001, 5e-4
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
SMO_C, SMO_STEPS = 10.0, 5000
SGD_ROUNDS, SGD_ROWS, SGD_KEEP, SGD_DECAY = 200, 500, 2000, 0.001


def pair_samples(rows: DataFrame, key: str = "row_id", most: int = 2500, pairs=PAIRS) -> DataFrame:
    """All pairs' balanced samples: pair, y, x."""
    parts = [balanced_pair(rows, "label", key, a, b, most).select(F.lit(k).alias("pair"), key, "y", "label", "x") for k, (a, b) in enumerate(pairs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0

    def step(self, w: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * g
        self.v = BETA2 * self.v + (1 - BETA2) * g * g
        return w - rate * (self.m / (1 - BETA1**self.t)) / (np.sqrt(self.v / (1 - BETA2**self.t)) + EPSILON)


def learning_rate(epoch: int, epochs: int = EPOCHS) -> float:
    return LEAST + 0.5 * (PEAK - LEAST) * (1 + np.cos(np.pi * epoch / epochs))


def hinge_gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float, float]:
    """Summed over the batch, not averaged: of w, of b, and the loss."""
    slack = 1 - y * (x @ w + b)
    hit = slack > 0
    pull = -(weight * y)[hit]
    return pull @ x[hit], float(pull.sum()), float((weight * np.maximum(slack, 0)).sum())


def train_linear(rows: DataFrame, weights: dict[int, float] | None = None, epochs: int = EPOCHS, pairs=PAIRS, most: int = 2500, batch: int = BATCH, whole_epochs: bool = False) -> LinearPairs:
    """Weighted hinge loss by Adam on mini-batches with replacement, one grouped task for each pair.

    An epoch is one batch, or with whole_epochs as many as the pair's rows fill, each with a step of its own.
    """
    return train_snapshots(rows, weights, epochs, epochs, pairs, most, batch, whole_epochs)[epochs]


def train_snapshots(rows: DataFrame, weights: dict[int, float] | None = None, epochs: int = EPOCHS, every: int = EPOCHS, pairs=PAIRS, most: int = 2500, batch: int = BATCH, whole_epochs: bool = False) -> dict[int, LinearPairs]:
    """The models after every more epochs of one run, by epoch."""
    weights = weights or CLASS_WEIGHTS["mpi"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_id")
        pair = int(group["pair"].iloc[0])
        x, y = np.stack(group["x"].to_numpy()), group["y"].to_numpy(float)
        weight = group["label"].map(weights).fillna(1.0).to_numpy()
        w, adam, out = np.zeros(x.shape[1] + 1), Adam(x.shape[1] + 1), []
        for epoch in range(epochs):
            rng = np.random.default_rng(pair * 1000 + epoch)
            for _ in range(max(1, len(x) // batch) if whole_epochs else 1):
                at = rng.integers(0, len(x), min(batch, len(x)))
                gw, gb, _ = hinge_gradient(x[at], y[at], weight[at], w[:-1], w[-1])
                w = adam.step(w, np.append(gw + L2 * w[:-1], gb), learning_rate(epoch, epochs))
            if (epoch + 1) % every == 0:
                out.append((pair, epoch + 1, w[:-1].tolist(), float(w[-1])))
        return pd.DataFrame(out, columns=["pair", "epoch", "w", "b"])

    found = pair_samples(rows, most=most, pairs=pairs).groupBy("pair").applyInPandas(fit, "pair int, epoch int, w array<double>, b double").collect()
    by = {(r["epoch"], r["pair"]): r for r in found}  # a row for each pair and snapshot
    model = lambda e: LinearPairs(tuple(pairs), tuple(tuple(by[e, k]["w"]) for k in range(len(pairs))), tuple(by[e, k]["b"] for k in range(len(pairs))))
    return {e: model(e) for e in sorted({e for e, _ in by})}


def gradient_sums(rows: DataFrame, model: LinearPairs, weights: dict[int, float], key: str = "label") -> DataFrame:
    """pair, place, gradient: the hinge gradients of all pairs summed over rows; the place after the last weight is the bias."""
    w = np.c_[np.array(model.w), np.array(model.b)]
    parts = rows.select(F.col(key).alias("label"), "x").mapInPandas(_partial(w, weights, model.pairs), "g array<double>")
    width = w.shape[1]
    summed = parts.select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("gradient"))
    return summed.select((F.col("k") / width).cast("int").alias("pair"), (F.col("k") % width).cast("int").alias("place"), "gradient")


def _partial(current: np.ndarray, weights: dict[int, float], pairs):
    def run(batches):
        g = np.zeros_like(current)
        for batch in batches:
            x, label = np.stack(batch["x"].to_numpy()), batch["label"].to_numpy()
            weight = pd.Series(label).map(weights).fillna(1.0).to_numpy()
            for k, (a, b) in enumerate(pairs):
                of = (label == a) | (label == b)
                gw, gb, _ = hinge_gradient(x[of], np.where(label[of] == a, 1.0, -1.0), weight[of], current[k, :-1], current[k, -1])
                g[k] += np.append(gw, gb)
        yield pd.DataFrame({"g": [g.ravel().tolist()]})

    return run


def train_linear_all(rows: DataFrame, weights: dict[int, float] | None = None, epochs: int = 20, pairs=PAIRS) -> LinearPairs:
    """The same loss over all rows: every step sums partial gradients of all tasks, for all pairs at once."""
    weights = weights or CLASS_WEIGHTS["mpi"]
    used = rows.where(F.col("label").isin(*{c for p in pairs for c in p})).select("label", "x")
    width = used.select(F.size("x").alias("n")).first()["n"]
    n = used.count()
    w, adam = np.zeros((len(pairs), width + 1)), Adam((len(pairs), width + 1))

    for epoch in range(epochs):
        g = np.zeros(w.shape)
        for r in gradient_sums(used, LinearPairs(tuple(pairs), w[:, :-1], w[:, -1]), weights).collect():  # a number for each weight
            g[r["pair"], r["place"]] = r["gradient"]
        g /= max(1, n)
        g[:, :-1] += L2 * w[:, :-1]
        w = adam.step(w, g, learning_rate(epoch, epochs))
    return LinearPairs(tuple(pairs), tuple(map(tuple, w[:, :-1].tolist())), tuple(w[:, -1].tolist()))


def train_validated(rows: DataFrame, held: DataFrame, rounds: int = 10, every: int = 20, min_delta: float = 1e-4, patience: int = 3) -> tuple[LinearPairs, LinearPairs, list[tuple]]:
    """Trains for every more epochs at a time and validates on rows of its own, never on test rows.

    Returns the final model, the best checkpoint by macro F1, and the log: epoch, rate, accuracy, macro_f1.
    Stops after patience validations without an improvement by more than min_delta.
    """
    from dataclasses import replace

    from braidflow.operators import hybrid, metrics, scoring

    best, last, log, top, since = None, None, [], float("-inf"), 0
    for epoch, model in train_snapshots(rows, epochs=rounds * every, every=every).items():
        last = replace(model, checkpoint="final")
        judged = hybrid.judge(scoring.score(held, last), hybrid.PROFILES["mpi"]).withColumn("final", F.col("pred"))
        f1 = metrics.macro_f1(judged, "trained").first()["macro_f1"]
        accuracy = metrics.rates(judged).first()["accuracy_strict"]
        log.append((epoch, learning_rate(epoch, rounds * every), accuracy, f1))
        if f1 > top + min_delta:
            best, top, since = replace(last, checkpoint="best"), f1, 0
        else:
            since += 1
            if since >= patience:
                break
    return last, best, log


def validation_clusters(judged: DataFrame, cap: int = 35_000, eps: float | None = None) -> DataFrame:
    """row_id, label, scores, votes, margins, pred, conf of validation rows -> one row: n_uncertain, n_clusters, n_noise.

    The rows whose confidence is under the first profile's threshold, up to the cap, are clustered as that profile does.
    """
    from braidflow.operators import hybrid
    from braidflow.operators.clustering import cluster_counts, dbscan
    from braidflow.operators.prep import first_rows

    p = hybrid.PROFILES["cuda"]
    unsure = first_rows(judged.where(F.col("conf") < p.threshold), "row_id", cap)
    points = unsure.select(F.col("row_id").alias("id"), hybrid.space(p).alias("v"))
    found = dbscan(points, eps or p.eps, p.min_samples, p.dims, p.strict, p.count_self)
    return cluster_counts(found).crossJoin(unsure.agg(F.count("*").alias("n_uncertain"))).select("n_uncertain", "n_clusters", "n_noise")  # one row


RFF_BATCH = 2048


def train_fourier(rows: DataFrame, fourier: Fourier, epochs: int = 50, most: int = 2500, batch: int = RFF_BATCH) -> LinearPairs:
    """The linear trainer on random Fourier features: whole epochs of larger batches, a step for each."""
    omega, phase = np.array(fourier.omega).T, np.array(fourier.phase)

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / omega.shape[1]) * np.cos(np.stack(x.to_numpy()) @ omega + phase)))

    return train_linear(rows.withColumn("x", features("x")), CLASS_WEIGHTS["cuda"], epochs, most=most, batch=batch, whole_epochs=True)


def _rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def smo(x: np.ndarray, y: np.ndarray, gamma: float, c: float = SMO_C, steps: int = SMO_STEPS, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Sequential minimal optimisation with the pair that violates most; dual weights times y, and the bias."""
    k = _rbf(x, x, gamma)
    alpha, grad = np.zeros(len(x)), -np.ones(len(x))
    for _ in range(steps):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        force = -y * grad
        i = int(np.argmax(np.where(up, force, -np.inf)))
        j = int(np.argmin(np.where(low, force, np.inf)))
        if force[i] - force[j] < tolerance:
            break
        step = (force[i] - force[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * y * (k[i] - k[j])
    up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
    low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
    force = -y * grad
    return alpha * y, float((force[up].max() + force[low].min()) / 2) if up.any() and low.any() else 0.0


def kernel_sgd(x: np.ndarray, y: np.ndarray, gamma: float, seed: int, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Rows whose margin is under one become support vectors; the largest stay. Weights by row, and the bias."""
    rng, alpha, bias = np.random.default_rng(seed), np.zeros(len(x)), 0.0
    k = _rbf(x, x, gamma)
    for epoch in range(SGD_ROUNDS):
        eta, moved = rate / (1 + rate * SGD_DECAY * epoch), False
        for i in rng.permutation(len(x))[:SGD_ROWS]:
            if y[i] * (k[i] @ alpha + bias) < 1:
                alpha[i] += eta * y[i]
                bias += 0.1 * eta * y[i]
                moved = True
        if (alpha != 0).sum() > SGD_KEEP:
            alpha[np.argsort(-np.abs(alpha), kind="stable")[SGD_KEEP:]] = 0
        if not moved and epoch > 10:
            break
    return alpha, bias


def train_kernel(rows: DataFrame, gamma: float = RBF_GAMMA, method: str = "smo", most: int = 2500) -> KernelPairs:
    """Kernel pair models, one grouped task for each pair; most bounds a task's kernel matrix."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_id")
        pair = int(group["pair"].iloc[0])
        x, y = np.stack(group["x"].to_numpy()), group["y"].to_numpy(float)
        alpha, bias = smo(x, y, gamma) if method == "smo" else kernel_sgd(x, y, gamma, 42 + pair)
        kept = np.flatnonzero(np.abs(alpha) > 1e-12)
        return pd.DataFrame({"ca": PAIRS[pair][0], "cb": PAIRS[pair][1], "sv_id": range(len(kept)), "sv": x[kept].tolist(), "alpha": alpha[kept], "bias": bias, "gamma": gamma})

    return KernelPairs.of(pair_samples(rows, most=most).groupBy("pair").applyInPandas(fit, "ca int, cb int, sv_id int, sv array<double>, alpha double, bias double, gamma double"))


def train_svc(rows: DataFrame, weights: dict[int, float] | None = None, pairs=PAIRS) -> LinearPairs:
    """Linear pair models by the library's distributed solver."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    weights = weights or CLASS_WEIGHTS["mpi"]
    weight = F.coalesce(*(F.when(F.col("label") == c, w) for c, w in weights.items()), F.lit(1.0))
    ready = rows.select("label", array_to_vector("x").alias("features"), weight.alias("weight"))
    w, b = [], []
    for a, c in pairs:
        of = ready.where(F.col("label").isin(a, c)).select("features", "weight", F.when(F.col("label") == a, 1.0).otherwise(0.0).alias("label"))
        fitted = LinearSVC(maxIter=50, regParam=1e-3, weightCol="weight").fit(of)
        w.append(tuple(fitted.coefficients.toArray().tolist()))
        b.append(float(fitted.intercept))
    return LinearPairs(tuple(pairs), tuple(w), tuple(b))


def rate_table(spark, epochs: int = EPOCHS) -> DataFrame:
    return spark.range(epochs).select(F.col("id").cast("int").alias("epoch"), F.round(cosine_rate(F.col("id"), epochs), 9).alias("rate"))


def principal_components(rows: DataFrame, n: int) -> DataFrame:
    """Adds pc: the centred vectors' first n principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.withColumn("_v", array_to_vector("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(ready).transform(ready)
    return PCA(k=n, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p")
