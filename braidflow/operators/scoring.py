"""Pair scores, votes, margins, predictions and confidences, as expressions over one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidflow.functions.vectors import dot, literal, sqdist, total
from braidflow.operators.models import Fourier, KernelPairs, LinearPairs
from braidflow.operators.taxonomy import PAIRS, TRAINED, name_of

#: From this many multiplications a row on, a matrix product on Arrow batches beats the expression.
WIDE = 20_000


def linear_scores(model: LinearPairs, x: Column | str = "x") -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.array(*(dot(x, literal(w)) + F.lit(float(b)) for w, b in zip(model.w, model.b, strict=True)))


def kernel_scores(model: KernelPairs, x: Column | str = "x") -> Column:
    x = F.col(x) if isinstance(x, str) else x

    def one(vectors, alphas, b) -> Column:
        support = F.array(*(F.struct(literal(v).alias("v"), F.lit(float(a)).alias("a")) for v, a in zip(vectors, alphas, strict=True)))
        return total(F.transform(support, lambda s: s["a"] * F.exp(-F.lit(float(model.gamma)) * sqdist(x, s["v"])))) + F.lit(float(b))

    return F.array(*(one(*parts) for parts in zip(model.vectors, model.alphas, model.b, strict=True)))


def fourier_features(model: Fourier, x: Column | str = "x") -> Column:
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit((2 / len(model.omega)) ** 0.5)
    return F.array(*(scale * F.cos(dot(x, literal(o)) + F.lit(float(p))) for o, p in zip(model.omega, model.phase, strict=True)))


def score(rows: DataFrame, model: LinearPairs | KernelPairs, fourier: Fourier | None = None, features: str = "x") -> DataFrame:
    """Adds scores, one for each pair. Wide models are multiplied as matrices on Arrow batches."""
    if fourier and isinstance(model, LinearPairs):
        work = len(fourier.omega) * len(fourier.omega[0])
    elif isinstance(model, KernelPairs):
        work = sum(len(v) * len(v[0]) for v in model.vectors if v)
    else:
        work = len(model.w) * len(model.w[0])
    if work < WIDE:
        if isinstance(model, KernelPairs):
            return rows.withColumn("scores", kernel_scores(model, features))
        x = fourier_features(fourier, features) if fourier else F.col(features)
        return rows.withColumn("scores", linear_scores(model, x))

    shared = rows.sparkSession.sparkContext.broadcast((model, fourier))

    @F.pandas_udf("array<double>")
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, f = shared.value
        if isinstance(m, KernelPairs):
            kept = [(np.array(v), np.array(a), b) for v, a, b in zip(m.vectors, m.alphas, m.b, strict=True)]
        else:
            w, b = np.array(m.w).T, np.array(m.b)
        if f:
            omega, phase = np.array(f.omega).T, np.array(f.phase)
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            if f:
                x = np.sqrt(2 / omega.shape[1]) * np.cos(x @ omega + phase)
            if isinstance(m, KernelPairs):
                parts = []
                for v, a, bias in kept:
                    d = np.maximum((x * x).sum(1)[:, None] + (v * v).sum(1) - 2 * x @ v.T, 0)
                    parts.append(np.exp(-m.gamma * d) @ a + bias)
                out = np.stack(parts, 1)
            else:
                out = x @ w + b
            yield pd.Series(list(out))

    return rows.withColumn("scores", wide(F.col(features)))


def _ballots(scores: Column, at_zero_first: bool, weight) -> Column:
    """For each trained class the sum of weight(score) over the pairs that it wins."""

    def of(c: int) -> Column:
        terms = []
        for k, (pos, neg) in enumerate(PAIRS):
            if c not in (pos, neg):
                continue
            first = scores[k] >= 0 if at_zero_first else scores[k] > 0
            terms.append(F.when(first if c == pos else ~first, weight(scores[k])).otherwise(weight(scores[k]) * 0))
        return sum(terms[1:], terms[0])

    return F.array(*(of(c) for c in TRAINED))


def votes(scores: Column | str = "scores", at_zero_first: bool = True) -> Column:
    """Pairs won by each trained class. A score of zero is for the first class, or else for the second."""
    return _ballots(F.col(scores) if isinstance(scores, str) else scores, at_zero_first, lambda s: F.lit(1))


def margins(scores: Column | str = "scores", at_zero_first: bool = True) -> Column:
    """Sum of |score| over the pairs won by each trained class."""
    return _ballots(F.col(scores) if isinstance(scores, str) else scores, at_zero_first, F.abs)


def ballot(rows: DataFrame, at_zero_first: bool = True) -> DataFrame:
    return rows.withColumn("votes", votes("scores", at_zero_first)).withColumn("margins", margins("scores", at_zero_first))


def _best(keys: list[Column]) -> Column:
    """The place of the largest key; the first of equals."""
    best = F.lit(0)
    top = keys[0]
    for k in range(1, len(keys)):
        better = keys[k] > top
        best = F.when(better, k).otherwise(best)
        top = F.when(better, keys[k]).otherwise(top)
    return best


def predict(rule: str) -> Column:
    """The predicted class from votes and margins, ties to the lowest class.

    votes: most votes. vote_margin: most votes, then the largest margin. weighted: the largest
    1000 * votes + margin, which differs where margins differ by more than a thousand.
    """
    v, m = F.col("votes"), F.col("margins")
    places = range(len(TRAINED))
    if rule == "votes":
        best = F.array_position(v, F.array_max(v)) - 1
    elif rule == "vote_margin":
        key = F.transform(F.arrays_zip(v, m), lambda z: F.struct(z["votes"], z["margins"]))
        best = F.array_position(key, F.array_max(key)) - 1
    elif rule == "weighted":
        key = F.array(*(v[k] * 1000.0 + m[k] for k in places))
        best = F.array_position(key, F.array_max(key)) - 1
    else:
        raise ValueError(rule)
    return F.get(F.array(*map(F.lit, TRAINED)), best.cast("int"))


def confidence(kind: str, pred: Column | str = "pred") -> Column:
    """votes: the winner's votes / (K - 1). six: its votes / number of pairs. margin: its margin / its votes."""
    pred = F.col(pred) if isinstance(pred, str) else pred
    place = pred - F.lit(TRAINED[0]) if TRAINED == tuple(range(TRAINED[0], TRAINED[-1] + 1)) else F.array_position(F.array(*map(F.lit, TRAINED)), pred) - 1
    v = F.get("votes", place.cast("int"))
    if kind == "votes":
        return v / F.lit(float(len(TRAINED) - 1))
    if kind == "six":
        return v / F.lit(float(len(PAIRS)))
    if kind == "margin":
        return F.get("margins", place.cast("int")) / F.greatest(v, F.lit(1))
    raise ValueError(kind)


def one_vs_all(scores: Column | str = "scores") -> tuple[Column, Column]:
    """Where scores aren't pairs': the place of the largest, and the largest."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int"), F.array_max(s)


def score_map(margins_col: str = "margins") -> Column:
    """Class name -> margin."""
    return F.map_from_arrays(F.array(*(name_of(F.lit(c)) for c in TRAINED)), F.col(margins_col))


def confident(conf: Column, threshold: float, strict: bool = False) -> Column:
    """Batch scoring takes a confidence at the threshold as sure; serving (strict) doesn't."""
    return conf > threshold if strict else conf >= threshold
