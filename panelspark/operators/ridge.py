"""Closed-form ridge for all folds from one pass over the rows.

Rows are never repeated per fold. Dates that play the same part in every fold form a
segment (a block, or its purged edge); each task reduces its rows to centred co-moments
per segment, which merge exactly like their rows would, and a fold's training moments are
merged from those of its segments. What reaches the solver is bounded by (folds x features squared), whatever
the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import shipped

STD_EPS = 1e-8


def segments(folds: DataFrame, held_out: str = "test") -> DataFrame:
    """(date, segment, train_in, held_in): folds in which each date trains or is held out."""
    def listed(role: str):
        return F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("fold"))))
    roles = folds.groupBy("date").agg(listed("train").alias("train_in"), listed(held_out).alias("held_in"))
    part = F.concat_ws("|", F.array_join("train_in", ","), F.array_join("held_in", ","))
    spec = Window.partitionBy(F.lit(0)).orderBy(part)  # one row per rebalance date
    return roles.withColumn("segment", F.dense_rank().over(spec).cast("long"))


@dataclass(frozen=True)
class Moments:
    """Count, means and centred products of some columns; two of them merge without losing digits to their means."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> "Moments":
        mean = values.mean(axis=0)
        off = values - mean
        # the mean is rounded; what is left over of it is taken out of the products too
        rest = off.mean(axis=0)
        return cls(len(values), mean + rest, off.T @ off - len(values) * np.outer(rest, rest))

    def merge(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * (other.n / n)))

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean.tolist(), "products": self.products.ravel().tolist()}


def _pairwise(parts: list[Moments]) -> Moments:
    """Merged two by two, so that rounding grows with the depth of the tree and not with the number of parts."""
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return parts[0]


def _read(frame: pd.DataFrame) -> list[Moments]:
    side = len(frame["mean"].iloc[0])
    return [Moments(int(n), np.asarray(m, float), np.asarray(p, float).reshape(side, side))
            for n, m, p in zip(frame["n"], frame["mean"], frame["products"])]


def co_moments(rows: DataFrame, key: str, columns: Sequence[str], fan_in: int = 64) -> DataFrame:
    """(key, n, mean, products): centred co-moments of the columns per key.

    Each task merges its Arrow batches into one record per key; keys are segments, of which there are a few
    dozen. Records of one key are merged in groups of about ``fan_in`` tasks and those once more, so no
    group holds a record of every task. Rows with a missing or not finite value in any column are left out.
    """
    shape = f"{key} long, part int, n long, mean array<double>, products array<double>"

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[Moments]] = {}
        for batch in batches:
            values, codes = batch[list(columns)].to_numpy("float64"), batch[key].to_numpy()
            fine = np.isfinite(values).all(axis=1)
            values, codes = values[fine], codes[fine]
            for code in np.unique(codes):
                stack = held.setdefault(int(code), [])
                stack.append(Moments.of(values[codes == code]))
                # like sizes merge first: the stack stays as short as the logarithm of the batches
                while len(stack) > 1 and stack[-2].n <= 2 * stack[-1].n:
                    stack[-2:] = [stack[-2].merge(stack[-1])]
        yield pd.DataFrame([{key: code, "part": TaskContext.get().partitionId() // fan_in, **_pairwise(stack[::-1]).row()}
                            for code, stack in held.items()], columns=[key, "part", "n", "mean", "products"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: frame[key].iloc[0], "part": frame["part"].iloc[0], **_pairwise(_read(frame)).row()}])

    shipped(rows.sparkSession)
    first = rows.select(key, *columns).mapInPandas(reduce_task, shape)
    middle = first.groupBy(key, "part").applyInPandas(merged, shape)
    return middle.withColumn("part", F.lit(0)).groupBy(key).applyInPandas(merged, shape).drop("part")


def _weights(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) on the raw feature scale; y is the last column, and the model has no constant of its own."""
    sd = np.sqrt(np.maximum(np.diag(m.products)[:-1] / m.n, 0.0)) + STD_EPS
    gram = m.products[:-1, :-1] / np.outer(sd, sd)
    w = np.linalg.solve(gram + alpha * np.eye(len(sd)), m.products[:-1, -1] / sd) / sd
    return w, -float(w @ m.mean[:-1])


def fit_folds(rows: DataFrame, roles: DataFrame, features: Sequence[str], alpha: float | DataFrame,
              y: str = "y") -> DataFrame:
    """(fold, alpha, intercept, weights) on the raw feature scale for every fold.

    ``rows`` has date, features and y; ``roles`` comes from :func:`segments` and has one
    row per rebalance date, which bounds its broadcast. ``alpha`` is a number or a table (fold, alpha), such
    as :func:`best_alpha` gives; a fold missing in it is not fitted.
    """
    tagged = rows.join(F.broadcast(roles.select("date", "segment")), "date")
    sums = co_moments(tagged, "segment", [*features, y])
    members = roles.select("segment", F.explode("train_in").alias("fold")).distinct()
    fixed = alpha if isinstance(alpha, DataFrame) else members.select("fold").distinct().withColumn("alpha", F.lit(float(alpha)))
    per_fold = sums.join(members, "segment").join(fixed.select("fold", "alpha"), "fold")

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        chosen = float(parts["alpha"].iloc[0])
        w, intercept = _weights(_pairwise(_read(parts.sort_values("segment"))), chosen)
        return pd.DataFrame({"fold": [parts["fold"].iloc[0]], "alpha": [chosen], "intercept": [intercept], "weights": [w.tolist()]})

    return per_fold.groupBy("fold").applyInPandas(solve, "fold int, alpha double, intercept double, weights array<double>")


def score_folds(rows: DataFrame, roles: DataFrame, models: DataFrame, features: Sequence[str],
                keep: Sequence[str] = ("date", "symbol", "y")) -> DataFrame:
    """Scores of every row in each fold that tests its date.

    One row per tested (row, fold) is the result itself. Models are one row per fold.
    """
    placed = rows.join(F.broadcast(roles.select("date", F.explode("held_in").alias("fold"))), "date")
    joined = placed.join(F.broadcast(models), "fold")
    score = F.col("intercept")
    for i, f in enumerate(features):
        score = score + F.col(f) * F.col("weights")[i]
    return joined.select("fold", *keep, score.alias("score"))


def alpha_path(rows: DataFrame, roles: DataFrame, features: Sequence[str], alphas: Sequence[float],
               y: str = "y") -> DataFrame:
    """(fold, alpha, mse): validation error of every alpha from the same sums.

    ``roles`` are the segments of an inner split with 'val' held out. The error of a
    linear model is a quadratic form in the validation co-moments, so no second pass over the
    rows is made. A fold without training or held-out rows has no error.
    """
    tagged = rows.join(F.broadcast(roles.select("date", "segment")), "date")
    sums = co_moments(tagged, "segment", [*features, y])
    parts = roles.select("segment", F.explode("train_in").alias("fold"), F.lit(0).alias("part")).unionByName(
        roles.select("segment", F.explode("held_in").alias("fold"), F.lit(1).alias("part"))).distinct()
    grid = [float(a) for a in alphas]

    def evaluate(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        held = frame[frame["part"] == 1]
        if held.empty or held.shape[0] == len(frame):
            return pd.DataFrame(columns=["fold", "alpha", "mse"])
        train, val = (_pairwise(_read(frame[frame["part"] == p])) for p in (0, 1))
        out = []
        for alpha in grid:
            w, intercept = _weights(train, alpha)
            v = np.append(w, -1.0)
            bias = float(v @ val.mean) + intercept
            out.append((int(frame["fold"].iloc[0]), alpha, float(v @ val.products @ v) / val.n + bias * bias))
        return pd.DataFrame(out, columns=["fold", "alpha", "mse"])

    return sums.join(parts, "segment").groupBy("fold").applyInPandas(evaluate, "fold int, alpha double, mse double")


def best_alpha(path: DataFrame) -> DataFrame:
    return path.groupBy("fold").agg(F.min_by("alpha", F.struct("mse", "alpha")).alias("alpha"))


def errors(scores: DataFrame, by: Sequence[str] = (), score: str = "score", y: str = "y") -> DataFrame:
    gap = F.col(score) - F.col(y)
    return scores.groupBy(*by).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"),
                                   F.count(F.lit(1)).alias("n"))
