"""Kernel ridge and support-vector regression for tables of any size: landmark features, and a solver whose rounds are one aggregate each.

The radial kernel is written by its values at landmarks, a bounded sample of training rows by hash, times the inverse root of the kernel
among them (Nystroem): with all rows as landmarks it is exact, with fewer the best fit in the span of the landmarks. The
epsilon-insensitive loss is smoothed over a width that shrinks from stage to stage, and Newton's steps sum up value, gradient and
curvature over the rows by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.models.gram import added

KINDS = ("kernel-ridge", "svr", "linear-svr")
#: Widths over which the loss is rounded, as shares of the target's spread, and Newton steps for each at most.
WIDTHS, STEPS = (1.0, 0.1, 0.01, 0.001), 30
#: Where a search along a step looks at once.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


class Landmarks:
    """Features of the radial kernel exp(-gamma |a - b|^2) at landmarks."""

    def __init__(self, points: np.ndarray, gamma: float):
        self.points, self.gamma = points, gamma
        values, vectors = np.linalg.eigh(self.kernel(points))
        keep = values > 1e-12 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1)[None] - 2 * x @ self.points.T
        return np.exp(-self.gamma * np.maximum(square, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.root


def landmarks(rows: DataFrame, features: list[str], many: int, gamma: float) -> Landmarks:
    """At most `many` rows, those of the least hashes; equal rows count once."""
    plain = rows.select(*(F.col(c).cast("double").alias(c) for c in features)).dropna().distinct()
    found = plain.orderBy(F.xxhash64(*features), *features).limit(many).collect()
    return Landmarks(np.array([list(r) for r in found], float), gamma)


def _spread(rows: DataFrame, features: list[str], target: str) -> tuple[float, float, np.ndarray]:
    """(rows, the target's standard deviation, sums of x, x^2 over all features)."""
    total = added(rows, [*features, target], lambda z: np.array([len(z), z[:, -1].sum(), (z[:, -1] ** 2).sum(), z[:, :-1].sum(), (z[:, :-1] ** 2).sum()]), 5)
    n = max(total[0], 1)
    return n, float(np.sqrt(max(total[2] / n - (total[1] / n) ** 2, 0))), np.array([total[3] / (n * len(features)), total[4] / (n * len(features))])


def kernel_ridge(rows: DataFrame, features: list[str], target: str, phi: Callable[[np.ndarray], np.ndarray], size: int, alpha: float) -> np.ndarray:
    """Weights of the features phi under squares + alpha * |w|^2, without a constant."""

    def sums(z: np.ndarray) -> np.ndarray:
        f = phi(z[:, :-1])
        return np.concatenate([(f.T @ f).ravel(), f.T @ z[:, -1]])

    total = added(rows, [*features, target], sums, size * size + size)
    return np.linalg.solve(total[: size * size].reshape(size, size) + alpha * np.eye(size), total[size * size :])


def rounded_loss(r: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, |r| - epsilon), rounded by a parabola over `width`: value, slope and curvature."""
    over = np.maximum(np.abs(r) - epsilon, 0)
    inside = over < width
    return np.where(inside, over**2 / (2 * width), over - width / 2), np.sign(r) * np.where(inside, over / width, 1.0), np.where(inside & (over > 0), 1 / width, 0.0)


def support_vectors(rows: DataFrame, features: list[str], target: str, phi: Callable[[np.ndarray], np.ndarray], size: int, c: float, epsilon: float, spread: float, free_constant: bool) -> np.ndarray:
    """(constant, weights) of least |w|^2 / 2 + c * sum of max(0, |y - b - w phi| - epsilon); the constant is free, or counted in |w|."""
    d = size + 1
    penalty = np.r_[0.0 if free_constant else 1.0, np.ones(size)]
    w = np.zeros(d)
    columns = [*features, target]
    design = lambda z: np.column_stack([np.ones(len(z)), phi(z[:, :-1])])
    w[0] = added(rows, columns, lambda z: np.array([len(z), z[:, -1].sum()]), 2)[1] / max(1.0, added(rows, columns, lambda z: np.array([float(len(z))]), 1)[0])
    for share in WIDTHS:
        width = share * max(spread, 1e-12)
        for _ in range(STEPS):

            def parts(z: np.ndarray, w: np.ndarray = w, width: float = width) -> np.ndarray:
                x = design(z)
                value, slope, curve = rounded_loss(z[:, -1] - x @ w, epsilon, width)
                return np.concatenate([[value.sum()], -(x.T @ slope), ((x.T * curve) @ x).ravel()])

            total = added(rows, columns, parts, 1 + d + d * d)
            value = c * total[0] + (penalty * w) @ w / 2
            gradient = c * total[1 : 1 + d] + penalty * w
            curvature = c * total[1 + d :].reshape(d, d) + np.diag(penalty)
            # A point with no row on the rounded part has no curvature: a small share of the mean keeps the step finite.
            step = -np.linalg.solve(curvature + 1e-9 * (1 + np.trace(curvature) / d) * np.eye(d), gradient)
            lengths = np.array(LENGTHS)

            def along(z: np.ndarray, w: np.ndarray = w, step: np.ndarray = step, width: float = width, lengths: np.ndarray = lengths) -> np.ndarray:
                x = design(z)
                return rounded_loss((z[:, -1] - x @ w)[:, None] - (x @ step)[:, None] * lengths, epsilon, width)[0].sum(axis=0)

            tried = np.array([w + t * step for t in lengths])
            values = c * added(rows, columns, along, len(lengths)) + (penalty * tried * tried).sum(axis=1) / 2
            best = int(values.argmin())
            if values[best] >= value * (1 - 1e-10):
                break
            w = tried[best]
    return w


class Fitted:
    """Weights over features of the rows themselves or of landmarks; called with windows it adds `yhat`."""

    def __init__(self, features: list[str], weights: np.ndarray, phi: Landmarks | None = None):
        self.features, self.weights, self.phi = features, weights, phi

    def state(self) -> dict[str, Any]:
        """What there is to keep, as plain lists."""
        marks = {"plain": True} if self.phi is None else {"points": self.phi.points.tolist(), "gamma": self.phi.gamma}
        return {"weights": self.weights.tolist(), **marks}

    @classmethod
    def of(cls, features: list[str], state: dict[str, Any]) -> Fitted:
        return cls(features, np.asarray(state["weights"]), None if "plain" in state else Landmarks(np.asarray(state["points"]), state["gamma"]))

    def __call__(self, frame: DataFrame) -> DataFrame:
        features, weights, phi = self.features, self.weights, self.phi

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))])
                kept = batch.schema.names[: -len(features)]
                yhat = weights[0] + (x if phi is None else phi(x)) @ weights[1:] if len(x) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(yhat, from_pandas=True)], names=[*kept, "yhat"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        return frame.select("*", *(F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features))).mapInArrow(run, f"{fields}, yhat double")


def fit(kind: str, rows: DataFrame, features: list[str], target: str, p: dict[str, Any]) -> Fitted:
    """A fit that adds `yhat`. `gamma` None or "auto" is one over the number of features, "scale" also over their variance."""
    n, spread, moments = _spread(rows, features, target)
    marks = None
    if kind == "linear-svr":
        phi, size = (lambda x: x), len(features)
    else:
        variance = max(moments[1] - moments[0] ** 2, 1e-300)
        gamma = {"None": 1 / len(features), "auto": 1 / len(features), "scale": 1 / (len(features) * variance)}.get(str(p["gamma"]), p["gamma"])
        phi = marks = landmarks(rows, features, p["landmarks"], float(gamma))
        size = phi.root.shape[1]
    if kind == "kernel-ridge":
        weights = np.r_[0.0, kernel_ridge(rows, features, target, phi, size, p["alpha"])]
    else:
        weights = support_vectors(rows, features, target, phi, size, p["c"], p["epsilon"], spread, kind == "svr")
    return Fitted(features, weights, marks)
