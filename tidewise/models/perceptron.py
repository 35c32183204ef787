"""A multilayer perceptron for tables of any size: one parameter vector, and gradients that Spark adds up over all rows.

Layers of rectified linear units on standardised features, squared error with a penalty on the weights. Each step is one of limited-memory
quasi-Newton descent: a pass over the table for value and gradient, a pass for the values at several lengths along the step. Seeded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.models.gram import added

#: Steps whose curvature is remembered, and lengths that are tried along a step.
MEMORY = 10
LENGTHS = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


class Network:
    """Sizes of the layers; parameters are one vector of weights and constants, layer by layer."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        self.shapes = [(a, b) for a, b in zip(self.sizes, self.sizes[1:], strict=False)]
        self.size = sum(a * b + b for a, b in self.shapes)
        self.penal = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in self.shapes])

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.r_[rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)] for a, b in self.shapes])

    def layers(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for a, b in self.shapes:
            yield w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]
            at += a * b + b

    def outputs(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The values of every layer, the input first."""
        out, last = [x], len(self.shapes) - 1
        for k, (m, c) in enumerate(self.layers(w)):
            z = out[-1] @ m + c
            out.append(z if k == last else np.maximum(z, 0))
        return out

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.outputs(w, x)[-1][:, 0]

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the sum of squares and its gradient."""
        values = self.outputs(w, x)
        back = values[-1] - y[:, None]
        parts: list[np.ndarray] = []
        for k in range(len(self.shapes) - 1, -1, -1):
            m, _ = list(self.layers(w))[k]
            parts.append(np.r_[(values[k].T @ back).ravel(), back.sum(axis=0)])
            back = (back @ m.T) * (values[k] > 0)
        return float(((values[-1][:, 0] - y) ** 2).sum() / 2), np.concatenate(parts[::-1])


class Fitted:
    def __init__(self, features: list[str], network: Network, w: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.features, self.network, self.w, self.centre, self.scale = features, network, w, centre, scale

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre[:-1]) / self.scale[:-1]

    def __call__(self, frame: DataFrame) -> DataFrame:
        features = self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))])
                kept = batch.schema.names[: -len(features)]
                yhat = self.centre[-1] + self.scale[-1] * self.network.predict(self.w, self.standard(x)) if len(x) else np.empty(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(yhat, from_pandas=True)], names=[*kept, "yhat"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        return frame.select("*", *(F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features))).mapInArrow(run, f"{fields}, yhat double")


def descend(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], values: Callable[[list[np.ndarray]], np.ndarray], w: np.ndarray, steps: int, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton descent; `values` gives the objective at several points in one pass."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    value, gradient = value_and_gradient(w)
    for _ in range(steps):
        q, used = gradient.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            q -= a * y
            used.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        step = -q if past else -gradient / max(np.abs(gradient).sum(), 1e-300)
        tried = [w + t * step for t in LENGTHS]
        found = values(tried)
        best = int(np.nanargmin(found))
        if not found[best] < value * (1 - tolerance):
            break
        new, (value, fresh) = tried[best], value_and_gradient(tried[best])
        if (fresh - gradient) @ (new - w) > 1e-12 * np.abs(value):
            past = [*past, (new - w, fresh - gradient)][-MEMORY:]
        w, gradient = new, fresh
    return w


def fit(rows: DataFrame, features: list[str], target: str, hidden: Sequence[int], alpha: float, max_iter: int, seed: int) -> Fitted:
    """The objective is mean squared error / 2 + alpha / 2n * |weights|^2, all standardised."""
    if not hidden or min(hidden) < 1:
        raise ValueError("hidden layers need at least one unit each")
    columns, d = [*features, target], len(features) + 1
    total = added(rows, columns, lambda z: np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)]), 1 + 2 * d)
    n = max(total[0], 1.0)
    centre = total[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(total[1 + d :] / n - centre**2, 0))
    out = Fitted(features, Network([len(features), *hidden, 1]), np.empty(0), centre, np.where(scale > 1e-12 * (1 + np.abs(centre)), scale, 1.0))
    network = out.network

    def split(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return out.standard(z[:, :-1]), (z[:, -1] - out.centre[-1]) / out.scale[-1]

    def both(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(z: np.ndarray) -> np.ndarray:
            loss, gradient = network.loss_and_gradient(w, *split(z))
            return np.r_[loss, gradient]

        found = added(rows, columns, sums, 1 + network.size)
        return (found[0] + alpha / 2 * (network.penal * w) @ w) / n, (found[1:] + alpha * network.penal * w) / n

    def values(points: list[np.ndarray]) -> np.ndarray:
        def sums(z: np.ndarray) -> np.ndarray:
            x, y = split(z)
            return np.array([((network.predict(w, x) - y) ** 2).sum() / 2 for w in points])

        return (added(rows, columns, sums, len(points)) + np.array([alpha / 2 * (network.penal * w) @ w for w in points])) / n

    out.w = descend(both, values, network.start(seed), max_iter)
    return out
