"""Linear panel models from sums over rows: a table of any size goes into one matrix of features x features.

Each task adds up its rows' outer products; the parts are summed by Spark and only the matrix comes to the driver. Models that need
weights go over the table once for each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.models import regressors as rg

#: The matrix is held by the driver; more features are refused.
MOST_FEATURES = 2_000
ROUNDS = 12


def added(rows: DataFrame, columns: list[str], per_batch: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of `per_batch` of their matrix, a vector of `size` numbers; rows with a null are left out.

    Tasks add up their batches, Spark adds up the tasks, and one vector comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            z = z[np.isfinite(z).all(axis=1)]
            if len(z):
                total += per_batch(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    parts = rows.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, "i int, v double")
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


#: Keys whose matrices a task holds before it passes them on.
HELD = 64


def keyed_moments(rows: DataFrame, features: list[str], target: str, key: str, sign: str) -> DataFrame:
    """`key, i, v`: for each key the sum of sign * z z' over its rows, flattened, where z is (1, features, target)."""
    size = len(features) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = np.repeat(np.array([*held], np.int32), size * size)
            values = np.concatenate([m.ravel() for m in held.values()]) if held else np.empty(0)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(size * size, dtype=np.int32), len(held))), pa.array(values)], names=[key, "i", "v"])

        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)])
            z = z[np.isfinite(z).all(axis=1)]
            for k in np.unique(z[:, -2]).astype(int):
                own = z[z[:, -2] == k]
                x = own[:, :-2]
                held[k] = held.get(k, np.zeros((size, size))) + (x.T * own[:, -1]) @ x
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    columns = [*(F.col(c).cast("double") for c in features), F.col(target).cast("double"), F.col(key).cast("double"), F.col(sign).cast("double")]
    return rows.select(*columns).mapInArrow(run, f"{key} int, i int, v double").groupBy(key, "i").agg(F.sum("v").alias("v"))


def gram(rows: DataFrame, features: list[str], target: str, weight: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The weighted sum of z z' over rows, where z is (1, features, target); rows with a null are left out."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    size = len(features) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)])
            z = z[np.isfinite(z).all(axis=1)]
            w = np.ones(len(z)) if weight is None or not len(z) else weight(z[:, 1:-1], z[:, -1])
            total += (z.T * w) @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    parts = rows.select(*(F.col(c).cast("double") for c in features), F.col(target).cast("double")).mapInArrow(run, "i int, v double")
    out = np.zeros(size * size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(size, size)


def centred(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """(n, mean of x, mean of y, x'x, x'y, y'y), the last three about the means."""
    n = g[0, 0]
    mx, my = g[0, 1:-1] / n, g[0, -1] / n
    return n, mx, my, g[1:-1, 1:-1] - n * np.outer(mx, mx), g[1:-1, -1] - n * mx * my, g[-1, -1] - n * my * my


def _with_intercept(b: np.ndarray, mx: np.ndarray, my: float) -> np.ndarray:
    return np.r_[my - mx @ b, b]


def ridge(g: np.ndarray, alpha: float) -> np.ndarray:
    _, mx, my, xx, xy, _ = centred(g)
    return _with_intercept(np.linalg.lstsq(xx + alpha * np.eye(len(mx)), xy, rcond=None)[0], mx, my)


def bayesian(g: np.ndarray, per_weight: bool = False) -> np.ndarray:
    """Evidence maximisation of noise and weight precisions, from the sums alone."""
    n, mx, my, xx, xy, yy = centred(g)
    tiny = 1e-6
    noise, prior, b = n / max(yy, 1e-12), np.ones(len(mx)), np.zeros(len(mx))
    for _ in range(300):
        cover = np.linalg.pinv(noise * xx + np.diag(prior))
        b = noise * cover @ xy
        known = 1 - prior * np.diag(cover)
        new = (known + 2 * tiny) / (b * b + 2 * tiny) if per_weight else np.full(len(b), (known.sum() + 2 * tiny) / (b @ b + 2 * tiny))
        new = np.minimum(new, 1e10)
        left = max(yy - 2 * b @ xy + b @ xx @ b, 1e-12)
        noise = (n - known.sum() + 2 * tiny) / (left + 2 * tiny)
        done = np.abs(new - prior).max() <= 1e-3 * prior.max()
        prior = new
        if done:
            break
    return _with_intercept(b, mx, my)


def pursuit(g: np.ndarray, most: int | None = None) -> np.ndarray:
    """Orthogonal matching pursuit from the sums: take the feature that explains most of what is left, refit, repeat."""
    _, mx, my, xx, xy, _ = centred(g)
    norm, chosen = np.sqrt(np.maximum(np.diag(xx), 1e-12)), []
    b = np.zeros(len(mx))
    for _ in range(most or max(1, len(mx) // 10)):
        score = np.abs(xy - xx @ b) / norm
        score[chosen] = -1
        chosen.append(int(score.argmax()))
        b = np.zeros(len(mx))
        b[chosen] = np.linalg.lstsq(xx[np.ix_(chosen, chosen)], xy[chosen], rcond=None)[0]
    return _with_intercept(b, mx, my)


def quantile(rows: DataFrame, features: list[str], target: str, q: float, alpha: float) -> np.ndarray:
    """Reweighted squares towards the pinball loss, one pass for each round."""
    g = gram(rows, features, target)
    b, scale = ridge(g, alpha), abs(g[0, -1] / g[0, 0])
    for _ in range(ROUNDS):

        def weight(x: np.ndarray, y: np.ndarray, b: np.ndarray = b) -> np.ndarray:
            r = y - b[0] - x @ b[1:]
            return np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), 1e-4 * (1 + scale))

        b = ridge(gram(rows, features, target, weight), alpha)
    return b


def passive_aggressive(rows: DataFrame, features: list[str], target: str, c: float, epsilon: float, max_iter: int) -> np.ndarray:
    """Online updates within each task, averaged over tasks by their rows."""
    size = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            z = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in batch.columns])
            z = z[np.isfinite(z).all(axis=1)]
            if len(z) > 1:
                predict = rg.passive_aggressive(z[:, :-1], z[:, -1], c, epsilon, max_iter)
                zero = predict(np.zeros((1, size - 1)))[0]
                total, n = total + len(z) * np.r_[zero, predict(np.eye(size - 1)) - zero], n + len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(np.r_[n, total])], names=["i", "v"])

    parts = rows.select(*(F.col(f).cast("double") for f in features), F.col(target).cast("double")).mapInArrow(run, "i int, v double")
    out = np.zeros(size + 1)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out[1:] / max(out[0], 1)


def elastic(g: np.ndarray, alpha: float, l1_ratio: float = 1.0, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on the sums, for squares / 2n + alpha * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2)."""
    n, mx, my, xx, xy, _ = centred(g)
    b, scale = np.zeros(len(mx)), np.diag(xx) / n
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            if scale[j] > 0:
                part = (xy[j] - xx[j] @ b) / n + scale[j] * b[j]
                new = np.sign(part) * max(abs(part) - alpha * l1_ratio, 0) / (scale[j] + alpha * (1 - l1_ratio))
                moved, b[j] = max(moved, abs(new - b[j]) * np.sqrt(scale[j])), new
        if moved <= 1e-9 * np.sqrt(max(g[-1, -1] / n, 1e-300)):
            break
    return _with_intercept(b, mx, my)


def solved(kind: str, g: np.ndarray, p: dict) -> np.ndarray:
    """The intercept and weights of a kind that needs the sums alone."""
    kinds = {
        "ridge": lambda: ridge(g, p.get("alpha", 1.0)), "bayesian-ridge": lambda: bayesian(g), "ard": lambda: bayesian(g, True), "omp": lambda: pursuit(g),
        "lasso": lambda: elastic(g, p["alpha"]), "elasticnet": lambda: elastic(g, p["alpha"], p["l1_ratio"]),
    }
    return kinds[kind]()


#: Kinds that are solved from one matrix of sums.
FROM_SUMS = ("ridge", "bayesian-ridge", "ard", "omp", "lasso", "elasticnet")


def fit(kind: str, rows: DataFrame, features: list[str], target: str, p: dict) -> np.ndarray:
    """The intercept and weights of a kind of linear model."""
    if kind == "quantile":
        return quantile(rows, features, target, p["quantile"], p["alpha"])
    if kind == "passive-aggressive":
        return passive_aggressive(rows, features, target, p["c"], p["epsilon"], p["max_iter"])
    return solved(kind, gram(rows, features, target), p)


KINDS = (*FROM_SUMS, "quantile", "passive-aggressive")
