"""Small regressors for lag models of one series, by numpy alone, and the lag strategies around them.

Each is `fit(x, y, **params) -> predict`, where predict maps a matrix to a vector. Trees split on least squared error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tidewise.functions.features import lag_steps
from tidewise.models.kernels import _enough, lag_matrix

Predict = Callable[[np.ndarray], np.ndarray]


def _linear(weights: np.ndarray, link: Callable[[np.ndarray], np.ndarray] | None = None) -> Predict:
    return lambda x: (link or (lambda v: v))(weights[0] + x @ weights[1:])


def ols(x: np.ndarray, y: np.ndarray) -> Predict:
    return _linear(np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0])


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, weight: np.ndarray | None = None) -> Predict:
    """Penalised squares, the intercept free."""
    w = np.ones(len(x)) if weight is None else weight
    mx, my = np.average(x, 0, w), np.average(y, weights=w)
    a = (x - mx).T * w
    b = np.linalg.lstsq(a @ (x - mx) + alpha * np.eye(x.shape[1]), a @ (y - my), rcond=None)[0]
    return _linear(np.r_[my - mx @ b, b])


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.001, l1_ratio: float = 0.5, max_iter: int = 5000) -> Predict:
    """Coordinate descent on half the mean squared error plus the penalties."""
    n, mx, my = len(x), x.mean(0), y.mean()
    a, left, b = x - mx, y - my, np.zeros(x.shape[1])
    size = (a * a).sum(0) / n
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(size):
            rho = a[:, j] @ left / n + size[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (size[j] + alpha * (1 - l1_ratio))
            if new != b[j]:
                left = left - a[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= 1e-7 * max(1.0, np.abs(b).max()):
            break
    return _linear(np.r_[my - mx @ b, b])


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.001, max_iter: int = 5000) -> Predict:
    return elastic_net(x, y, alpha, 1.0, max_iter)


def huber(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, alpha: float = 0.0001, max_iter: int = 200) -> Predict:
    """Reweighted squares: residuals beyond epsilon robust deviations weigh less."""
    predict = ridge(x, y, alpha)
    before = predict(x)
    for _ in range(max_iter):
        r = y - before
        scale = 1.4826 * np.median(np.abs(r - np.median(r))) or 1e-9
        predict = ridge(x, y, alpha, np.minimum(1.0, epsilon * scale / np.maximum(np.abs(r), 1e-12)))
        now = predict(x)
        done = np.abs(now - before).max() <= 1e-8 * max(1.0, np.abs(now).max())
        before = now
        if done:
            break
    return predict


def quantile(x: np.ndarray, y: np.ndarray, quantile: float = 0.5, alpha: float = 0.0) -> Predict:
    """Reweighted squares towards the pinball loss."""
    predict = ridge(x, y, alpha)
    for _ in range(60):
        r = y - predict(x)
        predict = ridge(x, y, alpha, np.where(r >= 0, quantile, 1 - quantile) / np.maximum(np.abs(r), 1e-6 * (1 + np.abs(y).mean())))
    return predict


def bayesian_ridge(x: np.ndarray, y: np.ndarray, alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6, lambda_2: float = 1e-6, per_weight: bool = False) -> Predict:
    """Evidence maximisation of noise and weight precisions; one precision for each weight with `per_weight`."""
    n, mx, my = len(x), x.mean(0), y.mean()
    a, t = x - mx, y - my
    noise, prior = 1 / (t.var() + 1e-12), np.ones(x.shape[1])
    for _ in range(300):
        cover = np.linalg.pinv(noise * a.T @ a + np.diag(prior))
        b = noise * cover @ a.T @ t
        known = 1 - prior * np.diag(cover)
        new = (known + 2 * lambda_1) / (b * b + 2 * lambda_2) if per_weight else np.full(len(b), (known.sum() + 2 * lambda_1) / (b @ b + 2 * lambda_2))
        new = np.minimum(new, 1e10)
        noise = (n - known.sum() + 2 * alpha_1) / (((t - a @ b) ** 2).sum() + 2 * alpha_2)
        done = np.abs(new - prior).max() <= 1e-3 * prior.max()
        prior = new
        if done:
            break
    return _linear(np.r_[my - mx @ b, b])


def ard(x: np.ndarray, y: np.ndarray) -> Predict:
    return bayesian_ridge(x, y, per_weight=True)


def omp(x: np.ndarray, y: np.ndarray, n_nonzero_coefs: int | None = None) -> Predict:
    """Orthogonal matching pursuit: take the column that explains most of what is left, refit, repeat."""
    mx, my = x.mean(0), y.mean()
    a, t = x - mx, y - my
    norm = np.sqrt((a * a).sum(0)) + 1e-12
    chosen: list[int] = []
    b, left = np.zeros(x.shape[1]), t
    for _ in range(n_nonzero_coefs or max(1, x.shape[1] // 10)):
        score = np.abs(a.T @ left) / norm
        score[chosen] = -1
        chosen.append(int(score.argmax()))
        own = np.linalg.lstsq(a[:, chosen], t, rcond=None)[0]
        left = t - a[:, chosen] @ own
    b[chosen] = own
    return _linear(np.r_[my - mx @ b, b])


def passive_aggressive(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.1, max_iter: int = 1000) -> Predict:
    """Online updates just large enough to bring each error within epsilon, at most c; data are standardised."""
    mx, sx, my, sy = x.mean(0), x.std(0) + 1e-12, y.mean(), y.std() + 1e-12
    a, t, b = np.column_stack([np.ones(len(x)), (x - mx) / sx]), (y - my) / sy, np.zeros(x.shape[1] + 1)
    before = np.inf
    for _ in range(max_iter):
        loss = 0.0
        for row, target in zip(a, t, strict=True):
            error = target - row @ b
            if (over := abs(error) - epsilon) > 0:
                b, loss = b + np.sign(error) * min(c, over / (row @ row)) * row, loss + over
        if loss > before - 1e-3:
            break
        before = loss
    own = b[1:] / sx * sy
    return _linear(np.r_[my + sy * b[0] - mx @ own, own])


def knn(x: np.ndarray, y: np.ndarray, n_neighbors: int = 10, weights: str = "distance") -> Predict:
    def predict(q: np.ndarray) -> np.ndarray:
        out = []
        for row in q:
            gap = np.sqrt(((x - row) ** 2).sum(1))
            near = np.argsort(gap, kind="stable")[:n_neighbors]
            same = near[gap[near] == 0]
            out.append(y[near].mean() if weights == "uniform" else y[same].mean() if len(same) else np.average(y[near], weights=1 / gap[near]))
        return np.array(out)

    return predict


def kernel_ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, gamma: float | None = None) -> Predict:
    gamma = gamma or 1 / x.shape[1]
    kernel = lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    dual = np.linalg.solve(kernel(x, x) + alpha * np.eye(len(x)), y)
    return lambda q: kernel(q, x) @ dual


def _glm(power: float) -> Callable[..., Predict]:
    def fit(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, max_iter: int = 100) -> Predict:
        """Log-link regression with variance mean^power, by reweighted squares on standardised features."""
        if (y < 0).any() or (power >= 2 and (y <= 0).any()):
            raise ValueError("needs non-negative values, and positive ones for a gamma family")
        mx, sx = x.mean(0), x.std(0) + 1e-12
        a, b = np.column_stack([np.ones(len(x)), (x - mx) / sx]), np.zeros(x.shape[1] + 1)
        b[0] = np.log(max(y.mean(), 1e-9))
        penalty = np.diag(np.r_[0.0, np.full(x.shape[1], alpha * len(x) * max(y.mean(), 1e-9) ** (2 - power))])
        for _ in range(max_iter):
            mu = np.exp(np.clip(a @ b, -30, 30))
            w = np.maximum(mu ** (2 - power), 1e-9)
            new = np.linalg.lstsq((a.T * w) @ a + penalty, (a.T * w) @ (a @ b + (y - mu) / mu), rcond=None)[0]
            done = np.abs(new - b).max() < 1e-8
            b = new
            if done:
                break
        own = b[1:] / sx
        return _linear(np.r_[b[0] - mx @ own, own], lambda v: np.exp(np.clip(v, -30, 30)))

    return fit


def sgd(x: np.ndarray, y: np.ndarray, alpha: float = 0.0001, max_iter: int = 2000, random_state: int = 0) -> Predict:
    """Stochastic gradient steps on squared error with a falling rate; data are standardised. Ends when five epochs in a row move
    no weight by more than 1e-6."""
    rng = np.random.default_rng(random_state)
    mx, sx, my, sy = x.mean(0), x.std(0) + 1e-12, y.mean(), y.std() + 1e-12
    a, t, b = np.column_stack([np.ones(len(x)), (x - mx) / sx]), (y - my) / sy, np.zeros(x.shape[1] + 1)
    k = still = 0
    for _ in range(max_iter):
        before = b
        for i in rng.permutation(len(a)):
            k += 1
            b = b - 0.01 / k**0.25 * ((a[i] @ b - t[i]) * a[i] + alpha * np.r_[0, b[1:]])
        still = still + 1 if np.abs(b - before).max() <= 1e-6 else 0
        if still == 5:
            break
    own = b[1:] / sx * sy
    return _linear(np.r_[my + sy * b[0] - mx @ own, own])


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int, rng: np.random.Generator | None) -> tuple[int, float] | None:
    """The column and threshold that leave the least squared error, all columns at once; a random threshold for each column with `rng`."""
    v, n = x[:, columns], len(y)
    if rng is not None:
        at = rng.uniform(v.min(0), v.max(0))
        left = v <= at
        count, total, squares = left.sum(0), y @ left, (y * y) @ left
    else:
        order = np.argsort(v, axis=0, kind="stable")
        v, t = np.take_along_axis(v, order, 0), y[order]
        count, total, squares = np.arange(1, n)[:, None], np.cumsum(t, 0)[:-1], np.cumsum(t * t, 0)[:-1]
        at = (v[1:] + v[:-1]) / 2
    right = n - count
    error = squares - total**2 / np.maximum(count, 1) + (y @ y - squares) - (y.sum() - total) ** 2 / np.maximum(right, 1)
    error = np.where((count >= least) & (right >= least) & ((v[1:] > v[:-1]) if rng is None else (v.max(0) > v.min(0))), error, np.inf)
    # Of equal ones the first column, then the lowest threshold.
    k = int(error.T.argmin())
    if not np.isfinite(error.T.flat[k]):
        return None
    return int(columns[k // len(error) if rng is None else k]), float(at.T.flat[k])


def tree(x: np.ndarray, y: np.ndarray, max_depth: int | None = 5, least: int = 1, share: float = 1.0, rng: np.random.Generator | None = None, random_cuts: bool = False) -> Predict:
    def grow(rows: np.ndarray, depth: int):  # noqa: ANN202
        if (max_depth is not None and depth >= max_depth) or len(rows) < 2 * least or np.ptp(y[rows]) == 0:
            return float(y[rows].mean())
        columns = np.arange(x.shape[1]) if rng is None or share >= 1 else rng.choice(x.shape[1], max(1, int(share * x.shape[1])), replace=False)
        found = _split(x[rows], y[rows], columns, least, rng if random_cuts else None)
        if found is None:
            return float(y[rows].mean())
        left = x[rows, found[0]] <= found[1]
        if left.all() or not left.any():
            return float(y[rows].mean())
        return (*found, grow(rows[left], depth + 1), grow(rows[~left], depth + 1))

    root = grow(np.arange(len(x)), 0)

    def one(row: np.ndarray) -> float:
        node = root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return lambda q: np.array([one(r) for r in q])


def _forest(bootstrap: float, share: float, random_cuts: bool) -> Callable[..., Predict]:
    def fit(x: np.ndarray, y: np.ndarray, n_estimators: int = 200, random_state: int = 0, max_depth: int | None = None) -> Predict:
        """The mean of trees grown on random rows, columns or cuts."""
        rng = np.random.default_rng(random_state)
        trees = []
        for _ in range(n_estimators):
            rows = rng.integers(0, len(x), max(1, int(bootstrap * len(x)))) if bootstrap else np.arange(len(x))
            trees.append(tree(x[rows], y[rows], max_depth, 1, share, rng, random_cuts))
        return lambda q: np.mean([t(q) for t in trees], axis=0)

    return fit


def boosting(x: np.ndarray, y: np.ndarray, n_estimators: int = 200, learning_rate: float = 0.05, max_depth: int = 3) -> Predict:
    """Trees fitted one after another to what is left, each shrunk."""
    base, left, trees = float(y.mean()), y - y.mean(), []
    for _ in range(n_estimators):
        trees.append(tree(x, left, max_depth))
        left = left - learning_rate * trees[-1](x)
    return lambda q: base + learning_rate * sum(t(q) for t in trees)


def linear_svr(x: np.ndarray, y: np.ndarray, C: float = 1.0, epsilon: float = 0.0, max_iter: int = 5000, random_state: int = 0) -> Predict:  # noqa: N803
    """Support vector regression by a line: dual coordinates one after another, the constant penalised like a weight."""
    rng, a = np.random.default_rng(random_state), np.column_stack([np.ones(len(x)), x])
    size, dual, w = (a * a).sum(1), np.zeros(len(a)), np.zeros(a.shape[1])
    for _ in range(max_iter):
        moved = 0.0
        for i in rng.permutation(len(a)):
            off = a[i] @ w - y[i]
            best = dual[i] - off / size[i]
            new = min(C, max(-C, np.sign(best) * max(abs(best) - epsilon / size[i], 0.0)))
            if new != dual[i]:
                w = w + (new - dual[i]) * a[i]
                # What a step changes in the row's own forecast; duals themselves are small where features are large.
                moved, dual[i] = max(moved, abs(new - dual[i]) * size[i]), new
        if moved <= 1e-6 * (1 + np.abs(y).mean()):
            break
    return _linear(w)


def svr(x: np.ndarray, y: np.ndarray, C: float = 1.0, gamma: float | str = "scale", epsilon: float = 0.1) -> Predict:  # noqa: N803
    """Support vector regression with a Gaussian kernel: dual coordinates, and between rounds the constant that halves the residuals."""
    rate = 1 / (x.shape[1] * (x.var() or 1.0)) if gamma == "scale" else 1 / x.shape[1] if gamma == "auto" else float(gamma)
    kernel = lambda a, b: np.exp(-rate * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    k, dual = kernel(x, x), np.zeros(len(x))
    value, level = np.zeros(len(x)), float(np.median(y))
    for _ in range(200):
        moved = 0.0
        for i in range(len(x)):
            best = dual[i] - (value[i] + level - y[i])
            new = min(C, max(-C, np.sign(best) * max(abs(best) - epsilon, 0.0)))
            if new != dual[i]:
                value = value + (new - dual[i]) * k[:, i]
                moved, dual[i] = max(moved, abs(new - dual[i])), new
        before, level = level, float(np.median(y - value))
        if moved <= 1e-4 * C and abs(level - before) <= 1e-6 * max(1.0, abs(level)):
            break
    return lambda q: kernel(q, x) @ dual + level


def mlp(x: np.ndarray, y: np.ndarray, hidden_layer_sizes: tuple[int, ...] = (64, 64), alpha: float = 0.0001, max_iter: int = 300, random_state: int = 0, learning_rate_init: float = 0.001) -> Predict:
    """Layers of rectified sums, by Adam on batches of up to 200 rows; data are standardised. Ends when ten epochs bring nothing."""
    rng = np.random.default_rng(random_state)
    mx, sx, my, sy = x.mean(0), x.std(0) + 1e-12, y.mean(), y.std() + 1e-12
    a, t, sizes = (x - mx) / sx, (y - my) / sy, [x.shape[1], *hidden_layer_sizes, 1]
    w = [rng.uniform(-1, 1, (m, n)) * np.sqrt(6 / (m + n)) for m, n in zip(sizes, sizes[1:], strict=False)] + [np.zeros(n) for n in sizes[1:]]
    layers, first, second, steps = len(sizes) - 1, [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0

    def forward(q: np.ndarray) -> list[np.ndarray]:
        out = [q]
        for i in range(layers):
            q = out[-1] @ w[i] + w[layers + i]
            out.append(np.maximum(q, 0) if i < layers - 1 else q)
        return out

    best, still = np.inf, 0
    for _ in range(max_iter):
        order, loss = rng.permutation(len(a)), 0.0
        for rows in np.array_split(order, -(-len(a) // 200)):
            out = forward(a[rows])
            back = (out[-1][:, 0] - t[rows])[:, None] / len(rows)
            loss += float((back**2).sum()) * len(rows) / 2
            slopes = [np.zeros(0)] * len(w)
            for i in range(layers - 1, -1, -1):
                slopes[i], slopes[layers + i] = out[i].T @ back + alpha * w[i] / len(rows), back.sum(0)
                back = (back @ w[i].T) * (out[i] > 0)
            steps += 1
            for i, g in enumerate(slopes):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - learning_rate_init * (first[i] / (1 - 0.9**steps)) / (np.sqrt(second[i] / (1 - 0.999**steps)) + 1e-8)
        still = still + 1 if loss > best - 1e-4 else 0
        best = min(best, loss)
        if still == 10:
            break
    return lambda q: my + sy * forward((q - mx) / sx)[-1][:, 0]


def adaboost(x: np.ndarray, y: np.ndarray, n_estimators: int = 300, learning_rate: float = 0.05, random_state: int = 0) -> Predict:
    """Trees of three levels on rows drawn by weight; rows that a tree gets wrong weigh more for the next, and the weighted median decides."""
    rng, weight = np.random.default_rng(random_state), np.full(len(x), 1 / len(x))
    trees, says = [], []
    for _ in range(n_estimators):
        rows = rng.choice(len(x), len(x), p=weight)
        own = tree(x[rows], y[rows], 3)
        off = np.abs(own(x) - y)
        off = off / off.max() if off.max() > 0 else off
        loss = float(weight @ off)
        if loss >= 0.5 and trees:
            break
        trees.append(own)
        if loss <= 0 or loss >= 0.5:
            says.append(1.0)
            break
        beta = loss / (1 - loss)
        says.append(learning_rate * np.log(1 / beta))
        weight = weight * beta ** ((1 - off) * learning_rate)
        weight = weight / weight.sum()

    def predict(q: np.ndarray) -> np.ndarray:
        found = np.array([t(q) for t in trees]).T
        order = np.argsort(found, axis=1)
        reach = np.cumsum(np.array(says)[order], axis=1)
        at = (reach >= 0.5 * reach[:, -1:]).argmax(axis=1)
        return found[np.arange(len(q)), order[np.arange(len(q)), at]]

    return predict


def lag_forecaster(fit: Callable[..., Predict], strategy: str, own: tuple[str, ...]) -> Callable[..., np.ndarray]:
    """A kernel from a regressor: `recursive` feeds forecasts back, `direct` fits one model for each step."""

    def run(y: np.ndarray, h: int, lags=5, roll_windows=(), roll_stats=(), diff_lags=(), seasonal_lags=(), **params) -> np.ndarray:  # noqa: ANN001, ANN003
        y = _enough(y, max(lag_steps(lags)) + 2)
        options = {"roll_windows": roll_windows, "roll_stats": roll_stats, "diff_lags": diff_lags, "seasonal_lags": seasonal_lags}
        x, at = lag_matrix(y, lags, **options)
        params = {k: v for k, v in params.items() if k in own}
        if strategy == "direct":
            last = lag_matrix(np.r_[y, np.nan], lags, **options, at=[len(y)])[0]
            usable = [at + k < len(y) for k in range(h)]
            if not usable[-1].any():
                raise ValueError("the series is too short for the horizon")
            return np.array([fit(x[u], y[at[u] + k], **params)(last)[0] for k, u in enumerate(usable)])
        predict, past = fit(x, y[at], **params), y
        for _ in range(h):
            row = lag_matrix(np.r_[past, np.nan], lags, **options, at=[len(past)])[0]
            past = np.r_[past, predict(row)[0]]
        return past[len(y) :]

    run.__doc__ = fit.__doc__ or f"lag regression ({strategy}) by {fit.__name__}"
    return run


#: Local lag models: key, regressor, lags, own parameters.
LOCAL = (
    ("lr-lag", ols, 5, {}), ("lr-lag-direct", ols, 5, {}), ("ridge-lag", ridge, 5, {"alpha": 1.0}), ("ridge-lag-direct", ridge, 12, {"alpha": 1.0}), ("lasso-lag", lasso, 12, {"alpha": 0.001, "max_iter": 5000}),
    ("elasticnet-lag", elastic_net, 12, {"alpha": 0.001, "l1_ratio": 0.5, "max_iter": 5000}), ("knn-lag", knn, 12, {"n_neighbors": 10, "weights": "distance"}), ("kernel-ridge-lag", kernel_ridge, 12, {"alpha": 1.0, "gamma": None}),
    ("bayesian-ridge-lag", bayesian_ridge, 12, {"alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6}), ("ard-lag", ard, 12, {}), ("omp-lag", omp, 12, {"n_nonzero_coefs": None}),
    ("passive-aggressive-lag", passive_aggressive, 12, {"c": 1.0, "epsilon": 0.1, "max_iter": 1000}), ("huber-lag", huber, 12, {"epsilon": 1.35, "alpha": 0.0001, "max_iter": 200}), ("quantile-lag", quantile, 12, {"quantile": 0.5, "alpha": 0.0}),
    ("poisson-lag", _glm(1.0), 12, {"alpha": 1.0, "max_iter": 100}), ("gamma-lag", _glm(2.0), 12, {"alpha": 1.0, "max_iter": 100}), ("tweedie-lag", _glm(1.5), 12, {"alpha": 1.0, "max_iter": 100}),
    ("sgd-lag", sgd, 12, {"alpha": 0.0001, "max_iter": 2000, "random_state": 0}), ("decision-tree-lag", tree, 12, {"max_depth": 5}), ("rf-lag", _forest(1.0, 1.0, False), 10, {"n_estimators": 200, "random_state": 0}),
    ("extra-trees-lag", _forest(0.0, 1.0, True), 12, {"n_estimators": 300, "random_state": 0, "max_depth": None}), ("bagging-lag", _forest(0.8, 1.0, False), 12, {"n_estimators": 200, "random_state": 0}),
    ("svr-lag", svr, 12, {"C": 1.0, "gamma": "scale", "epsilon": 0.1}), ("linear-svr-lag", linear_svr, 12, {"C": 1.0, "epsilon": 0.0, "max_iter": 5000, "random_state": 0}),
    ("mlp-lag", mlp, 12, {"hidden_layer_sizes": (64, 64), "alpha": 0.0001, "max_iter": 300, "random_state": 0, "learning_rate_init": 0.001}), ("adaboost-lag", adaboost, 12, {"n_estimators": 300, "learning_rate": 0.05, "random_state": 0}),
    ("gbrt-lag", boosting, 12, {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3}), ("hgb-lag", boosting, 12, {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 3}),
)

#: Panel models by key, and the parameters that their estimators take.
PANEL = {
    "ridge-step-lag-global": {"alpha": 1.0}, "bayesian-ridge-step-lag-global": {}, "ard-step-lag-global": {}, "omp-step-lag-global": {}, "quantile-step-lag-global": {"quantile": 0.5, "alpha": 0.0},
    "passive-aggressive-step-lag-global": {"c": 1.0, "epsilon": 0.1, "max_iter": 1000}, "lasso-step-lag-global": {"alpha": 0.001}, "elasticnet-step-lag-global": {"alpha": 0.001, "l1_ratio": 0.5}, "huber-step-lag-global": {"epsilon": 1.35, "alpha": 0.0001},
    "sgd-step-lag-global": {"alpha": 0.0001}, "poisson-step-lag-global": {"alpha": 1.0}, "gamma-step-lag-global": {"alpha": 1.0}, "tweedie-step-lag-global": {"alpha": 1.0, "power": 1.5},
    "decision-tree-step-lag-global": {"max_depth": 5}, "rf-step-lag-global": {"n_estimators": 200, "max_depth": None}, "extra-trees-step-lag-global": {"n_estimators": 300, "max_depth": None}, "bagging-step-lag-global": {"n_estimators": 200, "max_depth": None},
    "knn-step-lag-global": {"n_neighbors": 10, "weights": "distance"}, "kernel-ridge-step-lag-global": {"alpha": 1.0, "gamma": None, "landmarks": 300},
    "svr-step-lag-global": {"c": 1.0, "gamma": "scale", "epsilon": 0.1, "landmarks": 300}, "linear-svr-step-lag-global": {"c": 1.0, "epsilon": 0.0},
    "adaboost-step-lag-global": {"n_estimators": 300, "learning_rate": 0.05}, "mlp-step-lag-global": {"hidden_layer_sizes": (64, 64), "alpha": 0.0001, "max_iter": 300, "random_state": 0},
    "gbrt-step-lag-global": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3}, "hgb-step-lag-global": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 3},
}
