"""Forecasts by numpy: `kernel(y, horizon, **params) -> array`, for models that column expressions don't hold.

A kernel raises ValueError for a series it can't use.
"""

from __future__ import annotations

import numpy as np

from tidewise.functions.features import lag_steps


def _enough(y: np.ndarray, least: int) -> np.ndarray:
    y = np.asarray(y, dtype=float)
    if len(y) < least:
        raise ValueError(f"needs at least {least} values, has {len(y)}")
    return y


def _least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def seasonal_naive_auto(y, h, min_season_length=2, max_season_length=24, detrend=True, min_corr=0.2):  # noqa: ANN001, ANN201
    """Repeat the season with the highest autocorrelation of the (differenced) series, or the last value if none is clear."""
    y = _enough(y, 1)
    scan = np.diff(y) if detrend and len(y) >= 3 else y
    best, at = -np.inf, None
    for lag in range(min_season_length, min(max_season_length, len(scan) // 2) + 1):
        a, b = scan[:-lag] - scan[:-lag].mean(), scan[lag:] - scan[lag:].mean()
        scale = np.sqrt((a @ a) * (b @ b))
        corr = a @ b / scale if scale > 0 else 0.0
        if corr > best + 1e-12:
            best, at = corr, lag
    if at is None or best < min_corr or len(y) < at:
        return np.full(h, y[-1])
    return y[-at:][np.arange(h) % at]


def _grid(low: float, high: float, n: int, dims: int) -> list[np.ndarray]:
    """All combinations, the first parameter slowest, as one vector for each parameter."""
    return [g.ravel() for g in np.meshgrid(*[np.linspace(low, high, n)] * dims, indexing="ij")]


def _trend_paths(y: np.ndarray, alpha, beta, phi=1.0):  # noqa: ANN001, ANN202
    """Holt's recursion for vectors of parameters at once: final level, trend and one-step squared error."""
    level, trend, sse = y[0] + 0 * alpha, (y[1] - y[0]) + 0 * alpha, 0 * alpha
    for x in y[1:]:
        ahead = level + phi * trend
        sse = sse + (x - ahead) ** 2
        new = alpha * x + (1 - alpha) * ahead
        level, trend = new, beta * (new - level) + (1 - beta) * phi * trend
    return level, trend, sse


def holt_auto(y, h, grid_size=10):  # noqa: ANN001, ANN201
    y = _enough(y, 3)
    a, b = _grid(0.1, 0.9, grid_size, 2)
    level, trend, sse = _trend_paths(y, a, b)
    k = int(np.argmin(sse))
    return level[k] + trend[k] * np.arange(1, h + 1)


def _seasonal_paths(y: np.ndarray, m: int, alpha, beta, gamma, multiplicative: bool):  # noqa: ANN001, ANN202
    """Holt-Winters for vectors of parameters at once, started from the first two seasons."""
    tiny = 1e-12
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v) if multiplicative else v
    apply, remove = (np.multiply, np.divide) if multiplicative else (np.add, np.subtract)
    first = float(guard(np.mean(y[:m])))
    level, trend, sse = first + 0 * alpha, (np.mean(y[m : 2 * m]) - np.mean(y[:m])) / m + 0 * alpha, 0 * alpha
    seasons = guard(np.tile(remove(y[:m], first)[:, None], (1, len(np.atleast_1d(alpha)))))
    for t, x in enumerate(y):
        old = seasons[t % m].copy()
        sse = sse + (x - apply(level + trend, old)) ** 2
        new = guard(alpha * remove(x, old) + (1 - alpha) * (level + trend))
        level, trend = new, beta * (new - level) + (1 - beta) * trend
        seasons[t % m] = guard(gamma * remove(x, level) + (1 - gamma) * old)
    return level, trend, seasons, sse


def holt_winters(y, h, season_length=12, alpha=0.2, beta=0.1, gamma=0.1, multiplicative=False, grid_size=None):  # noqa: ANN001, ANN201
    """With a grid size, the parameters of least one-step error among 0.1 to 0.9 for each."""
    m = season_length
    y = _enough(y, 2 * m)
    if multiplicative and (y <= 0).any():
        raise ValueError("a multiplicative season needs positive values")
    a, b, g = _grid(0.1, 0.9, grid_size, 3) if grid_size else (np.array([float(p)]) for p in (alpha, beta, gamma))
    level, trend, seasons, sse = _seasonal_paths(y, m, a, b, g, multiplicative)
    k = int(np.argmin(sse))
    line, season = level[k] + trend[k] * np.arange(1, h + 1), seasons[(np.arange(h) + len(y)) % m, k]
    return line * season if multiplicative else line + season


def theta_auto(y, h, grid_size=19):  # noqa: ANN001, ANN201
    """The smoothing of least one-step error, where each step's slope is that of the values before it."""
    y = _enough(y, 3)
    n = np.arange(1.0, len(y) + 1)
    spread = n * (n * n - 1) / 12
    slope = np.divide(np.cumsum(n * y) - (n + 1) / 2 * np.cumsum(y), spread, out=np.zeros(len(y)), where=spread > 0)
    alpha = np.linspace(0.05, 0.95, grid_size)
    level, sse = np.full(grid_size, y[0]), np.zeros(grid_size)
    for i in range(1, len(y)):
        sse += (y[i] - level - 0.5 * slope[i - 1]) ** 2
        level = alpha * y[i] + (1 - alpha) * level
    return level[int(np.argmin(sse))] + 0.5 * slope[-1] * np.arange(1, h + 1)


def croston_opt(y, h, grid_size=19):  # noqa: ANN001, ANN201
    y = _enough(y, 1)
    some = np.flatnonzero(y > 0)
    if not len(some):
        return np.zeros(h)
    alpha = np.linspace(0.05, 0.95, grid_size)
    z, p, q, sse = np.full(grid_size, y[some[0]]), np.full(grid_size, some[0] + 1.0), 1.0, np.zeros(grid_size)
    for x in y[some[0] + 1 :]:
        sse += (x - z / p) ** 2
        if x > 0:
            z, p, q = alpha * x + (1 - alpha) * z, alpha * q + (1 - alpha) * p, 1.0
        else:
            q += 1
    k = int(np.argmin(sse))
    return np.full(h, z[k] / p[k])


def _lagged(y: np.ndarray, lags) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    top = max(lags)
    return np.column_stack([np.ones(len(y) - top), *(y[top - k : len(y) - k] for k in lags)]), y[top:]


def _continue(y: np.ndarray, lags, weights: np.ndarray, h: int) -> np.ndarray:  # noqa: ANN001
    past = list(y)
    for _ in range(h):
        past.append(weights[0] + sum(w * past[-k] for w, k in zip(weights[1:], lags, strict=True)))
    return np.array(past[len(y) :])


def ar_ols_lags(y, h, lags=(1, 2, 3, 4, 5)):  # noqa: ANN001, ANN201
    lags = [lags] if isinstance(lags, int) else list(dict.fromkeys(int(x) for x in (lags.split(",") if isinstance(lags, str) else lags)))
    if not lags or min(lags) < 1:
        raise ValueError("lags must be positive")
    y = _enough(y, max(lags) + 1)
    return _continue(y, lags, _least_squares(*_lagged(y, lags)), h)


def ar_ols(y, h, p=5):  # noqa: ANN001, ANN201
    return ar_ols_lags(y, h, range(1, p + 1))


def sar_ols(y, h, p=1, P=1, season_length=12):  # noqa: ANN001, ANN201, N803
    return ar_ols_lags(y, h, [*range(1, p + 1), *(season_length * k for k in range(1, P + 1))])


def ar_order(y, max_p=10) -> int:  # noqa: ANN001
    """The order of least Akaike criterion; the first of equals."""
    y = _enough(y, 4)
    scores = {}
    for p in range(1, min(max_p, len(y) - 2) + 1):
        x, t = _lagged(y, range(1, p + 1))
        error = float(((t - x @ _least_squares(x, t)) ** 2).sum()) / len(t)
        scores[p] = len(t) * np.log(error if error > 0 and np.isfinite(error) else 1e-12) + 2 * (p + 1)
    if not scores:
        raise ValueError("the series is too short to choose an order")
    return min(scores, key=scores.get)


def ar_ols_auto(y, h, max_p=10):  # noqa: ANN001, ANN201
    return ar_ols(y, h, ar_order(y, max_p))


def _waves(t: np.ndarray, periods, orders, trend: bool) -> np.ndarray:  # noqa: ANN001
    columns = [np.ones_like(t), *([t] if trend else [])]
    columns += [f(2 * np.pi * k * t / p) for p, o in zip(periods, orders, strict=True) for k in range(1, o + 1) for f in (np.sin, np.cos)]
    return np.column_stack(columns)


def fourier(y, h, period=12, order=2, include_trend=True):  # noqa: ANN001, ANN201
    return fourier_multi(y, h, (period,), order, include_trend)


def fourier_multi(y, h, periods=(7, 365), orders=2, include_trend=True):  # noqa: ANN001, ANN201
    y = _enough(y, 3)
    orders = [orders] * len(periods) if isinstance(orders, int) else list(orders) * (len(periods) if len(orders) == 1 else 1)
    t = np.arange(len(y) + h, dtype=float)
    x = _waves(t, periods, orders, include_trend)
    return x[len(y) :] @ _least_squares(x[: len(y)], y)


def poly_trend(y, h, degree=1):  # noqa: ANN001, ANN201
    y = _enough(y, degree + 2)
    x = np.vander(np.arange(len(y) + h, dtype=float), degree + 1, increasing=True)
    return x[len(y) :] @ _least_squares(x[: len(y)], y)


def fft(y, h, top_k=3, include_trend=True):  # noqa: ANN001, ANN201
    """Sinusoids at the strongest frequencies of what the trend leaves, refitted by least squares."""
    y = _enough(y, 2)
    n, t = len(y), np.arange(len(y) + h, dtype=float)
    line = np.column_stack([np.ones(n + h), t]) if include_trend else np.zeros((n + h, 1))
    trend = line @ _least_squares(line[:n], y) if include_trend else line[:, 0]
    left = y - trend[:n]
    power = np.abs(np.fft.rfft(left))
    power[0] = 0
    strong = [k for k in np.argsort(-power, kind="stable")[:top_k] if power[k] > 0]
    if not strong:
        return trend[n:]
    x = np.column_stack([np.ones(n + h), *(f(2 * np.pi * k / n * t) for k in strong for f in (np.sin, np.cos))])
    return trend[n:] + x[n:] @ _least_squares(x[:n], left)


def ssa(y, h, window_length=24, rank=5):  # noqa: ANN001, ANN201
    """Rank-limited reconstruction of the trajectory matrix, continued by its linear recurrence."""
    y = _enough(y, 3)
    if not 2 <= window_length < len(y) or rank < 1:
        raise ValueError("window_length must lie between 2 and the values less one, and rank be at least 1")
    size = window_length
    paths = np.lib.stride_tricks.sliding_window_view(y, size).T
    u, s, vt = np.linalg.svd(paths, full_matrices=False)
    u, core = u[:, :rank], (u[:, :rank] * s[:rank]) @ vt[:rank]
    place = np.add.outer(np.arange(core.shape[0]), np.arange(core.shape[1])).ravel()
    smooth = np.bincount(place, core.ravel()) / np.bincount(place)
    tip = u[-1]
    rest = 1 - tip @ tip
    if not np.isfinite(rest) or rest <= 1e-10:
        return np.full(h, smooth[-1])
    weights = u[:-1] @ tip / rest
    path = list(smooth)
    for _ in range(h):
        path.append(float(weights @ path[-len(weights) :]))
    return np.array(path[len(y) :])


def analog_knn(y, h, lags=12, k=5, normalize=True, weights="uniform"):  # noqa: ANN001, ANN201
    """Each step follows the k past windows most like the latest one."""
    y = _enough(y, lags + 1)
    if weights not in ("uniform", "distance") or min(lags, k) < 1:
        raise ValueError("weights must be uniform or distance, lags and k at least 1")
    scale = lambda w: (w - w.mean(-1, keepdims=True)) / (w.std(-1, keepdims=True) + 1e-8) if normalize else w
    bank, after = scale(np.lib.stride_tricks.sliding_window_view(y, lags)[:-1]), y[lags:]
    past = list(y)
    for _ in range(h):
        gap = ((bank - scale(np.array(past[-lags:]))) ** 2).sum(1)
        near = np.argpartition(gap, min(k, len(gap)) - 1)[:k]
        same = near[gap[near] <= 1e-12]
        if weights == "uniform":
            past.append(after[near].mean())
        else:
            past.append(after[same].mean() if len(same) else np.average(after[near], weights=1 / gap[near]))
    return np.array(past[len(y) :])


def kalman_trend(y, h, level_variance=None, trend_variance=None, obs_variance=None):  # noqa: ANN001, ANN201
    """Local linear trend by a Kalman filter with a diffuse start."""
    y = _enough(y, 2)
    if any(v is not None and v <= 0 for v in (level_variance, trend_variance, obs_variance)):
        raise ValueError("variances must be positive")
    base = float(np.var(np.diff(y))) or 1e-6
    q = np.diag([base * 0.01 if level_variance is None else level_variance, base * 0.001 if trend_variance is None else trend_variance])
    r = base * 0.1 if obs_variance is None else obs_variance
    state, cover, move = np.array([y[0], y[1] - y[0]]), np.eye(2) * 1e6, np.array([[1.0, 1.0], [0.0, 1.0]])
    for x in y:
        state, cover = move @ state, move @ cover @ move.T + q
        gain = cover[:, 0] / (cover[0, 0] + r)
        state, cover = state + gain * (x - state[0]), cover - np.outer(gain, cover[0])
    return state[0] + state[1] * np.arange(1, h + 1)


def autoreg(y, h, lags=12, trend="c", seasonal=False, period=12):  # noqa: ANN001, ANN201
    """Autoregression with constant, line and seasonal dummies as asked, by least squares."""
    lags = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    top = max(lags, default=0)
    y = _enough(y, top + 2)

    def row(t: np.ndarray) -> np.ndarray:
        parts = [np.ones_like(t)] * ("c" in trend) + [t + 1.0] * ("t" in trend)
        parts += [(t % period == s).astype(float) for s in range("c" in trend, period)] if seasonal else []
        return np.column_stack(parts) if parts else np.empty((len(t), 0))

    t = np.arange(len(y) + h, dtype=float)
    fixed = row(t)
    x = np.column_stack([fixed[top : len(y)], *(y[top - k : len(y) - k] for k in lags)])
    weights = _least_squares(x, y[top:])
    past = list(y)
    for i in range(len(y), len(y) + h):
        past.append(float(np.r_[fixed[i], [past[-k] for k in lags]] @ weights))
    return np.array(past[len(y) :])


def ets(y, h, season_length=12, trend="add", seasonal="add", damped_trend=False):  # noqa: ANN001, ANN201
    """Exponential smoothing with parameters of least one-step error on a grid; a stand-in for maximum likelihood."""
    if seasonal in ("add", "mul") and len(y) >= 2 * season_length:
        return holt_winters(y, h, season_length, multiplicative=seasonal == "mul", grid_size=7)
    y = _enough(y, 3)
    a, b = _grid(0.05, 0.95, 10, 2)
    phi = 0.9 if damped_trend else 1.0
    level, slope, sse = _trend_paths(y, a, b * (trend is not None), phi)
    k = int(np.argmin(sse))
    steps = np.cumsum(phi ** np.arange(1, h + 1)) if damped_trend else np.arange(1, h + 1)
    return level[k] + slope[k] * steps * (trend is not None)


def var(y: np.ndarray, h: int, maxlags: int = 1, trend: str = "c") -> np.ndarray:
    """Vector autoregression by least squares: a matrix of time x targets in, horizon x targets out."""
    y = np.asarray(y, dtype=float)
    if y.ndim != 2 or y.shape[1] < 2:
        raise ValueError("needs at least two targets")
    if len(y) <= maxlags * y.shape[1] + 1:
        raise ValueError("the series are too short for their lags")
    fixed = lambda t: np.column_stack([np.ones_like(t)] * ("c" in trend) + [t + 1.0] * ("t" in trend)) if trend != "n" else np.empty((len(t), 0))
    t = np.arange(len(y) + h, dtype=float)
    x = np.column_stack([fixed(t[maxlags : len(y)]), *(y[maxlags - k : len(y) - k] for k in range(1, maxlags + 1))])
    weights = _least_squares(x, y[maxlags:])
    past = list(y)
    for i in range(len(y), len(y) + h):
        past.append(np.concatenate([fixed(t[i : i + 1])[0], *(past[-k] for k in range(1, maxlags + 1))]) @ weights)
    return np.array(past[len(y) :])


def lag_matrix(y: np.ndarray, lags, roll_windows=(), roll_stats=(), diff_lags=(), seasonal_lags=(), at=None) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Features of times `at` from the values before them: lags (largest first), window statistics, differences, seasons."""
    lags = lag_steps(lags)
    start = max([*lags, *roll_windows, *(1 + k for k in diff_lags), *seasonal_lags])
    at = np.arange(start, len(y)) if at is None else np.asarray(at)
    tail = lambda w: np.stack([y[t - w : t] for t in at]) if len(at) else np.empty((0, w))
    stats = {
        "mean": lambda x: x.mean(1), "std": lambda x: x.std(1), "min": lambda x: x.min(1), "max": lambda x: x.max(1), "median": lambda x: np.median(x, 1),
        "slope": lambda x: (x - x.mean(1, keepdims=True)) @ (np.arange(x.shape[1]) - (x.shape[1] - 1) / 2) / max(1e-12, ((np.arange(x.shape[1]) - (x.shape[1] - 1) / 2) ** 2).sum()),
        "iqr": lambda x: np.subtract(*np.quantile(x, [0.75, 0.25], axis=1)), "mad": lambda x: np.median(np.abs(x - np.median(x, 1, keepdims=True)), 1),
    }
    columns = [y[at - k] for k in lags] + [stats[s](tail(w)) for w in roll_windows for s in roll_stats]
    columns += [y[at - 1] - y[at - 1 - k] for k in diff_lags] + [y[at - p] for p in seasonal_lags]
    return np.column_stack(columns), at
