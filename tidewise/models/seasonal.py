"""Seasonal parts and models of what they leave, by numpy: kernels `(y, horizon, **params) -> array` made of two halves.

A seasonal part (LOESS decomposition for one or more periods, or sines and cosines) is taken off, a model forecasts the rest, and
the season is added again. Models of the rest: ARIMA by conditional sums of squares, autoregression, smoothing, and structural
level, trend and season by a Kalman filter. They stand in for maximum likelihood: forecasts agree in kind, not to the digit.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import Any

import numpy as np

from tidewise.models.kernels import _enough, _least_squares, _waves, autoreg, ets

Kernel = Callable[..., np.ndarray]


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local lines through the `span` nearest values, by tricube weights, at places `at` (all of them, or beyond the ends)."""
    n = len(y)
    at = np.arange(n) if at is None else np.asarray(at)
    near = min(span, n)
    first = np.clip(at - near // 2, 0, n - near)
    index = first[:, None] + np.arange(near)
    off = (index - at[:, None]).astype(float)
    reach = np.maximum(np.abs(off).max(1), 1.0) + max(0, (span - n) // 2)
    w = np.clip(1 - (np.abs(off) / (reach[:, None] * 1.0001)) ** 3, 0, None) ** 3
    if weights is not None:
        w = w * weights[index] + 1e-12
    total = w.sum(1)
    mean, level = (w * off).sum(1) / total, (w * y[index]).sum(1) / total
    spread = (w * (off - mean[:, None]) ** 2).sum(1)
    slope = np.divide((w * (off - mean[:, None]) * y[index]).sum(1), spread, out=np.zeros(len(at)), where=spread > 1e-12)
    return level - slope * mean


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(season, trend): each season's place is smoothed on its own, what is low in frequency goes to the trend, again and again."""
    n = len(y)
    odd = lambda k: int(k) + (int(k) % 2 == 0)
    trend_span, low_span = odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal))), odd(period + 1)
    trend, weights, season = np.zeros(n), np.ones(n), np.zeros(n)
    average = lambda x, k: np.convolve(x, np.ones(k) / k, "valid")
    for _ in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            wide = np.zeros(n + 2 * period)
            for place in range(period):
                own = (y - trend)[place::period]
                wide[place::period][: len(own) + 2] = loess(own, seasonal, weights[place::period], np.arange(-1, len(own) + 1))
            season = wide[period : period + n] - loess(average(average(average(wide, period), period), 3), low_span)
            trend = loess(y - season, trend_span, weights)
        rest = np.abs(y - season - trend)
        weights = np.clip(1 - (rest / max(6 * np.median(rest), 1e-12)) ** 2, 0, 1) ** 2 if robust else weights
    return season, trend


def _seasons(y: np.ndarray, periods: tuple[int, ...], windows: list[int], rounds: int, robust: bool = False) -> list[np.ndarray]:
    """A season for each period, each found in what the others leave."""
    found = [np.zeros(len(y)) for _ in periods]
    for _ in range(rounds):
        for i, (period, window) in enumerate(zip(periods, windows, strict=True)):
            found[i] = stl(y - sum(found) + found[i], period, window, robust)[0]
    return found


def _polynomial(own: np.ndarray, seasonal: np.ndarray, s: int) -> np.ndarray:
    """Coefficients of (1 + own)(1 + seasonal at multiples of s) without the leading 1."""
    wide = np.zeros(1 + len(seasonal) * s)
    wide[0] = 1
    wide[s::s] = seasonal
    return np.convolve(np.r_[1, own], wide)[1:]


def _inverse(series: np.ndarray, n: int) -> np.ndarray:
    """The first n coefficients of 1 / (1 + series), twice as many in each round."""
    poly, out = np.r_[1.0, series], np.ones(1)
    while len(out) < n:
        k = min(n, 2 * len(out))
        out = 2 * np.r_[out, np.zeros(k - len(out))] - np.convolve(np.convolve(out, out)[:k], poly[:k])[:k]
    return out


def _shocks(z: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors, those before the start taken as 0."""
    e = np.convolve(z, np.r_[1.0, ar])[: len(z)]
    e[: len(ar)] = 0
    return np.convolve(e, _inverse(ma, len(z)))[: len(z)] if len(ma) else e


def arima_fit(y: np.ndarray, order: tuple[int, int, int], seasonal_order: tuple[int, int, int, int] = (0, 0, 0, 0), trend: str | None = None) -> tuple[float, int, Callable[[int], np.ndarray]]:
    """(sum of squares, parameters, forecast): least conditional sum of squares by damped Gauss-Newton steps.

    Without differences there is a constant unless `trend` is "n".
    """
    (p, d, q), (sp, sd, sq, s) = order, seasonal_order
    z, ends = np.asarray(y, float), []
    for lag in [1] * d + [s] * sd:
        ends.append((lag, z[-lag:]))
        z = z[lag:] - z[:-lag]
    level = float(z.mean()) if (trend is None and d + sd == 0) or (trend or "").startswith("c") else 0.0
    top = p + sp * s
    if len(z) < top + q + sq * s + 2:
        raise ValueError("the series is too short for its order")
    scale = float(z.std()) or 1.0
    w = (z - level) / scale

    def parts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, c, sa, sc = np.split(b, np.cumsum([p, q, sp]))
        return _polynomial(-a, -sa, s or 1), _polynomial(c, sc, s or 1)

    def errors(rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.array([_shocks(w, *parts(row)) for row in rows])

    b = np.zeros(p + q + sp + sq)
    e, damp = errors(b[None])[0], 1e-9
    for _ in range(30 if len(b) else 0):
        slope = (errors(b + 1e-5 * np.eye(len(b))) - e).T / 1e-5
        move = np.linalg.solve(slope.T @ slope + damp * np.eye(len(b)) * max(1e-9, np.trace(slope.T @ slope)), -slope.T @ e)
        tried = errors(np.clip(b + move, -0.99, 0.99)[None])[0]
        if np.isfinite(tried).all() and tried @ tried < e @ e:
            done = e @ e - tried @ tried < 1e-7 * (e @ e)
            b, e, damp = np.clip(b + move, -0.99, 0.99), tried, damp / 3
            if done:
                break
        elif (damp := damp * 10) > 1e6:
            break
    ar, ma = parts(b)

    def forecast(h: int) -> np.ndarray:
        path, errors = list(w), list(e)
        for _ in range(h):
            past = sum(-a * path[-i] for i, a in enumerate(ar, 1) if i <= len(path)) + sum(c * errors[-i] for i, c in enumerate(ma, 1) if i <= len(errors))
            path.append(float(past))
            errors.append(0.0)
        out = level + scale * np.array(path[len(w) :])
        for lag, last in reversed(ends):
            whole = list(last)
            for x in out:
                whole.append(whole[-lag] + x)
            out = np.array(whole[lag:])
        return out

    return float(e @ e) * scale**2, len(b) + 1 + (level != 0), forecast


def arima(y, h, order=(1, 0, 0), seasonal_order=(0, 0, 0, 0), trend=None, enforce_stationarity=True, enforce_invertibility=True):  # noqa: ANN001, ANN201
    """ARIMA of given orders by conditional sums of squares; coefficients are kept inside -0.99 to 0.99."""
    return arima_fit(_enough(y, 3), tuple(order), tuple(seasonal_order), trend)[2](h)


def auto_arima(y, h, max_p=3, max_d=2, max_q=3, max_P=0, max_D=0, max_Q=0, seasonal_period=None, trend=None, information_criterion="aic", enforce_stationarity=True, enforce_invertibility=True):  # noqa: ANN001, ANN201, N803
    """The orders of least criterion on a grid; all candidates are compared on the values after the longest start."""
    y = _enough(y, 5)
    s, best = seasonal_period or 0, (np.inf, None)
    most = (max_p, max_d, max_q, max_P, max_D, max_Q) if s else (max_p, max_d, max_q, 0, 0, 0)
    for p, d, q, sp, sd, sq in product(*(range(m + 1) for m in most)):
        try:
            error, k, forecast = arima_fit(y, (p, d, q), (sp, sd, sq, s), trend)
        except (ValueError, np.linalg.LinAlgError):
            continue
        n = len(y) - d - sd * s - p - sp * s
        score = len(y) * np.log(max(error, 1e-12) / n) + {"aic": 2 * k, "bic": k * np.log(n), "hqic": 2 * k * np.log(np.log(max(n, 3))), "aicc": 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)}[information_criterion]
        if score < best[0] - 1e-9:
            best = (score, forecast)
    if best[1] is None:
        raise ValueError("no order fits the series")
    return best[1](h)


def structural(y, h, level="local level", seasonal=None):  # noqa: ANN001, ANN201
    """Level, trend and seasonal states by a Kalman filter; variances of greatest likelihood on ever finer grids, relative to the noise."""
    y = _enough(y, 3)
    slope, s = level in ("local linear trend", "lltrend"), int(seasonal or 0)
    size = 1 + slope + max(0, s - 1)
    move, see = np.zeros((size, size)), np.zeros(size)
    move[0, 0] = see[0] = 1
    if slope:
        move[0, 1] = move[1, 1] = 1
    if s > 1:
        at = 1 + slope
        move[at, at:] = -1
        move[range(at + 1, size), range(at, size - 1)] = 1
        see[at] = 1
    noisy = [0] + [1] * slope + [1 + slope] * (s > 1)
    scale = float(y.std()) or 1.0
    z = (y - y[0]) / scale

    def run(ratios: np.ndarray) -> tuple[float, np.ndarray]:
        q = np.zeros((size, size))
        q[noisy, noisy] = ratios
        state, cover, total, logs, n = np.zeros(size), np.eye(size) * 1e5, 0.0, 0.0, 0
        for t, x in enumerate(z):
            state, cover = move @ state, move @ cover @ move.T + q
            f = see @ cover @ see + 1
            gain, off = cover @ see / f, x - see @ state
            if t >= size:
                total, logs, n = total + off * off / f, logs + np.log(f), n + 1
            state, cover = state + gain * off, cover - np.outer(gain, see @ cover)
        return (n * np.log(max(total, 1e-12) / max(n, 1)) + logs), state

    center, width = np.full(len(noisy), -2.0), 4.0
    for _ in range(4):
        center = min((np.array(c) for c in product(*[(m - width, m - width / 2, m, m + width / 2, m + width) for m in center])), key=lambda c: run(np.exp(c))[0])
        width /= 2.5
    state = run(np.exp(center))[1]
    out = []
    for _ in range(h):
        state = move @ state
        out.append(see @ state)
    return y[0] + scale * np.array(out)


def _rest(kind: str) -> Kernel:
    """The model of what a season leaves: its parameters by their names."""
    return {
        "arima": arima, "sarimax": arima, "auto-arima": auto_arima, "autoreg": autoreg, "uc": structural,
        "ets": lambda y, h, trend="add", damped_trend=False: ets(y, h, trend=trend, seasonal=None, damped_trend=damped_trend),
    }[kind]


def decomposed(kind: str, multiple: bool) -> Kernel:
    def run(y, h, period=12, periods=(12,), seasonal=7, robust=False, iterate=2, lmbda=None, **params):  # noqa: ANN001, ANN003, ANN202
        """Seasons by LOESS are taken off, the rest is forecast, and each season's last period is repeated."""
        y = np.asarray(y, float)
        own = tuple(int(p) for p in periods) if multiple else (int(period),)
        if min(own) < 2 or len(y) < 2 * max(own):
            raise ValueError("needs two periods of at least two values")
        found = _seasons(y, own, [11 + 4 * i for i in range(len(own))], iterate) if multiple else _seasons(y, own, [seasonal], 1, robust)
        again = sum(s[-p:][np.arange(h) % p] for s, p in zip(found, own, strict=True))
        return _rest(kind)(y - sum(found), h, **params) + again

    return run


def harmonic(kind: str, with_trend: bool) -> Kernel:
    def run(y, h, periods=(12,), orders=2, include_trend=True, boxcox_lambda=None, arima_order=None, **params):  # noqa: ANN001, ANN003, ANN202
        """Sines and cosines (and a line) by least squares; a model of the residuals is added to their continuation."""
        y = _enough(y, 5)
        if boxcox_lambda is not None:
            if (y <= 0).any():
                raise ValueError("a power transform needs positive values")
            y = np.log(y) if boxcox_lambda == 0 else (y**boxcox_lambda - 1) / boxcox_lambda
        own = (periods,) if isinstance(periods, int) else tuple(periods)
        x = _waves(np.arange(len(y) + h, dtype=float), own, [orders] * len(own) if isinstance(orders, int) else list(orders), with_trend and include_trend)
        line = x @ _least_squares(x[: len(y)], y)
        if arima_order is not None:
            params["order"] = arima_order
        out = line[len(y) :] + _rest(kind)(y - line[: len(y)], h, **params)
        if boxcox_lambda is not None:
            out = np.exp(out) if boxcox_lambda == 0 else np.maximum(boxcox_lambda * out + 1, 1e-12) ** (1 / boxcox_lambda)
        return out

    return run


_ARIMA = {"order": (1, 0, 0), "trend": None, "enforce_stationarity": True, "enforce_invertibility": True}
_AUTO = {"max_p": 3, "max_d": 2, "max_q": 3, "trend": None, "information_criterion": "aic", "enforce_stationarity": True, "enforce_invertibility": True}
_RESTS: dict[str, dict[str, Any]] = {
    "arima": _ARIMA, "sarimax": _ARIMA | {"seasonal_order": (0, 0, 0, 0)}, "auto-arima": _AUTO, "autoreg": {"lags": 1, "trend": "c"}, "ets": {"trend": "add", "damped_trend": False},
    "uc": {"level": "local level"},
}
#: Key, kernel and defaults.
MODELS: list[tuple[str, Kernel, dict[str, Any]]] = [
    ("arima", arima, _ARIMA), ("sarimax", arima, _RESTS["sarimax"]), ("auto-arima", auto_arima, _AUTO | {"max_P": 0, "max_D": 0, "max_Q": 0, "seasonal_period": None}),
    ("uc-local-level", structural, {"level": "local level"}), ("uc-local-linear-trend", structural, {"level": "local linear trend"}), ("uc-seasonal", structural, {"level": "local level", "seasonal": 12}),
]
for _kind, _own in _RESTS.items():
    _waved = {"periods": (12,), "orders": 2}
    MODELS += [
        (f"stl-{_kind}", decomposed(_kind, False), {"period": 12, "seasonal": 7, "robust": False} | _own), (f"mstl-{_kind}", decomposed(_kind, True), {"periods": (12,), "iterate": 2} | _own),
        (f"fourier-{_kind}", harmonic(_kind, False), _waved | _own | ({"lags": 0} if _kind == "autoreg" else {})),
        ("tbats-lite" if _kind == "arima" else f"tbats-lite-{_kind}", harmonic(_kind, True), _waved | {"include_trend": True, "boxcox_lambda": None} | ({"arima_order": (1, 0, 0)} if _kind == "arima" else _own)),
    ]
