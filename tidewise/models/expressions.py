"""Forecasts as column expressions: an array of the training values in, an array of `horizon` forecasts out.

`a` must be a column of the row, not a longer expression: lambdas read it again for each element. A series too short for its
model gives null. Recursions are folds over the array, so a model runs inside the JVM in one pass over its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Forecast = Callable[..., Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def _num(x: float) -> Column:
    return F.lit(float(x))


def _steps(h: int, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(h)), body)


def _flat(value: Column, h: int) -> Column:
    return F.array_repeat(value, h)


def _sum(a: Column) -> Column:
    return F.aggregate(a, _num(0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _median(a: Column) -> Column:
    return let(F.sort_array(a), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def _tail(a: Column, k: int) -> Column:
    return F.slice(a, F.size(a) - k + 1, k)


def _rest(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _needs(a: Column, least: int, value: Column) -> Column:
    return F.when(F.size(a) >= least, value)


def naive_last(a: Column, h: int) -> Column:
    return _needs(a, 1, _flat(F.element_at(a, -1), h))


def seasonal_naive(a: Column, h: int, season_length: int = 12) -> Column:
    return _needs(a, season_length, _steps(h, lambda k: F.get(a, F.size(a) - season_length + (k - 1) % season_length)))


def mean(a: Column, h: int) -> Column:
    return _needs(a, 1, _flat(_mean(a), h))


def median(a: Column, h: int) -> Column:
    return _needs(a, 1, _flat(_median(a), h))


def drift(a: Column, h: int) -> Column:
    slope = (F.element_at(a, -1) - a[0]) / (F.size(a) - 1)
    return _needs(a, 2, _steps(h, lambda k: F.element_at(a, -1) + k * slope))


def moving_average(a: Column, h: int, window: int = 3) -> Column:
    return _needs(a, window, _flat(_mean(_tail(a, window)), h))


def weighted_moving_average(a: Column, h: int, window: int = 3) -> Column:
    weighted = _sum(F.transform(_tail(a, window), lambda x, i: x * (i + 1)))
    return _needs(a, window, _flat(weighted / (window * (window + 1) / 2), h))


def moving_median(a: Column, h: int, window: int = 3) -> Column:
    return _needs(a, window, _flat(_median(_tail(a, window)), h))


def seasonal_mean(a: Column, h: int, season_length: int = 12) -> Column:
    """Means by position from the start; step k takes position k - 1, wherever the series ends."""
    means = F.transform(F.sequence(F.lit(0), F.lit(min(h, season_length) - 1)), lambda p: _mean(F.filter(a, lambda _, i: i % season_length == p)))
    return _needs(a, season_length, let(means, lambda m: _steps(h, lambda k: F.get(m, (k - 1) % season_length))))


def seasonal_drift(a: Column, h: int, season_length: int = 12) -> Column:
    m = season_length

    def at(k: Column) -> Column:
        last, before = F.get(a, F.size(a) - m + (k - 1) % m), F.get(a, F.size(a) - 2 * m + (k - 1) % m)
        return last + (last - before) * (F.floor((k - 1) / m) + 1)

    return _needs(a, 2 * m, _steps(h, at))


def _ses_level(a: Column, alpha: Column | float) -> Column:
    alpha = alpha if isinstance(alpha, Column) else _num(alpha)
    return F.aggregate(_rest(a), a[0], lambda level, x: alpha * x + (F.lit(1.0) - alpha) * level)


def ses(a: Column, h: int, alpha: float = 0.2) -> Column:
    return _needs(a, 1, _flat(_ses_level(a, alpha), h))


def _best(grid: Sequence[float], loss: Callable[[Column], Column]) -> Column:
    """The first grid value of least loss."""
    scored = F.transform(F.array(*map(_num, grid)), lambda g, i: F.struct(loss(g).alias("loss"), i.alias("i"), g.alias("g")))
    return F.array_min(scored)["g"]


def linear_grid(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def ses_auto(a: Column, h: int, grid_size: int = 19) -> Column:
    start = F.struct(F.lit(0.0).alias("sse"), a[0].alias("level"))

    def loss(g: Column) -> Column:
        return F.aggregate(_rest(a), start, lambda s, x: F.struct((s["sse"] + (x - s["level"]) * (x - s["level"])).alias("sse"), (g * x + (F.lit(1.0) - g) * s["level"]).alias("level")), lambda s: s["sse"])

    return _needs(a, 2, let(_best(linear_grid(0.05, 0.95, grid_size), loss), lambda g: _flat(_ses_level(a, g), h)))


def holt_damped(a: Column, h: int, alpha: float = 0.2, beta: float = 0.1, phi: float = 0.9) -> Column:
    start = F.struct(a[0].alias("level"), (F.get(a, F.lit(1)) - a[0]).alias("trend"))

    def move(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s["level"] + phi * s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * (phi * s["trend"])).alias("trend"))

    damp = lambda k: k.cast("double") if abs(1 - phi) < 1e-12 else phi * (1 - F.pow(_num(phi), k)) / (1 - phi)
    return _needs(a, 2, let(F.aggregate(_rest(a), start, move), lambda s: _steps(h, lambda k: s["level"] + s["trend"] * damp(k))))


def holt(a: Column, h: int, alpha: float = 0.2, beta: float = 0.1) -> Column:
    return holt_damped(a, h, alpha, beta, 1.0)


def _slope(a: Column) -> Column:
    """Least-squares slope against 0, 1, 2, ...; 0 for a single value."""
    n = F.size(a)
    centred = F.aggregate(F.transform(a, lambda x, i: (i - (n - 1) / 2) * x), _num(0), lambda s, x: s + x)
    return F.when(n > 1, centred / (n * (n * n - 1.0) / 12)).otherwise(0.0)


def theta(a: Column, h: int, alpha: float = 0.2) -> Column:
    return _needs(a, 2, let(F.struct(_ses_level(a, alpha).alias("level"), _slope(a).alias("slope")), lambda s: _steps(h, lambda k: s["level"] + 0.5 * s["slope"] * k)))


def linear_trend(a: Column, h: int) -> Column:
    both = F.struct(_mean(a).alias("mean"), _slope(a).alias("slope"))
    return _needs(a, 3, let(both, lambda s: _steps(h, lambda k: s["mean"] + s["slope"] * (F.size(a) + k - 1 - (F.size(a) - 1) / 2))))


def _croston_state(a: Column, alpha: float) -> Column:
    """Demand size z, interval p and time since demand q; demand before the first is unknown (z is null)."""
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), _num(1).alias("q"))

    def move(s: Column, x: Column) -> Column:
        first = F.struct(x.alias("z"), s["q"].alias("p"), _num(1).alias("q"))
        again = F.struct((alpha * x + (1 - alpha) * s["z"]).alias("z"), (alpha * s["q"] + (1 - alpha) * s["p"]).alias("p"), _num(1).alias("q"))
        return F.when(x > 0, F.when(s["z"].isNull(), first).otherwise(again)).otherwise(F.struct(s["z"].alias("z"), s["p"].alias("p"), (s["q"] + 1).alias("q")))

    return F.aggregate(a, start, move)


def croston(a: Column, h: int, alpha: float = 0.1, correction: float = 1.0) -> Column:
    return _needs(a, 1, let(_croston_state(a, alpha), lambda s: _flat(F.coalesce(F.when(s["p"] > 0, s["z"] / s["p"] * correction), _num(0)), h)))


def croston_sba(a: Column, h: int, alpha: float = 0.1) -> Column:
    return croston(a, h, alpha, 1 - alpha / 2)


def croston_sbj(a: Column, h: int, alpha: float = 0.1) -> Column:
    return croston(a, h, alpha, 1 - alpha / (2 - alpha))


def les(a: Column, h: int, alpha: float = 0.1, beta: float = 0.1) -> Column:
    """Croston's sizes and intervals; while there is no demand the forecast falls along a line to zero."""
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), _num(1).alias("q"), _num(0).alias("f"))
    decay = lambda z, p, q: F.coalesce(F.when(p > 0, z / p * F.greatest(1 - beta * q / (2 * p), _num(0))), _num(0))

    def move(s: Column, x: Column) -> Column:
        z = F.when(s["z"].isNull(), x).otherwise(alpha * x + (1 - alpha) * s["z"])
        p = F.when(s["z"].isNull(), s["q"]).otherwise(beta * s["q"] + (1 - beta) * s["p"])
        hit = F.struct(z.alias("z"), p.alias("p"), _num(1).alias("q"), F.when(p > 0, z / p).otherwise(0.0).alias("f"))
        return F.when(x > 0, hit).otherwise(F.struct(s["z"].alias("z"), s["p"].alias("p"), (s["q"] + 1).alias("q"), decay(s["z"], s["p"], s["q"]).alias("f")))

    return _needs(a, 1, let(F.aggregate(a, start, move), lambda s: _steps(h, lambda k: F.when(k == 1, s["f"]).otherwise(decay(s["z"], s["p"], s["q"] + k - 2)))))


def tsb(a: Column, h: int, alpha: float = 0.1, beta: float = 0.1) -> Column:
    """Demand size, smoothed when there is demand, times its chance, smoothed always; both start from their means."""
    some = F.filter(a, lambda x: x > 0)
    start = F.struct(_mean(some).alias("z"), (F.size(some) / F.size(a)).alias("p"))
    move = lambda s, x: F.struct(F.when(x > 0, alpha * x + (1 - alpha) * s["z"]).otherwise(s["z"]).alias("z"), (beta * F.when(x > 0, 1.0).otherwise(0.0) + (1 - beta) * s["p"]).alias("p"))
    return _needs(a, 1, F.when(F.size(some) > 0, let(F.aggregate(a, start, move), lambda s: _flat(s["p"] * s["z"], h))).otherwise(_flat(_num(0), h)))


def adida(a: Column, h: int, agg_period: int = 4, base: str = "ses", alpha: float = 0.2) -> Column:
    """Sums of full blocks from the start, forecast by the base model and spread evenly over the block."""
    models = {"ses": lambda x: _ses_level(x, alpha), "mean": _mean, "naive-last": lambda x: F.element_at(x, -1)}
    if base not in models:
        raise ValueError(f"base must be one of {sorted(models)}")
    m = agg_period
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(a) / m).cast("int") - 1, F.lit(0))), lambda b: _sum(F.slice(a, b * m + 1, m)))
    short = models["ses"](a) if base == "ses" else _mean(a)
    return _needs(a, 1, F.when(F.size(a) >= m, let(blocks, lambda x: _flat(models[base](x) / m, h))).otherwise(_flat(short, h)))


def kalman_level(a: Column, h: int, process_variance: float | None = None, obs_variance: float | None = None) -> Column:
    """A random walk seen with noise, filtered from a diffuse start; variances default to shares of that of the differences."""
    moves = F.transform(_rest(a), lambda x, i: x - F.get(a, i))
    variance = lambda d: let(_mean(d), lambda m: F.aggregate(d, _num(0), lambda s, x: s + (x - m) * (x - m)) / F.size(d))
    base = F.when(F.size(a) > 1, let(moves, variance)).otherwise(0.0)
    base = let(base, lambda v: F.when(v > 0, v).otherwise(1e-6))

    def run(v: Column) -> Column:
        q = v * 0.01 if process_variance is None else _num(process_variance)
        r = v * 0.1 if obs_variance is None else _num(obs_variance)

        def move(s: Column, x: Column) -> Column:
            gain = (s["p"] + q) / (s["p"] + q + r)
            return F.struct((s["level"] + gain * (x - s["level"])).alias("level"), ((1 - gain) * (s["p"] + q)).alias("p"))

        return F.aggregate(a, F.struct(a[0].alias("level"), _num(1e6).alias("p")), move, lambda s: s["level"])

    return _needs(a, 1, _flat(let(base, run), h))


def combined(members: Sequence[Column], h: int, agg: str = "mean", weights: Sequence[float] | None = None) -> Column:
    """Step by step the (weighted) mean or the median of members' forecasts; null if a member is."""
    if weights is not None and (agg != "mean" or len(weights) != len(members) or min(weights) < 0 or sum(weights) <= 0):
        raise ValueError("weights go with the mean, one for each member, none negative and some positive")
    w = [x / sum(weights) for x in weights] if weights else [1 / len(members)] * len(members)

    def at(k: Column) -> Column:
        own = [F.get(m, k - 1) for m in members]
        return _median(F.array(*own)) if agg == "median" else sum((x * y for x, y in zip(own[1:], w[1:], strict=True)), own[0] * w[0])

    present = members[0].isNotNull()
    for m in members[1:]:
        present = present & m.isNotNull()
    return F.when(present, _steps(h, at))
