"""The forecast pool: closed forms and smoothing on arrays, quantiles, the output contract and user forecasters.

Closed forms are column expressions on the window's array; smoothing weights are fitted by a kernel on Arrow batches, all windows at once: from the best point of a
grid by a bounded search. Both run where the row is, without a shuffle.
Forecasts are rows (input_key, model, h, mean), with ``se`` where intervals are asked for; quantiles are rows with level and q.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import centred, diff, dot, let, mean, settled, total
from ..functions.search import ROUNDS, pattern_search

ALPHAS = tuple(round(0.1 * k, 1) for k in range(1, 10))
BETAS = (0.05, 0.1, 0.2, 0.4)
PHIS = (0.8, 0.9, 0.98)


def _steps(windows: DataFrame, model: str, horizon: int, value: Callable[[Column], Column], keep: list[str] | None = None, key: str = "input_key") -> DataFrame:
    rows = windows.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))  # fits are computed below, once a window
    return rows.select(key, F.lit(model).alias("model"), *(keep or []), "h", value(F.col("h")).alias("mean"))


def residual_sd(x: Column, k: int = 1) -> Column:
    """Root mean square of the k-step differences."""
    d = diff(x, k)
    return F.when(F.size(d) > 0, F.sqrt(dot(d, d) / F.size(d)))


def fc_naive(windows: DataFrame, horizon: int, array_col: str = "window") -> DataFrame:
    """The last value; se = sigma sqrt(h)."""
    rows = windows.withColumn("sd_", residual_sd(F.col(array_col))).withColumn("x_", F.element_at(array_col, -1))
    return _steps(rows, "naive", horizon, lambda h: F.col("x_"), ["sd_"]).withColumn("se", F.col("sd_") * F.sqrt("h")).drop("sd_")


def fc_snaive(windows: DataFrame, horizon: int, period: int, array_col: str = "window") -> DataFrame:
    """The last cycle repeated; se = sigma sqrt(floor((h - 1) / m) + 1). Histories under one cycle repeat their last value."""
    n = F.size(array_col)
    m = F.least(F.lit(period), n)
    rows = windows.withColumn("sd_", residual_sd(F.col(array_col), period)).withColumns({"m_": m, "x_": F.col(array_col)})
    out = _steps(rows, "snaive", horizon, lambda h: F.element_at("x_", F.size("x_") - F.col("m_") + ((h - 1) % F.col("m_")) + 1), ["sd_"])
    return out.withColumn("se", F.col("sd_") * F.sqrt(F.floor((F.col("h") - 1) / period) + 1)).drop("sd_")


def fc_rw_drift(windows: DataFrame, horizon: int, array_col: str = "window") -> DataFrame:
    """last + h (last - first) / (n - 1); se = sigma sqrt(h (1 + h / (n - 1)))."""
    x = F.col(array_col)
    rows = windows.withColumns({"n_": F.size(x), "x_": F.element_at(x, -1), "slope_": (F.element_at(x, -1) - F.element_at(x, 1)) / (F.size(x) - 1)})
    d = let(F.col("slope_"), lambda b: F.transform(diff(x), lambda v: v - b))
    rows = rows.withColumn("sd_", let(d, lambda e: F.sqrt(dot(e, e) / (F.col("n_") - 1))))
    out = _steps(rows, "rw_drift", horizon, lambda h: F.col("x_") + h * F.col("slope_"), ["sd_", "n_"])
    return out.withColumn("se", F.col("sd_") * F.sqrt(F.col("h") * (1 + F.col("h") / (F.col("n_") - 1)))).drop("sd_", "n_")


def seasonality_test(windows: DataFrame, period: int, array_col: str = "window") -> DataFrame:
    """n >= 3 m and |acf_m| > 1.645 / sqrt(n) sqrt(1 + 2 sum of the squared acf below m); what can't be told is false."""
    if period <= 1:
        return windows.withColumn("seasonal", F.lit(False))
    def test(c):
        lagged = lambda k: dot(F.slice(c, F.lit(1), F.greatest(F.size(c) - k, F.lit(0))), F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))))
        sums = F.transform(F.sequence(F.lit(1), F.lit(period)), lagged)  # one expression for all lags
        above = lambda r: F.abs(F.element_at(r, period)) > 1.645 / F.sqrt(F.size(c)) * F.sqrt(1 + 2 * total(F.transform(F.slice(r, 1, period - 1), lambda v: v * v)))
        shares = lambda p: F.when(p > 0, let(F.transform(sums, lambda v: v / p), above))
        return F.coalesce((F.size(c) >= 3 * period) & let(dot(c, c), shares), F.lit(False))

    return windows.withColumn("seasonal", let(centred(F.col(array_col)), test))


def seasonal_adjust(windows: DataFrame, period: int, array_col: str = "window") -> DataFrame:
    """Classical multiplicative decomposition: factors (normed to mean 1) and adjusted values; unchanged where not seasonal."""
    rows = seasonality_test(windows, period, array_col)
    if period <= 1:
        return rows.withColumns({"factors": F.array(F.lit(1.0)), "adjusted": F.col(array_col)})
    x, n, half = F.col(array_col), F.size(array_col), period // 2
    # 2 x m moving average for even m: the ends of the span count half
    span = lambda i: F.slice(x, i - half + 1, F.lit(2 * half + 1))
    ends = lambda i: (F.element_at(x, i - half + 1) + F.element_at(x, i + half + 1)) / 2 if period % 2 == 0 else F.lit(0.0)
    inside = F.sequence(F.lit(half), F.greatest(n - half - 1, F.lit(half)))
    ratios = F.transform(inside, lambda i: F.struct((i % period).alias("s"), (F.element_at(x, i + 1) / ((total(span(i)) - ends(i)) / period)).alias("r")))
    raw = let(ratios, lambda q: F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda s: mean(F.transform(F.filter(q, lambda r: r["s"] == s), lambda r: r["r"]))))
    good = lambda q: F.coalesce(F.col("seasonal") & (n > 2 * half) & F.forall(q, lambda v: v.isNotNull() & (v > 0)), F.lit(False))
    normed = lambda q: let(mean(q), lambda m: F.transform(q, lambda v: v / m))
    plain = F.array_repeat(F.lit(1.0), period)
    # the factors are null where the series is not adjusted; the explode keeps them from being computed again for each value
    rows = rows.withColumn("k_", F.explode(F.array(F.when(F.col("seasonal"), let(raw, lambda q: F.when(good(q), normed(q)))))))
    rows = rows.withColumns({"seasonal": F.col("k_").isNotNull(), "factors": F.coalesce("k_", plain)}).drop("k_")
    return rows.withColumn("adjusted", let(F.col("factors"), lambda f: F.transform(x, lambda v, i: v / F.element_at(f, (i % period) + 1))))


FIT = "struct<sse:double,alpha:double,beta:double,phi:double,level:double,slope:double>"
#: The points of each method's grid: (alpha, beta, phi). Of equal errors the first one wins.
GRIDS = {"ses": [(a, 0.0, 0.0) for a in ALPHAS], "holt": list(itertools.product(ALPHAS, BETAS, (1.0,))), "damped": list(itertools.product(ALPHAS, BETAS, PHIS))}
#: The first steps of the search from a grid's best point, and the bounds of (alpha, beta, phi).
STEPS = {"ses": (0.05, 0.0, 0.0), "holt": (0.05, 0.1, 0.0), "damped": (0.05, 0.1, 0.05)}
LOW, HIGH = (0.01, 0.001, 0.8), (0.99, 0.99, 0.98)
AT_ONCE = 1 << 20  # windows times points in one step of the kernel


def _smoothed(x: np.ndarray, points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of squared one-step errors, last level, last slope), each rows x points; points are (alpha, beta, phi) in the last axis."""
    alpha, beta, phi = points[..., 0], points[..., 1], points[..., 2]
    level = np.repeat(x[:, least - 1, None], points.shape[-2], 1)
    slope = np.repeat(x[:, 1, None] - x[:, 0, None], points.shape[-2], 1) if least == 2 else np.zeros_like(level)
    sse = np.zeros_like(level)
    for k in range(least, x.shape[1]):
        guess = level + phi * slope
        error = x[:, k, None] - guess
        sse += error * error
        level = guess + alpha * error
        slope = phi * slope + alpha * beta * error
    return sse, level, slope


def fit_rows(values: list, method: str, rounds: int = ROUNDS) -> list[tuple | None]:
    """The weights with the least squared one-step error for each array, with the error and the last level and slope: (sse, alpha, beta, phi, level, slope).

    The best point of the method's grid, and from there ``rounds`` rounds of a search, so no error is above the grid's. SES starts from the first value; the others
    from the second, with the first difference as slope. What is too short is None.
    """
    grid = np.array(GRIDS[method], float)
    least = 1 if method == "ses" else 2
    arrays = [None if v is None else np.asarray(v, float) for v in values]
    out: list[tuple | None] = [None] * len(arrays)
    lengths: dict[int, list[int]] = {}
    for k, x in enumerate(arrays):
        if x is not None and len(x) >= least:
            lengths.setdefault(len(x), []).append(k)
    step = max(1, AT_ONCE // len(grid))
    for rows in lengths.values():
        for begin in range(0, len(rows), step):
            at = rows[begin : begin + step]
            x = np.stack([arrays[k] for k in at])
            error = lambda points, x=x: _smoothed(x, points, least)[0]
            sse = error(grid[None])
            best = pattern_search(error, grid[np.where(np.isnan(sse), np.inf, sse).argmin(1)], STEPS[method], LOW, HIGH, rounds)
            fits = np.column_stack([best, *(f[:, 0] for f in _smoothed(x, best[:, None, :], least))])
            for k, (alpha, beta, phi, sse_, level, slope) in zip(at, fits.tolist(), strict=True):
                out[k] = (sse_, alpha, beta, phi, level, slope)
    return out


def smoothing_fits(x: Column, methods: tuple[str, ...] = ("ses", "holt", "damped")) -> Column:
    """A struct with a field for each method: (sse, alpha, beta, phi, level, slope)."""
    names = ("sse", "alpha", "beta", "phi", "level", "slope")

    @F.pandas_udf(", ".join(f"{m} {FIT}" for m in methods))
    def fits(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({m: [None if f is None else dict(zip(names, f, strict=True)) for f in fit_rows(list(values), m)] for m in methods})

    return fits(x)


def _values(period: int) -> dict[str, Callable[[Column], Column]]:
    """The mean at step h of each method, from what ``_prepared`` adds."""
    back = lambda h: F.element_at("factors", ((F.col("n_") + h - 1) % period).cast("int") + 1) if period > 1 else F.lit(1.0)
    fit = lambda m, f: F.col(f"f_.{m}.{f}")
    damp = lambda h: fit("damped", "phi") * (1 - F.pow(fit("damped", "phi"), h)) / (1 - fit("damped", "phi"))
    cycle = F.least(F.lit(max(period, 1)), F.col("n_"))
    return {
        "naive": lambda h: F.col("x_"),
        "snaive": lambda h: F.element_at("raw_", F.col("n_") - cycle + ((h - 1) % cycle) + 1),
        "rw_drift": lambda h: F.col("x_") + h * F.col("drift_"),
        "naive2": lambda h: F.element_at("adjusted", -1) * back(h),
        "ses": lambda h: fit("ses", "level") * back(h),
        "holt": lambda h: (fit("holt", "level") + h * fit("holt", "slope")) * back(h),
        "damped": lambda h: (fit("damped", "level") + damp(h) * fit("damped", "slope")) * back(h),
        "theta": lambda h: (fit("ses", "level") + 0.5 * F.col("s_") * h) * back(h),
    }


def _errors(period: int) -> dict[str, Callable[[Column], Column]]:
    """The standard error at step h of each method.

    The smoothing methods are linear in their one-step errors of deviation sigma: with weights alpha for the level and b = alpha beta for the slope an error
    moves the forecast j steps later by alpha + b (phi + phi ** 2 + ... + phi ** j), so the variance at step h is sigma ** 2 (1 + the sum of these squares for j < h).
    What is restored by seasonal factors has errors in proportion.
    """
    back = lambda h: F.element_at("factors", ((F.col("n_") + h - 1) % period).cast("int") + 1) if period > 1 else F.lit(1.0)
    fit = lambda m, f: F.col(f"f_.{m}.{f}")
    sigma = lambda m, first: F.when(F.col("n_") > first, F.sqrt(fit(m, "sse") / (F.col("n_") - first)))
    level = lambda h: sigma("ses", 1) * F.sqrt(1 + (h - 1) * fit("ses", "alpha") * fit("ses", "alpha")) * back(h)
    b = lambda m: fit(m, "alpha") * fit(m, "beta")
    reach = lambda j: fit("damped", "alpha") + b("damped") * fit("damped", "phi") * (1 - F.pow(fit("damped", "phi"), j)) / (1 - fit("damped", "phi"))
    squares = lambda h: F.when(h > 1, F.aggregate(F.sequence(F.lit(1), h - 1), F.lit(0.0), lambda a, j: a + reach(j) * reach(j))).otherwise(0.0)
    line = lambda h: (h - 1) * fit("holt", "alpha") * fit("holt", "alpha") + fit("holt", "alpha") * b("holt") * h * (h - 1) + b("holt") * b("holt") * (h - 1) * h * (2 * h - 1) / 6
    return {
        "naive": lambda h: F.col("sd1_") * F.sqrt(h),
        "snaive": lambda h: F.col("sdm_") * F.sqrt(F.floor((h - 1) / max(period, 1)) + 1),
        "rw_drift": lambda h: F.col("sdd_") * F.sqrt(h * (1 + h / (F.col("n_") - 1))),
        "naive2": lambda h: F.col("sda_") * F.sqrt(h) * back(h),
        "ses": level,
        "holt": lambda h: sigma("holt", 2) * F.sqrt(1 + line(h)) * back(h),
        "damped": lambda h: sigma("damped", 2) * F.sqrt(1 + squares(h)) * back(h),
        "theta": level,
    }


POOL = ("naive", "snaive", "rw_drift", "naive2", "ses", "holt", "damped", "theta")


def _prepared(windows: DataFrame, models: list[str], period: int, array_col: str, errors: bool = False) -> DataFrame:
    """What the models need of a window, each once: last value, drift, adjusted values with factors, fits of all smoothing methods, slope."""
    rows = seasonal_adjust(windows, period, array_col)
    x, n = F.col(array_col), F.size(array_col)
    rows = rows.withColumns({"raw_": x, "n_": n, "x_": F.element_at(x, -1), "drift_": (F.element_at(x, -1) - F.element_at(x, 1)) / (n - 1)})
    methods = tuple(m for m in GRIDS if m in models or (m == "ses" and "theta" in models))
    if methods:
        rows = settled(rows, "adjusted").withColumn("f_", smoothing_fits(F.col("adjusted"), methods))
    if errors:
        drift = let(F.col("drift_"), lambda b: F.transform(diff(x), lambda v: v - b))
        rows = rows.withColumns({"sd1_": residual_sd(x), "sdm_": residual_sd(x, max(period, 1)), "sda_": residual_sd(F.col("adjusted")), "sdd_": let(drift, lambda e: F.when(n > 1, F.sqrt(dot(e, e) / (n - 1))))})
    return rows.withColumn("s_", let(F.col("adjusted"), slope_of)) if "theta" in models else rows


def forecast_pool(windows: DataFrame, horizon: int, models: list[str] | None = None, period: int = 1, done: DataFrame | None = None, array_col: str = "window", keep: list[str] | None = None, errors: bool = False) -> DataFrame:
    """(input_key, model, h, mean) of all models on all windows, in one pass; ``keep``: other columns of the windows that go along; ``errors``: with ``se``.

    Keys (input_key, model) that are done already give no rows, and windows of which all models are done are not computed.
    """
    names = list(models or POOL)
    if unknown := set(names) - set(POOL):
        raise ValueError(f"unknown models: {sorted(unknown)}")
    keep, todo = list(keep or []), F.array(*map(F.lit, names))
    if done is not None:
        have = done.where(F.col("model").isin(names)).groupBy("input_key").agg(F.collect_set("model").alias("done_"))  # models a key at most
        windows = windows.join(have, "input_key", "left")
        todo = F.array_except(todo, F.coalesce("done_", F.array().cast("array<string>")))
        windows = windows.withColumn("todo_", todo).where(F.size("todo_") > 0)
        todo = F.col("todo_")
    values, spread = _values(period), _errors(period)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    at = lambda m: lambda h: F.struct(values[m](h).alias("mean"), *([spread[m](h).alias("se")] if errors else []))
    paths = F.array(*[F.struct(F.lit(m).alias("model"), F.transform(steps, at(m)).alias("path")) for m in names])
    rows = _prepared(windows, names, period, array_col, errors).select("input_key", *keep, F.explode(F.filter(paths, lambda p: F.array_contains(todo, p["model"]))).alias("p_"))
    rows = rows.select("input_key", F.col("p_.model").alias("model"), *keep, F.posexplode("p_.path").alias("h", "path_"))
    return rows.select("input_key", "model", *keep, (F.col("h") + 1).alias("h"), "path_.*")


def fc_naive2(windows: DataFrame, horizon: int, period: int = 1, array_col: str = "window") -> DataFrame:
    """Naive on the seasonally adjusted raw history, restored."""
    return forecast_pool(windows, horizon, ["naive2"], period, array_col=array_col)


def fc_ses(windows: DataFrame, horizon: int, period: int = 1, array_col: str = "window") -> DataFrame:
    """Simple exponential smoothing of the adjusted values, restored."""
    return forecast_pool(windows, horizon, ["ses"], period, array_col=array_col)


def fc_holt(windows: DataFrame, horizon: int, period: int = 1, array_col: str = "window") -> DataFrame:
    """Linear smoothing of the adjusted values, restored."""
    return forecast_pool(windows, horizon, ["holt"], period, array_col=array_col)


def fc_damped(windows: DataFrame, horizon: int, period: int = 1, array_col: str = "window") -> DataFrame:
    """Damped linear smoothing of the adjusted values, restored."""
    return forecast_pool(windows, horizon, ["damped"], period, array_col=array_col)


def slope_of(x: Column) -> Column:
    """Least-squares slope on the position."""
    n = F.size(x)
    centre = (n - 1) / 2
    up = total(F.transform(x, lambda v, i: v * (i - centre)))
    return F.when(n > 1, up / (n * (F.pow(n, 2) - 1) / 12))


def fc_theta(windows: DataFrame, horizon: int, period: int = 1, array_col: str = "window") -> DataFrame:
    """SES plus half of the least-squares slope a step; se = sigma sqrt(1 + (h - 1) alpha ** 2) of the SES, restored like the mean."""
    back = F.element_at("factors", ((F.col("n_") + F.col("h") - 1) % period).cast("int") + 1) if period > 1 else F.lit(1.0)
    fit = F.col("f_.ses")
    rows = _prepared(windows, ["theta"], period, array_col).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    sigma = F.when(F.col("n_") > 1, F.sqrt(fit["sse"] / (F.col("n_") - 1)))
    return rows.select("input_key", F.lit("theta").alias("model"), "h", _values(period)["theta"](F.col("h")).alias("mean"), (sigma * F.sqrt(1 + (F.col("h") - 1) * fit["alpha"] * fit["alpha"]) * back).alias("se"))


def interval_quantiles(forecasts: DataFrame, levels: list[float]) -> DataFrame:
    """mean + z se for each level; the middle level is the mean itself."""
    z = F.array(*[F.struct(F.lit(float(p)).alias("level"), F.lit(0.0 if p == 0.5 else NormalDist().inv_cdf(p)).alias("z")) for p in levels])
    rows = forecasts.withColumn("l_", F.explode(z))
    return rows.select("input_key", "model", "h", F.col("l_.level").alias("level"), (F.col("mean") + F.col("l_.z") * F.col("se")).alias("q"))


def _path_errors(x: np.ndarray, fits: np.ndarray, least: int) -> np.ndarray:
    """One-step errors of rows at their fitted weights (alpha, beta, phi), less their mean."""
    alpha, beta, phi = fits.T
    level, slope = x[:, least - 1].copy(), x[:, 1] - x[:, 0] if least == 2 else np.zeros(len(x))
    out = np.empty((len(x), x.shape[1] - least))
    for k in range(least, x.shape[1]):
        guess = level + phi * slope
        out[:, k - least] = error = x[:, k] - guess
        level, slope = guess + alpha * error, phi * slope + alpha * beta * error
    return out - out.mean(1, keepdims=True)


def _paths(fit: tuple, errors: np.ndarray) -> np.ndarray:
    """Futures of one window (paths x horizon) that go on from its last state with these errors."""
    _, alpha, beta, phi, level, slope = fit
    level, slope, out = np.full(len(errors), level), np.full(len(errors), slope), np.empty_like(errors)
    for h in range(errors.shape[1]):
        guess = level + phi * slope
        out[:, h] = guess + errors[:, h]
        level, slope = guess + alpha * errors[:, h], phi * slope + alpha * beta * errors[:, h]
    return out


def mixture_quantiles(windows: DataFrame, horizon: int, levels: list[float], models: tuple[str, ...] = ("ses", "holt", "damped"), period: int = 1, paths: int = 1000, seed: int = 1234, model: str = "comb", array_col: str = "window") -> DataFrame:
    """(input_key, model, h, level, q): quantiles of the equal mixture of smoothing methods, which have no closed form, by ``paths`` simulated futures of each method.

    A future draws its errors from the window's own one-step errors at the fitted weights, moves the states by them, and is restored by the seasonal factors; quantiles
    are median-unbiased (type 8). The draws depend on the seed and the window's key only, so a rerun gives the same rows however they are dealt. Windows of less than four values have none.
    """
    if bad := set(models) - set(GRIDS):
        raise ValueError(f"no paths for {sorted(bad)}")

    @F.pandas_udf("array<array<double>>")
    def drawn(keys: pd.Series, values: pd.Series, factors: pd.Series) -> pd.Series:
        arrays = [None if v is None or len(v) < 4 else np.asarray(v, float) for v in values]
        fits = {m: fit_rows(arrays, m) for m in models}
        out = []
        for row, (key, x, back) in enumerate(zip(keys, arrays, factors, strict=True)):
            if x is None or not np.isfinite(x).all():
                out.append(None)
                continue
            rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
            futures = []
            for m in models:
                fit = fits[m][row]
                past = _path_errors(x[None], np.array([fit[1:4]]), 1 if m == "ses" else 2)[0]
                futures.append(_paths(fit, past[rng.integers(len(past), size=(paths, horizon))]))
            q = np.quantile(np.concatenate(futures), levels, axis=0, method="median_unbiased")
            back = np.asarray(back, float)
            out.append((q * back[(len(x) + np.arange(horizon)) % len(back)]).T.tolist())
        return pd.Series(out)

    rows = settled(seasonal_adjust(windows, period, array_col), "adjusted", "factors")
    rows = rows.select("input_key", F.posexplode(drawn(F.col("input_key"), F.col("adjusted"), F.col("factors"))).alias("h", "q_"))
    rows = rows.select("input_key", (F.col("h") + 1).alias("h"), F.explode(F.arrays_zip(F.array(*map(F.lit, map(float, levels))).alias("level"), F.col("q_").alias("q"))).alias("z"))
    return rows.select("input_key", F.lit(model).alias("model"), "h", F.col("z.level").alias("level"), F.col("z.q").alias("q"))


def forecast_fallback(primary: DataFrame, alternate: DataFrame, requested: str, executed: str) -> DataFrame:
    """The primary result of each (input_key, h), or the one approved alternative where it is missing or not finite."""
    good = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") != float("inf"))
    rows = primary.select("input_key", "h", F.col("mean").alias("p")).join(alternate.select("input_key", "h", F.col("mean").alias("a")), ["input_key", "h"], "full_outer")
    bad = F.max((~F.coalesce(good, F.lit(False))).cast("int")).over(Window.partitionBy("input_key")) == 1  # a series never mixes two methods
    rows = rows.withColumn("fallback_used", bad)
    return rows.select("input_key", "h", F.lit(requested).alias("requested"), F.when(F.col("fallback_used"), executed).otherwise(requested).alias("executed"), "fallback_used", F.when(F.col("fallback_used"), F.col("a")).otherwise(F.col("p")).alias("mean"))


def forecast_contract(forecasts: DataFrame, quantiles: DataFrame, horizon: int, levels: list[float]) -> DataFrame:
    """Violation rows (input_key, model, violation); empty if all is right."""
    bad = F.col("mean").isNull() | F.isnan("mean") | (F.abs("mean") == float("inf"))
    means = forecasts.groupBy("input_key", "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("nh"), F.count_if(bad).alias("nb"))
    first = means.withColumn("violation", F.when(F.col("nb") > 0, "not finite").when((F.col("n") != horizon) | (F.col("nh") != horizon), "horizon"))
    order = Window.partitionBy("input_key", "model", "h").orderBy("level")
    steps = quantiles.withColumn("falls", F.col("q") < F.lag("q").over(order)).groupBy("input_key", "model", "h").agg(F.count_if("falls").alias("nf"), F.sort_array(F.collect_list("level")).alias("ls"), F.max(F.when(F.col("level") == 0.5, F.col("q"))).alias("median"))
    checked = steps.withColumn("violation", F.when(F.col("ls") != F.array(*map(F.lit, sorted(map(float, levels)))), "levels").when(F.col("nf") > 0, "crossing"))
    return first.select("input_key", "model", "violation").unionByName(checked.select("input_key", "model", "violation")).where("violation is not null").distinct()


def noncrossing_quantiles(quantiles: DataFrame) -> DataFrame:
    """Quantiles of each step in ascending order on the same levels, and whether that moved any."""
    keys = ["input_key", "model", "h"]
    rows = quantiles.groupBy(*keys).agg(F.sort_array(F.collect_list("level")).alias("ls"), F.sort_array(F.collect_list("q")).alias("qs"), F.transform(F.sort_array(F.collect_list(F.struct("level", "q"))), lambda s: s["q"]).alias("old"))
    return rows.select(*keys, F.explode(F.arrays_zip("ls", "qs")).alias("z"), (F.col("qs") != F.col("old")).alias("rearranged")).select(*keys, F.col("z.ls").alias("level"), F.col("z.qs").alias("q"), "rearranged")


def apply_forecaster(windows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], horizon: int, model: str = "user", array_col: str = "window") -> DataFrame:
    """Any function history -> ``horizon`` values, a row at a time in Arrow batches; a failure is reported for its key, others stay.

    Returns (input_key, model, mean array, error). Only the history is passed.
    """
    def run(batches):
        for pdf in batches:
            out = []
            for v in pdf["x"]:
                try:
                    y = np.asarray(fn(np.asarray(v, float)), float)
                    if y.shape != (horizon,) or not np.isfinite(y).all():
                        raise ValueError(f"not {horizon} finite values")
                    out.append((y.tolist(), None))
                except Exception as e:  # the user's function may raise anything
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"input_key": pdf["input_key"], "model": model, "mean": [a for a, _ in out], "error": [b for _, b in out]})

    return windows.select("input_key", F.col(array_col).alias("x")).mapInPandas(run, "input_key string, model string, mean array<double>, error string")


def prediction_contract(labels: DataFrame, horizon: int) -> DataFrame:
    """Keys that have not exactly one label of 0 or 1 for each horizon."""
    facts = labels.groupBy("input_key", "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("nh"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("nb"))
    return facts.where((F.col("n") != horizon) | (F.col("nh") != horizon) | (F.col("nb") > 0)).select("input_key", "model")
