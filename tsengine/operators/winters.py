"""Additive smoothing with trend and season: a batched fit, forecasts with standard errors, and the choice between it and the methods without season."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.search import pattern_search
from .forecast import fit_rows

#: The grid of (alpha, beta, gamma) as shares: the slope's weight is alpha beta, the season's gamma (1 - alpha), which keeps the errors bounded. First steps and bounds of the search.
GRID = list(itertools.product((0.1, 0.3, 0.5, 0.8), (0.01, 0.1, 0.3), (0.05, 0.2, 0.5)))
STEPS, LOW, HIGH = (0.1, 0.05, 0.1), (0.01, 0.0, 0.0), (0.99, 0.99, 0.99)
AT_ONCE = 1 << 19  # windows times points in one step of the kernel
#: Fitted weights and states of each method, for the information criterion.
SIZES = {"ses": 2, "holt": 4, "damped": 5}


def _run(x: np.ndarray, points: np.ndarray, period: int):
    """(sum of squared one-step errors from the second cycle on, level, slope, season with the next phase first), rows x points."""
    m, (rows, n), k = period, x.shape, points.shape[-2]
    alpha, beta, gamma = points[..., 0], points[..., 0] * points[..., 1], points[..., 2] * (1 - points[..., 0])
    first = x[:, :m].mean(1)
    slope = np.repeat(((x[:, m : 2 * m].mean(1) - first) / m)[:, None], k, 1)
    level = first[:, None] + slope * (m - 1) / 2  # at the end of the first cycle
    season = np.repeat((x[:, :m] - first[:, None])[:, None, :] - slope[:, :1, None] * (np.arange(m) - (m - 1) / 2), k, 1)
    sse = np.zeros((rows, k))
    for t in range(m, n):
        s = season[..., t % m]
        error = x[:, t, None] - (level + slope + s)
        sse += error * error
        level = level + slope + alpha * error
        slope = slope + beta * error
        season[..., t % m] = s + gamma * error
    return sse, level, slope, np.roll(season, -(n % m), -1)


def winters_fit(x: np.ndarray, period: int) -> dict[str, np.ndarray]:
    """weights (alpha, beta, gamma), sse, level, slope and season (next phase first) of rows with more than two cycles, all rows at once: the best point of a grid, then a bounded search."""
    parts, grid = [], np.array(GRID)
    for some in np.array_split(x, max(1, -(-len(x) * len(grid) * period // AT_ONCE))):
        error = lambda points, some=some: _run(some, points, period)[0]
        start = grid[error(np.broadcast_to(grid, (len(some), *grid.shape))).argmin(1)]
        best = pattern_search(error, start, STEPS, LOW, HIGH)
        sse, level, slope, season = _run(some, best[:, None, :], period)
        parts.append((np.column_stack([best[:, 0], best[:, 0] * best[:, 1], best[:, 2] * (1 - best[:, 0])]), sse[:, 0], level[:, 0], slope[:, 0], season[:, 0]))
    return dict(zip(("weights", "sse", "level", "slope", "season"), map(np.concatenate, zip(*parts, strict=True)), strict=True))


def _by_length(values: pd.Series, least: int):
    """(positions, stacked rows) of the arrays of each length from ``least`` on."""
    lengths = values.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for n in np.unique(lengths[lengths >= least]):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack(values.iloc[at].to_list()).astype(float)


def _paths(fit: dict, n: int, horizon: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors, rows x horizon: an error moves the forecast j steps later by alpha + j beta, and gamma more where j is a whole number of cycles."""
    h = np.arange(1, horizon + 1)
    mean = fit["level"][:, None] + fit["slope"][:, None] * h + fit["season"][:, (h - 1) % period]
    alpha, beta, gamma = (fit["weights"][:, k, None] for k in range(3))
    moved = alpha + beta * h + gamma * (h % period == 0)
    spread = np.cumsum(np.column_stack([np.ones(len(mean)), moved[:, :-1] ** 2]), 1)
    return mean, np.sqrt(fit["sse"][:, None] / (n - period) * spread)


def fc_winters(windows: DataFrame, horizon: int, period: int, array_col: str = "window") -> DataFrame:
    """(input_key, model, h, mean, se); windows of two cycles or less, and period 1, give null means."""
    return _forecasts(windows, horizon, period, array_col, lambda values: _winters(values, horizon, period), "winters")


def _winters(values: pd.Series, horizon: int, period: int) -> pd.DataFrame:
    out = pd.DataFrame({"model": "winters", "mean": [None] * len(values), "se": [None] * len(values)})
    for at, x in _by_length(values, 2 * period + 1) if period > 1 else []:
        mean, se = _paths(winters_fit(x, period), x.shape[1], horizon, period)
        out.loc[at, "mean"], out.loc[at, "se"] = pd.Series(list(mean), at), pd.Series(list(se), at)
    return out


def _forecasts(windows: DataFrame, horizon: int, period: int, array_col: str, fn, model: str) -> DataFrame:
    @F.pandas_udf("model string, mean array<double>, se array<double>")
    def paths(values: pd.Series) -> pd.DataFrame:
        return fn(values)

    blank = F.array_repeat(F.lit(None).cast("double"), horizon)
    rows = windows.select("input_key", paths(F.col(array_col)).alias("p")).select("input_key", F.col("p.model").alias("model"), F.posexplode(F.arrays_zip(F.coalesce("p.mean", blank), F.coalesce("p.se", blank))).alias("h", "v"))
    return rows.select("input_key", "model", (F.col("h") + 1).alias("h"), F.col("v.0").alias("mean"), F.col("v.1").alias("se"))


def _linear(fits: list, method: str, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors of a method without season."""
    f = np.array([(np.nan,) * 6 if v is None else v for v in fits], float)
    sse, alpha, beta, phi, level, slope = (f[:, k, None] for k in range(6))
    h = np.arange(1, horizon + 1)
    reach = np.cumsum(phi ** h, 1) if method == "damped" else h * np.ones_like(phi)
    moved = alpha + (alpha * beta * reach if method != "ses" else 0.0 * reach)
    spread = np.cumsum(np.column_stack([np.ones(len(f)), moved[:, :-1] ** 2]), 1)
    return level + (slope * reach if method != "ses" else 0.0 * reach), spread


def fc_chosen(windows: DataFrame, horizon: int, period: int = 1, array_col: str = "window") -> DataFrame:
    """(input_key, model, h, mean, se) of one method a window: simple, linear, damped or, with more than two cycles, seasonal smoothing of the values as they are.

    The one with the least corrected information criterion n ln(mean squared one-step error) + 2 k n / (n - k - 1), k the number of weights and starting states; ties go to the earlier method.
    ``model`` names the method. Windows with less than ten values give null means.
    """
    def choose(values: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"model": [None] * len(values), "mean": [None] * len(values), "se": [None] * len(values)}, dtype=object)
        for at, x in _by_length(values, 10):
            n, seasonal = x.shape[1], period > 1 and x.shape[1] > 2 * period
            tried = []
            for method, size in SIZES.items():
                fits = fit_rows(list(x), method)
                mean, spread = _linear(fits, method, horizon)
                errors = n - (1 if method == "ses" else 2)
                tried.append((method, size, np.array([f[0] for f in fits]), errors, mean, spread))
            if seasonal:
                fit = winters_fit(x, period)
                mean, se = _paths(fit, n, horizon, period)
                spread = (se / np.maximum(se[:, :1], 1e-300)) ** 2
                tried.append(("winters", 5 + period, fit["sse"], n - period, mean, spread))
            square = np.stack([np.maximum(sse / errors, 1e-300) for _, _, sse, errors, _, _ in tried], 1)
            sizes = np.array([size for _, size, *_ in tried])
            score = n * np.log(square) + 2 * sizes * n / np.maximum(n - sizes - 1, 1e-9) + np.where(sizes < n - 1, 0, np.inf)
            best, row = score.argmin(1), np.arange(len(at))
            mean = np.stack([t[4] for t in tried], 1)[row, best]
            se = np.sqrt(square[row, best, None] * np.stack([t[5] for t in tried], 1)[row, best])
            out.loc[at, "model"] = np.array([t[0] for t in tried], object)[best]
            out.loc[at, "mean"], out.loc[at, "se"] = pd.Series(list(mean), at), pd.Series(list(se), at)
        return out

    return _forecasts(windows, horizon, period, array_col, choose, "chosen")
