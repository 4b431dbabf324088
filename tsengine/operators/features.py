"""Reusable features of windows. Windows are z-scored first; every function adds columns and leaves the rows as they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import acf, centred, diff, dot, lagged, let, mean, settled, total, variance
from ..functions.decompose import local_trend, seasonal_trend
from ..functions.search import pattern_search

# The published order of the features; arch_lm is ARCH.LM there.
PUBLISHED = (
    "x_acf1", "x_acf10", "diff1_acf1", "diff1_acf10", "diff2_acf1", "diff2_acf10", "seas_acf1", "arch_lm", "crossing_points", "entropy", "flat_spots", "arch_acf", "garch_acf", "arch_r2", "garch_r2", "alpha", "beta",
    "hurst", "lumpiness", "nonlinearity", "x_pacf5", "diff1x_pacf5", "diff2x_pacf5", "seas_pacf", "nperiods", "seasonal_period", "trend", "spike", "linearity", "curvature", "e_acf1", "e_acf10",
    "seasonal_strength", "peak", "trough", "stability", "hw_alpha", "hw_beta", "hw_gamma", "unitroot_kpss", "unitroot_pp", "series_length",
)
# The vector that SQL can check: without garch_acf, garch_r2 and hw_gamma; _ma marks features of a moving-average decomposition instead of a smoother.
ORDER = (
    "x_acf1", "x_acf10", "diff1_acf1", "diff1_acf10", "diff2_acf1", "diff2_acf10", "seas_acf1", "arch_lm", "crossing_points", "entropy", "flat_spots", "arch_acf", "arch_r2", "alpha", "beta", "hurst",
    "lumpiness", "nonlinearity", "x_pacf5", "diff1x_pacf5", "diff2x_pacf5", "seas_pacf", "nperiods", "seasonal_period", "trend_ma", "spike_ma", "linearity_ma", "curvature_ma", "e_acf1_ma", "e_acf10_ma",
    "seasonal_strength_ma", "peak_ma", "trough_ma", "stability", "hw_alpha", "hw_beta", "unitroot_kpss", "unitroot_pp", "series_length",
)
PACF = ("x_pacf5", "diff1x_pacf5", "diff2x_pacf5", "seas_pacf")
UNITROOT = ("unitroot_kpss", "unitroot_pp")
DECOMP = ("trend_ma", "linearity_ma", "curvature_ma", "e_acf1_ma", "e_acf10_ma", "seasonal_strength_ma", "peak_ma", "trough_ma", "spike_ma")
STL = ("trend", "linearity", "curvature", "e_acf1", "e_acf10", "seasonal_strength", "peak", "trough", "spike")
SPECTRUM = ("entropy", "hurst")
GARCH = ("garch_acf", "garch_r2")
WINTERS = ("hw_alpha", "hw_beta", "hw_gamma")
SHAPE = ("nonlinearity", "arch_acf", "arch_r2")
AT_ONCE = 1 << 20  # values in one step of a kernel


def _with_python(rows: DataFrame, names: tuple[str, ...], fn) -> DataFrame:
    """Columns of doubles that a function gives for stacked z-scored arrays of one length (rows x n to rows x names); only the array goes to Python, in Arrow batches."""
    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def found(z: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(z), len(names)))
        lengths = z.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for some in np.array_split(at, -(-len(at) * max(n, 1) // AT_ONCE)):
                out[some] = fn(np.stack(z.iloc[some].to_list()).astype(float).reshape(len(some), n))
        return pd.DataFrame(out, columns=list(names))

    return settled(rows, "z").withColumn("py_", found("z")).withColumns({n: F.col(f"py_.{n}") for n in names}).drop("py_")


def z_scored(windows: DataFrame, array_col: str = "window", name: str = "z") -> DataFrame:
    """(v - mean) / sample deviation; zeros for a constant window."""
    rows = windows.withColumns({"z_mean": mean(F.col(array_col)), "z_sd": F.sqrt(variance(F.col(array_col)))})
    return rows.withColumn(name, let(F.struct(F.col("z_mean").alias("m"), F.col("z_sd").alias("s")), lambda q: F.transform(array_col, lambda v: F.when(q["s"] > 0, (v - q["m"]) / q["s"]).otherwise(F.lit(0.0))))).drop("z_mean", "z_sd")


def feat_shape(rows: DataFrame, period: int = 1) -> DataFrame:
    return rows.withColumns({"series_length": F.size("z").cast("double"), "nperiods": F.lit(float(period > 1)), "seasonal_period": F.lit(float(period))})


def feat_acf(rows: DataFrame, period: int = 1) -> DataFrame:
    """Autocorrelations of the values and of their first and second differences; ...10 is the sum of the first ten squares."""
    rows = rows.withColumns({"c0": centred(F.col("z")), "c1": centred(diff(F.col("z"))), "c2": centred(diff(diff(F.col("z"))))})
    out = {}
    for name, c in (("x", "c0"), ("diff1", "c1"), ("diff2", "c2")):
        out[f"{name}_acf1"] = let(F.col(c), lambda x: acf(x, 1))
        square = lambda x, k: F.pow(dot(F.slice(x, F.lit(1), F.greatest(F.size(x) - k, F.lit(0))), F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))), 2)
        ten = lambda x: let(dot(x, x), lambda p: F.when(p > 0, total(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: square(x, k))) / (p * p)))
        out[f"{name}_acf10"] = let(F.col(c), ten)
    out["seas_acf1"] = acf(F.col("c0"), period) if period > 1 else F.lit(None).cast("double")
    return rows.withColumns(out).drop("c0", "c1", "c2")


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def _per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b isn't positive."""
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def _pacf(x: np.ndarray, most: int) -> np.ndarray:
    """Partial autocorrelations of the rows at lags 1 to ``most`` by the Durbin-Levinson recursion; 0 for constant or shorter rows."""
    rows, n = x.shape
    out = np.zeros((rows, most))
    if n <= most:
        return out
    x = x - x.mean(1, keepdims=True)
    power = _dots(x, x)
    r = np.stack([_per(_dots(x[:, : n - k], x[:, k:]), power) for k in range(most + 1)], 1)
    phi, error = np.zeros((rows, 0)), np.ones(rows)
    for k in range(1, most + 1):
        rest = r[:, k] - _dots(phi, r[:, 1:k][:, ::-1])
        a = np.divide(rest, error, out=np.zeros(rows), where=error > 1e-12)
        phi = np.column_stack([phi - a[:, None] * phi[:, ::-1], a])
        error = error * (1 - a * a)
        out[:, k - 1] = a
    return np.where(power[:, None] > 0, out, 0.0)


def feat_pacf(rows: DataFrame, period: int = 1) -> DataFrame:
    """Sums of the first five squared partial autocorrelations of values and differences, and the one at the period."""
    return _with_python(rows, PACF, lambda x: _pacfs(x, period))


def _pacfs(x: np.ndarray, period: int) -> np.ndarray:
    sums = [(_pacf(np.diff(x, k), 5) ** 2).sum(1) if x.shape[1] > k else np.zeros(len(x)) for k in range(3)]
    return np.column_stack([*sums, _pacf(x, period)[:, -1] if period > 1 else np.zeros(len(x))])


def feat_crossing(rows: DataFrame) -> DataFrame:
    """How often neighbours lie on different sides of the median."""
    s = F.array_sort("z")
    n = F.size("z")
    rows = rows.withColumn("m_", (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)
    a, b = lagged(F.col("z"), 1)
    return rows.withColumn("crossing_points", let(F.col("m_"), lambda m: total(F.zip_with(a, b, lambda p, q: ((p > m) != (q > m)).cast("double"))))).drop("m_")


def feat_flat_spots(rows: DataFrame) -> DataFrame:
    """The longest run within one of ten equal ranges."""
    lo, hi = F.array_min("z"), F.array_max("z")
    bins = let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda e: F.transform("z", lambda v: F.when(e["hi"] > e["lo"], F.least(F.floor((v - e["lo"]) / (e["hi"] - e["lo"]) * 10), F.lit(9))).otherwise(F.lit(0)).cast("int")))
    rows = rows.withColumn("b_", bins)
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, b):
        run = F.when(a["bin"] == b, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(b.alias("bin"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return rows.withColumn("flat_spots", F.aggregate("b_", start, step, lambda a: a["best"].cast("double"))).drop("b_")


def feat_tiles(rows: DataFrame, width: int = 10) -> DataFrame:
    """Variance of the variances and of the means of complete tiles."""
    tiles = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("z") / width) - 1, F.lit(0)).cast("int")), lambda k: F.slice("z", k * width + 1, F.lit(width)))
    enough = F.size("z") >= 2 * width
    return rows.withColumns({"lumpiness": F.when(enough, variance(F.transform(tiles, variance))), "stability": F.when(enough, variance(F.transform(tiles, mean)))})


def _residuals(y: np.ndarray, columns: list[np.ndarray], least: float = 1e-12) -> np.ndarray:
    """Rows of y less their means and what the rows of the columns explain, one column after another; columns below the least power explain nothing."""
    middle = lambda v: v - v.mean(1, keepdims=True)
    y, columns = middle(y), [middle(c) for c in columns]
    while columns:
        c, *columns = columns
        power = _dots(c, c)
        share = lambda v, c=c, power=power: (np.divide(_dots(v, c), power, out=np.zeros(len(v)), where=power > least))[:, None] * c
        y = y - share(y)
        columns = [d - share(d) for d in columns]
    return y


def _lag_r2(x: np.ndarray, lags: int = 12, centre: bool = True) -> np.ndarray:
    """R squared of the squares on their own lags."""
    s = (x - x.mean(1, keepdims=True) if centre else x) ** 2
    n = s.shape[1]
    if n <= 2 * lags + 1:
        return np.zeros(len(x))
    y = s[:, lags:]
    rest, whole = _residuals(y, [s[:, lags - k : n - k] for k in range(1, lags + 1)], 1e-18), y - y.mean(1, keepdims=True)
    return np.where(s.std(1) > 0, 1 - _dots(rest, rest) / np.maximum(_dots(whole, whole), 1e-300), 0.0)


def feat_arch(rows: DataFrame) -> DataFrame:
    return _with_python(rows, ("arch_lm",), lambda x: _lag_r2(x)[:, None])


def feat_unitroot(rows: DataFrame) -> DataFrame:
    """KPSS level statistic with a Bartlett window of floor(4 (n/100)^0.25) lags; Phillips-Perron Z-alpha."""
    return _with_python(rows, UNITROOT, _unitroot)


def _long_run(e: np.ndarray, lags: int) -> np.ndarray:
    n = e.shape[1]
    return _dots(e, e) / n + 2 * sum((1 - k / (lags + 1)) * _dots(e[:, k:], e[:, : n - k]) / n for k in range(1, lags + 1))


def _unitroot(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    if n < 4:
        return np.zeros((len(x), 2))
    lags = int(4 * (n / 100) ** 0.25)
    e = x - x.mean(1, keepdims=True)
    s = np.cumsum(e, 1)
    kpss = _dots(s, s) / (n * n * np.maximum(_long_run(e, lags), 1e-300))
    y, l = x[:, 1:], x[:, :-1]
    lc = l - l.mean(1, keepdims=True)
    power = np.maximum(_dots(lc, lc), 1e-300)
    slope = _dots(lc, y) / power
    u = y - y.mean(1, keepdims=True) - slope[:, None] * lc
    m = n - 1
    g0, lr = _dots(u, u) / m, _long_run(u, lags)
    return np.where(x.std(1)[:, None] > 0, np.column_stack([kpss, m * (slope - 1) - 0.5 * (lr - g0) * m * m / power]), 0.0)


def feat_spectrum(rows: DataFrame) -> DataFrame:
    """Spectral entropy of the periodogram, from 0 to 1; and 0.5 plus the fractional order by log-periodogram regression over sqrt(n) frequencies, within 0.5 and 1."""
    return _with_python(rows, SPECTRUM, _spectrum)


def _spectrum(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    plain = np.tile([0.0, 0.5], (len(x), 1))
    if n < 8:
        return plain
    power = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)[:, 1 : n // 2 + 1]) ** 2
    share = power / np.maximum(power.sum(1, keepdims=True), 1e-300)
    entropy = -np.where(share > 1e-15, share * np.log(np.maximum(share, 1e-15)), 0.0).sum(1) / np.log(n // 2)
    m = int(np.sqrt(n))
    angle = np.log(4 * np.sin(np.pi * np.arange(1, m + 1) / n) ** 2)
    level = np.log(np.maximum(power[:, :m], 1e-12))
    a = angle - angle.mean()
    return np.where(x.std(1)[:, None] > 0, np.column_stack([entropy, 0.5 + np.clip(-(level @ a) / (a @ a), 0.0, 0.5)]), plain)


def feat_nonlinear(rows: DataFrame) -> DataFrame:
    """What squares and cubes of the value before explain of the residuals of a first-order regression (10 ln of the ratio of their sums of squares);
    and of the squared residuals, the sum of the first 12 squared autocorrelations and the R squared on 12 lags."""
    return _with_python(rows, SHAPE, _nonlinear)


def _square_acf(u: np.ndarray) -> np.ndarray:
    """The sum of the first 12 squared autocorrelations of the squares."""
    s = u * u - (u * u).mean(1, keepdims=True)
    return sum(_per(_dots(s[:, k:], s[:, :-k]), _dots(s, s)) ** 2 for k in range(1, 13))


def _nonlinear(x: np.ndarray) -> np.ndarray:
    if x.shape[1] < 40:
        return np.zeros((len(x), 3))
    before, y = x[:, :-1], x[:, 1:]
    u = _residuals(y, [before])
    v = _residuals(y, [before, before**2, before**3])
    s = u * u - (u * u).mean(1, keepdims=True)
    uu, vv = _dots(u, u), _dots(v, v)
    good = (uu >= 1e-9) & (vv >= 1e-9) & (_dots(s, s) >= 1e-9)
    ratio = 10 * np.log(np.maximum(uu, 1e-9) / np.maximum(vv, 1e-9))
    return np.where(good[:, None], np.column_stack([ratio, _square_acf(u), _lag_r2(u, centre=False)]), 0.0)


def feat_garch(rows: DataFrame) -> DataFrame:
    """The two heterogeneity features behind a GARCH(1,1): of the squared residuals of a first-order regression, divided by their fitted
    conditional deviations, the sum of the first 12 squared autocorrelations and the R squared on 12 lags."""
    return _with_python(rows, GARCH, _garch)


#: The grid (a, b) of a GARCH(1,1) fit, its first steps and bounds; a + b stays below ``PERSISTENT``.
VOLATILE, PERSISTENT = [(a, b) for a in (0.02, 0.05, 0.1, 0.2, 0.4) for b in (0.0, 0.2, 0.5, 0.7, 0.85) if a + b < 0.999], 0.999
VOLATILE_STEPS, VOLATILE_LOW, VOLATILE_HIGH = (0.05, 0.1), (0.0, 0.0), (0.99, 0.99)


def garch_fit(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((a, b) rows x 2, conditional variances rows x n) of h = s (1 - a - b) + a u_before ** 2 + b h_before, s the mean square, by quasi-likelihood over all rows at once."""
    square = u * u
    whole = np.maximum(square.mean(1), 1e-300)

    def path(points):
        a, b = points[..., 0], points[..., 1]
        h, out = np.repeat(whole[:, None], points.shape[-2], 1), []
        for k in range(u.shape[1]):
            h = whole[:, None] * (1 - a - b) + a * square[:, k - 1, None] + b * h if k else h
            out.append(h)
        return out

    def error(points):
        total = sum(np.log(np.maximum(h, 1e-300)) + square[:, k, None] / np.maximum(h, 1e-300) for k, h in enumerate(path(points)))
        return np.where(points.sum(-1) < PERSISTENT, total, np.inf)

    grid = np.array(VOLATILE)
    best = pattern_search(error, grid[error(np.broadcast_to(grid, (len(u), *grid.shape))).argmin(1)], VOLATILE_STEPS, VOLATILE_LOW, VOLATILE_HIGH)
    return best, np.stack([h[:, 0] for h in path(best[:, None, :])], 1)


def _garch(x: np.ndarray) -> np.ndarray:
    if x.shape[1] < 40:
        return np.zeros((len(x), 2))
    u = _residuals(x[:, 1:], [x[:, :-1]])
    good = _dots(u, u) >= 1e-9
    _, h = garch_fit(u)
    e = u / np.sqrt(np.maximum(h, 1e-12))
    return np.where(good[:, None], np.column_stack([_square_acf(e), _lag_r2(e, centre=False)]), 0.0)


def feat_decomp(rows: DataFrame, period: int = 1) -> DataFrame:
    """Trend, remainder and seasonal features of a centred moving-average decomposition."""
    return _with_python(rows, DECOMP, lambda x: _decomposed(x, period))


def feat_stl(rows: DataFrame, period: int = 1) -> DataFrame:
    """The same features of a decomposition by robust local regressions (``functions.decompose``), without season for period 1 and for less than two cycles."""
    return _with_python(rows, STL, lambda x: _stl(x, period))


def _averaged(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    n = x.shape[1]
    width = period if period > 1 else 5
    weights = np.full(width, 1.0) if width % 2 else np.r_[0.5, np.full(width - 1, 1.0), 0.5]
    half = len(weights) // 2
    padded = np.column_stack([np.repeat(x[:, :1], half, 1), x, np.repeat(x[:, -1:], half, 1)])
    trend = np.lib.stride_tricks.sliding_window_view(padded, len(weights), 1) @ (weights / weights.sum())
    season = np.zeros_like(x)
    if period > 1:
        means = np.stack([(x - trend)[:, k::period].mean(1) for k in range(period)], 1)
        season = (means - means.mean(1, keepdims=True))[:, np.arange(n) % period]
    return trend, season


def _decomposed(x: np.ndarray, period: int) -> np.ndarray:
    if x.shape[1] < 12:
        return np.zeros((len(x), 9))
    return _part_features(x, *_averaged(x, period), period)


def _stl(x: np.ndarray, period: int) -> np.ndarray:
    if x.shape[1] < 12:
        return np.zeros((len(x), 9))
    if period > 1 and x.shape[1] >= 2 * period:
        return _part_features(x, *seasonal_trend(x, period), period)
    return _part_features(x, local_trend(x), np.zeros_like(x), 1)


def _part_features(x: np.ndarray, trend: np.ndarray, season: np.ndarray, period: int) -> np.ndarray:
    """Strength, linearity and curvature of the trend, autocorrelations of the remainder, strength, peak and trough of the season, spikiness."""
    n = x.shape[1]
    rest = x - trend - season
    strength = lambda part: np.maximum(0.0, 1 - rest.var(1) / np.maximum((rest + part).var(1), 1e-300))
    t = np.arange(n) - (n - 1) / 2
    linear, quadratic = t / np.sqrt(t @ t), t * t - (t * t).mean()
    quadratic = quadratic / np.sqrt(quadratic @ quadratic)
    c = rest - rest.mean(1, keepdims=True)
    power = _dots(c, c)
    r = np.stack([_dots(c[:, k:], c[:, : n - k]) for k in range(1, 11)], 1) / np.maximum(power, 1e-300)[:, None]
    left_out = (power[:, None] - c * c * n / (n - 1)) / (n - 2)
    seasonal = [strength(season), season[:, :period].argmax(1) + 1.0, season[:, :period].argmin(1) + 1.0] if period > 1 else [np.zeros(len(x))] * 3
    out = np.column_stack([strength(trend), trend @ linear, trend @ quadratic, r[:, 0], (r**2).sum(1), *seasonal, left_out.var(1, ddof=1)])
    return np.where(x.std(1)[:, None] > 0, out, 0.0)


def feat_smoothing(rows: DataFrame) -> DataFrame:
    """Weights of the best fits of linear (alpha, beta) and damped (hw_alpha, hw_beta) smoothing."""
    from .forecast import smoothing_fits

    rows = settled(rows, "z").withColumn("f_", smoothing_fits(F.col("z"), ("holt", "damped")))
    return rows.withColumns({"alpha": F.col("f_.holt.alpha"), "beta": F.col("f_.holt.beta"), "hw_alpha": F.col("f_.damped.alpha"), "hw_beta": F.col("f_.damped.beta")}).drop("f_")


def feat_winters(rows: DataFrame, period: int = 1) -> DataFrame:
    """Weights of additive seasonal smoothing with a trend (for level, slope and season); 0 for period 1 and for less than two cycles."""
    from .winters import winters_fit

    def fn(x):
        if period < 2 or x.shape[1] <= 2 * period:
            return np.zeros((len(x), 3))
        return np.where(x.std(1)[:, None] > 0, winters_fit(x, period)["weights"], 0.0)

    return _with_python(rows, WINTERS, fn)


def _finite(c: str) -> Column:
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))


def feat_vector(rows: DataFrame, period: int = 1, key: str = "input_key") -> DataFrame:
    """The features of ``ORDER``, decomposed by moving averages; what is missing or not finite becomes 0."""
    rows = feat_smoothing(feat_tiles(feat_flat_spots(feat_crossing(feat_shape(feat_acf(rows, period), period)))))
    # all that needs Python, in one pass over the array
    rows = _with_python(rows, (*PACF, *DECOMP, "arch_lm", *UNITROOT, *SPECTRUM, *SHAPE), lambda x: np.column_stack([_pacfs(x, period), _decomposed(x, period), _lag_r2(x), _unitroot(x), _spectrum(x), _nonlinear(x)]))
    return rows.select(key, *[_finite(c).alias(c) for c in ORDER])


def feat_published(rows: DataFrame, period: int = 1, key: str = "input_key") -> DataFrame:
    """All 42 published features in their order, decomposed by local regressions; what is missing or not finite becomes 0."""
    rows = feat_smoothing(feat_tiles(feat_flat_spots(feat_crossing(feat_shape(feat_acf(rows, period), period))))).drop("hw_alpha", "hw_beta")
    rows = _with_python(rows, (*PACF, *STL, "arch_lm", *UNITROOT, *SPECTRUM, *SHAPE, *GARCH), lambda x: np.column_stack([_pacfs(x, period), _stl(x, period), _lag_r2(x), _unitroot(x), _spectrum(x), _nonlinear(x), _garch(x)]))
    return feat_winters(rows, period).select(key, *[_finite(c).alias(c) for c in PUBLISHED])
