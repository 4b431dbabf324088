"""Local regression and seasonal-trend decomposition of many series of one length at once, robust to outliers."""

from __future__ import annotations

import numpy as np

#: Robust rounds of a decomposition; inner rounds of the seasonal one; cycles in the span of its seasonal part.
ROBUST, INNER, SEASONS = 5, 2, 11
DENSE = 512  # longest series whose local sums are matrix products


def odd(x: float) -> int:
    """The next odd number."""
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def trend_span(n: int) -> int:
    """The span of the trend of a series without season: a quarter of it, 7 values at least."""
    return odd(max(7, n / 4))


def neighbours(n: int, span: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, distance, tricube weight) of the ``span`` values of 0 .. n - 1 nearest to each place, places x span; a span beyond n widens the weights."""
    q = min(span, n)
    first = np.clip(np.asarray(at) - (q - 1) // 2, 0, n - q)
    index = first[:, None] + np.arange(q)
    distance = index - np.asarray(at)[:, None]
    reach = np.abs(distance).max(1, keepdims=True) + max(span - n, 0) // 2
    weight = (1 - np.minimum(np.abs(distance) / np.maximum(reach, 1), 1) ** 3) ** 3
    return index, distance.astype(float), weight


def loess(x: np.ndarray, span: int, at: np.ndarray | None = None, trust: np.ndarray | None = None) -> np.ndarray:
    """Local lines through the rows of ``x`` (rows x n), evaluated at the places ``at`` (all values of the row); ``trust``: a weight of each value.

    Where only one value has weight it is a local mean; where none has, the nearest value.
    """
    n = x.shape[1]
    index, d, w = neighbours(n, span, np.arange(n) if at is None else at)
    if n <= DENSE:
        return _dense_loess(x, index, d, w, trust)
    out = np.empty((len(x), len(index)))
    step = max(1, (1 << 22) // max(index.size, 1))
    for k in range(0, len(x), step):
        y = x[k : k + step][:, index]
        v = np.broadcast_to(w, y.shape) if trust is None else w * trust[k : k + step][:, index]
        s0, s1, s2 = v.sum(2), (v * d).sum(2), (v * d * d).sum(2)
        t0, t1 = (v * y).sum(2), (v * d * y).sum(2)
        under = s0 * s2 - s1 * s1
        with np.errstate(divide="ignore", invalid="ignore"):
            line, flat = (s2 * t0 - s1 * t1) / under, t0 / s0
        near = np.take_along_axis(y, np.broadcast_to(np.abs(d).argmin(1)[None, :, None], (*y.shape[:2], 1)), 2)[..., 0]
        out[k : k + step] = np.where(s0 <= 0, near, np.where(under > 1e-9 * np.maximum(s0 * s0, 1e-300), line, flat))
    return out


def _dense_loess(x: np.ndarray, index: np.ndarray, d: np.ndarray, w: np.ndarray, trust: np.ndarray | None) -> np.ndarray:
    """The same lines with the neighbours' weights as matrices of all values by places, so that every sum is one product for all rows."""
    places = np.arange(len(index))[:, None]
    m0, m1, m2 = np.zeros((3, x.shape[1], len(index)))
    m0[index, places], m1[index, places], m2[index, places] = w, w * d, w * d * d
    q = np.ones((1, x.shape[1])) if trust is None else trust
    s0, s1, s2, t0, t1 = q @ m0, q @ m1, q @ m2, (q * x) @ m0, (q * x) @ m1
    under = s0 * s2 - s1 * s1
    with np.errstate(divide="ignore", invalid="ignore"):
        line, flat = (s2 * t0 - s1 * t1) / under, t0 / s0
    near = x[:, index[places[:, 0], np.abs(d).argmin(1)]]
    return np.where(s0 <= 0, near, np.where(under > 1e-9 * np.maximum(s0 * s0, 1e-300), line, flat))


def bisquare(rest: np.ndarray) -> np.ndarray:
    """Weights of values by their remainders: (1 - (r / reach) ** 2) ** 2, 0 beyond a reach of six medians or, where most remainders are tiny, of two means."""
    size = np.abs(rest)
    reach = np.maximum(6 * np.median(size, 1, keepdims=True), 2 * size.mean(1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(reach > 0, size / reach, 0.0)
    return np.where(share < 1, (1 - share**2) ** 2, 0.0)


def local_trend(x: np.ndarray, span: int | None = None, rounds: int = ROBUST) -> np.ndarray:
    """The trend of series without season: a local regression, and ``rounds`` more with weights by the remainders."""
    span = span or trend_span(x.shape[1])
    trend = loess(x, span)
    for _ in range(rounds):
        trend = loess(x, span, trust=bisquare(x - trend))
    return trend


def _means(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.pad(x, ((0, 0), (1, 0))), 1)
    return (total[:, width:] - total[:, :-width]) / width


def seasonal_trend(x: np.ndarray, period: int, seasons: int = SEASONS, rounds: int = ROBUST, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(trend, season) of series with a period, both rows x n, by local regressions.

    In turns: the values of each phase less the trend are smoothed over cycles, a cycle beyond both ends; what of that moves slower than a cycle is taken out; what is left is the
    season, and the trend is smoothed from the values less the season. After each of ``rounds`` such rounds values far from trend plus season lose their weight.
    """
    n = x.shape[1]
    span, low = odd(1.5 * period / (1 - 1.5 / seasons)), odd(period)
    trend, season, trust = np.zeros_like(x), np.zeros_like(x), None
    for turn in range(rounds + 1):
        for _ in range(inner):
            cycle = np.empty((len(x), n + 2 * period))
            for phase in range(period):
                part = (x - trend)[:, phase::period]
                places = np.arange(-1, part.shape[1] + 1)
                cycle[:, phase : phase + (len(places) - 1) * period + 1 : period] = loess(part, seasons, places, None if trust is None else trust[:, phase::period])
            slow = loess(_means(_means(_means(cycle, period), period), 3), low)
            season = cycle[:, period : period + n] - slow
            trend = loess(x - season, span, trust=trust)
        if turn < rounds:
            trust = bisquare(x - trend - season)
    return trend, season
