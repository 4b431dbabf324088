"""Fits by bounded search, intervals, local regression, volatility, seasonal smoothing, cleaning with periods and by segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.functions import decompose
from tsengine.functions.search import pattern_search
from tsengine.operators import clean, features, forecast, winters


def win(spark, rows):
    return spark.createDataFrame([(f"k{i}", list(map(float, r))) for i, r in enumerate(rows)], "input_key string, window array<double>")


def walks(n, length, seed=1):
    return np.cumsum(np.random.default_rng(seed).normal(size=(n, length)), 1) + 50


def test_search_finds_the_bottom():
    goal = np.array([[0.31, 0.72], [0.5, 0.0], [2.0, 0.4]])  # the last one lies beyond the bounds
    found = pattern_search(lambda p: ((p - goal[:, None, :]) ** 2).sum(-1), np.array([[0.3, 0.6], [0.3, 0.4], [0.3, 0.6]]), (0.2, 0.2), (0.0, 0.1), (0.6, 1.0), 12)
    assert found == pytest.approx(np.array([[0.31, 0.72], [0.5, 0.1], [0.6, 0.4]]), abs=2e-4)


@pytest.mark.parametrize("method", ["ses", "holt", "damped"])
def test_fits_are_never_worse_than_the_grid(method):
    x = [*walks(150, 40), *np.random.default_rng(2).normal(size=(50, 40))]
    fits, grid = forecast.fit_rows(x, method), forecast.fit_rows(x, method, 0)
    assert all(a[0] <= b[0] for a, b in zip(fits, grid, strict=True)) and sum(a[0] < b[0] for a, b in zip(fits, grid, strict=True)) > 150
    fine = np.array([(a, b, p) for a in np.linspace(0.01, 0.99, 50) for b in (np.linspace(0.001, 0.99, 34) if method != "ses" else [0.0]) for p in ([0.0] if method == "ses" else [1.0] if method == "holt" else np.linspace(0.8, 0.98, 5))])
    best = np.concatenate([forecast._smoothed(row[None], fine[None], 1 if method == "ses" else 2)[0].min(1) for row in np.stack(x)])
    share = np.array([f[0] for f in fits]) / best
    assert np.median(share) < 1.0005 and (share < 1.02).mean() > 0.95  # a search from one start may end in another hollow
    assert forecast.fit_rows([None, [], [1.0], [2.0, 2.0, 2.0]], method)[0] is None


def simulated(kind, n, length, horizon, seed):
    """Series of a smoothing model with its own weights, and what comes after them."""
    draw = np.random.default_rng(seed)
    alpha, beta, phi = {"ses": (0.4, 0.0, 0.0), "holt": (0.4, 0.1, 1.0), "damped": (0.4, 0.2, 0.9)}[kind]
    level, slope, out = np.full(n, 100.0), np.full(n, 0.5 if kind != "ses" else 0.0), []
    for _ in range(length + horizon):
        error = draw.normal(size=n)
        guess = level + phi * slope
        out.append(guess + error)
        level, slope = guess + alpha * error, phi * slope + alpha * beta * error
    x = np.stack(out, 1)
    return x[:, :length], x[:, length:]


@pytest.mark.parametrize("kind", ["ses", "holt", "damped"])
def test_intervals_cover(spark, kind):
    x, after = simulated(kind, 400, 200, 8, 7)
    rows = forecast.forecast_pool(win(spark, x), 8, [kind], errors=True)
    actual = spark.createDataFrame([(f"k{i}", h + 1, float(v)) for i, row in enumerate(after) for h, v in enumerate(row)], "input_key string, h int, actual double")
    for level, z in ((0.8, 1.2815515655446008), (0.95, 1.959963984540054)):
        inside = rows.join(actual, ["input_key", "h"]).agg(F.avg((F.abs(F.col("actual") - F.col("mean")) <= z * F.col("se")).cast("int"))).first()[0]
        assert abs(inside - level) < 0.04


def test_pool_errors_agree(spark):
    w = win(spark, walks(6, 30))
    rows = {(r["input_key"], r["model"], r["h"]): r["se"] for r in forecast.forecast_pool(w, 5, errors=True).collect()}
    alone = [forecast.fc_naive(w, 5), forecast.fc_snaive(w, 5, 1), forecast.fc_rw_drift(w, 5), forecast.fc_theta(w, 5)]
    for frame in alone:
        for r in frame.collect():
            assert rows[r["input_key"], r["model"], r["h"]] == pytest.approx(r["se"], rel=1e-9)
    assert set(k[1] for k in rows) == set(forecast.POOL) and all(v > 0 for v in rows.values())
    again = forecast.forecast_pool(w, 5, errors=True).collect()
    assert {(r["input_key"], r["model"], r["h"]): r["se"] for r in again} == rows
    flat = forecast.forecast_pool(win(spark, [[3.0] * 20, [4.0, 4.0]]), 3, errors=True).where("input_key = 'k0'").agg(F.max("se"), F.max("mean")).first()
    assert tuple(flat) == (0.0, 3.0)



def test_mixture_quantiles(spark):
    x, after = simulated("holt", 300, 120, 6, 12)
    levels = [0.025, 0.1, 0.5, 0.9, 0.975]
    w = win(spark, x)
    got = {(r["input_key"], r["h"], r["level"]): r["q"] for r in forecast.mixture_quantiles(w, 6, levels, paths=400).collect()}
    again = {(r["input_key"], r["h"], r["level"]): r["q"] for r in forecast.mixture_quantiles(w.repartition(7), 6, levels, paths=400).collect()}
    assert got == again and len(got) == 300 * 6 * 5
    inside = np.mean([got[f"k{i}", h + 1, 0.1] <= after[i, h] <= got[f"k{i}", h + 1, 0.9] for i in range(300) for h in range(6)])
    wide = np.mean([got[f"k{i}", h + 1, 0.025] <= after[i, h] <= got[f"k{i}", h + 1, 0.975] for i in range(300) for h in range(6)])
    assert abs(inside - 0.8) < 0.06 and abs(wide - 0.95) < 0.04
    assert all(got[f"k{i}", h, 0.1] <= got[f"k{i}", h, 0.5] <= got[f"k{i}", h, 0.9] for i in range(300) for h in range(1, 7))
    season = win(spark, [[20.0, 40.0, 60.0] * 9, [1.0, 2.0]])
    rows = forecast.mixture_quantiles(season, 3, [0.1, 0.9], period=3, paths=50).orderBy("h", "level").collect()
    assert [r["q"] for r in rows] == pytest.approx([20, 20, 40, 40, 60, 60]) and {r["input_key"] for r in rows} == {"k0"}


def test_local_trend_and_season():
    t = np.arange(96.0)
    line, wave = 0.1 * t + 2, 3 * np.sin(2 * np.pi * t / 12)
    spike = np.where(t == 40, 30.0, 0.0)
    assert decompose.local_trend(np.stack([line, line + spike, np.full(96, 7.0)])) == pytest.approx(np.stack([line, line, np.full(96, 7.0)]), abs=1e-9)
    trend, season = decompose.seasonal_trend(np.stack([line, wave, line + wave]), 12)
    assert trend == pytest.approx(np.stack([line, 0 * t, line]), abs=1e-8) and season == pytest.approx(np.stack([0 * t, wave, wave]), abs=1e-8)
    noise = 0.2 * np.random.default_rng(1).normal(size=96)
    trend, season = decompose.seasonal_trend((line + wave + noise + spike)[None], 12)
    assert np.abs(trend[0] - line).max() < 0.4 and np.abs(season[0] - wave).max() < 0.6  # the spike moves neither
    assert decompose.loess(np.ones((1, 3)), 11, np.arange(-1, 4)) == pytest.approx(np.ones((1, 5)))


def test_features_in_batches(spark):
    x = walks(30, 64)
    rows = features.z_scored(win(spark, [*x, [1.0] * 64, x[0][:20], x[1][:8]]))
    got = features.feat_published(rows, 1).toPandas().set_index("input_key")
    assert list(got.columns) == list(features.PUBLISHED) and len(got.columns) == 42 and got.notna().all().all()
    alone = features.feat_published(rows.where("input_key = 'k3'"), 1).first()
    assert [alone[c] for c in features.PUBLISHED] == pytest.approx(list(got.loc["k3"]), rel=1e-9)
    assert (got.loc["k30", ["trend", "spike", "garch_acf", "hw_gamma"]] == 0).all() and (got.loc["k31", ["garch_acf", "arch_acf"]] == 0).all()
    t = np.arange(72)
    wave = features.z_scored(win(spark, [10 * np.sin(2 * np.pi * t / 12) + 0.1 * t, np.random.default_rng(1).normal(size=72)]))
    seasonal, plain = sorted(features.feat_stl(wave, 12).collect(), key=lambda r: r["input_key"])
    assert seasonal["seasonal_strength"] > 0.99 and plain["seasonal_strength"] < 0.8 and (seasonal["peak"], seasonal["trough"]) == (4, 10)


def test_volatility():
    draw, u = np.random.default_rng(5), np.zeros((80, 1500))
    h = np.ones(80)
    for k in range(1500):
        u[:, k] = np.sqrt(h) * draw.normal(size=80)
        h = 0.1 + 0.15 * u[:, k] ** 2 + 0.75 * h
    best, path = features.garch_fit(u)
    assert best.mean(0) == pytest.approx([0.15, 0.75], abs=0.05) and best.std(0).max() < 0.15
    raw, rest = features._square_acf(u), features._square_acf(u / np.sqrt(path))
    assert rest.mean() < 0.2 * raw.mean()  # what the model explains is gone


def test_seasonal_smoothing(spark):
    t = np.arange(60.0)
    exact = 10 + 3 * np.sin(2 * np.pi * t / 12) + 0.5 * t
    got = winters.fc_winters(win(spark, [exact[:48], exact[:20]]), 12, 12).orderBy("input_key", "h").collect()
    assert [r["mean"] for r in got[:12]] == pytest.approx(exact[48:60]) and [r["mean"] for r in got[12:]] == [None] * 12
    draw, x = np.random.default_rng(6), np.zeros((60, 240 + 12))
    level, slope, season = np.full(60, 100.0), np.full(60, 0.3), np.tile(10 * np.sin(2 * np.pi * np.arange(12) / 12), (60, 1))
    for k in range(252):
        e = draw.normal(size=60)
        x[:, k] = level + slope + season[:, k % 12] + e
        level, slope = level + slope + 0.4 * e, slope + 0.05 * e
        season[:, k % 12] += 0.2 * e
    fit = winters.winters_fit(x[:, :240], 12)
    assert fit["weights"].mean(0) == pytest.approx([0.4, 0.05, 0.2], abs=0.09)
    mean, se = winters._paths(fit, 240, 12, 12)
    assert abs((np.abs(x[:, 240:] - mean) <= 1.2815515655446008 * se).mean() - 0.8) < 0.08
    chosen = {r["input_key"]: r["model"] for r in winters.fc_chosen(win(spark, [x[0, :240], np.random.default_rng(1).normal(size=48), np.arange(48.0) ** 2, [1.0] * 5]), 3, 12).collect()}
    assert chosen["k0"] == "winters" and chosen["k1"] == "ses" and chosen["k2"] in ("holt", "damped") and chosen["k3"] is None


def test_cleaning_with_a_period(spark):
    wave = [10.0 * np.sin(2 * np.pi * t / 6) + 0.2 * t for t in range(48)]
    gaps = {10, 11, 12, 13, 14, 25}
    rows = [("a", t, None if t in gaps else float(v)) for t, v in enumerate(wave)] + [("b", t, float(t) if t != 2 else None) for t in range(5)] + [("c", t, None) for t in range(3)]
    long = spark.createDataFrame(rows, "series_id string, t int, y double")
    got = {(r["series_id"], r["t"]): r["y_clean"] for r in clean.clean_standard(long, period=6).collect()}
    plain = {(r["series_id"], r["t"]): r["y_clean"] for r in clean.clean_standard(long).collect()}
    miss = lambda out: max(abs(out["a", t] - wave[t]) for t in gaps)
    assert miss(got) < 0.35 * miss(plain) and got["b", 2] == 2.0 and got["c", 1] is None
    spiked = long.withColumn("y", F.when(F.col("t") == 20, 100.0).otherwise(F.col("y")))
    robust = {(r["series_id"], r["t"]): r["y_clean"] for r in clean.clean_robust(spiked.where("series_id = 'a'"), period=6).collect()}
    assert abs(robust["a", 20] - wave[20]) < 3 and all(robust["a", t] == pytest.approx(wave[t]) for t in (0, 5, 30, 47))


def test_segments_equal_one_run(spark):
    draw = np.random.default_rng(9)
    rows = [(s, t, float(draw.normal()) if draw.random() < 0.15 else None) for s in ("a", "b", None) for t in range(500)] + [("none", t, None) for t in range(40)]
    long = spark.createDataFrame(rows, "series_id string, t int, y double")
    key = lambda df: sorted(((str(r["series_id"]), r["t"], r["y_clean"]) for r in df.collect()), key=lambda x: x[:2])
    whole = key(clean.clean_standard(long))
    for segment in (1, 7, 64, 10_000):
        assert key(clean.clean_standard(long, segment=segment)) == whole


def test_local_lines_by_products(monkeypatch):
    """Short series take matrix products, at least three times as fast as sums over gathered neighbours; the lines are the same, also where values have no weight."""
    import time

    draw = np.random.default_rng(3)
    x = np.cumsum(draw.normal(size=(600, 72)), 1)
    trust = draw.random((600, 72)) * (draw.random((600, 72)) < 0.7)
    trust[0] = 0
    trust[1, 1:] = 0
    cases = [(19, None, None), (19, None, trust), (11, np.arange(-1, 73), trust), (101, None, trust), (1, None, trust)]
    took, found = [], []
    for dense in (decompose.DENSE, 0):
        monkeypatch.setattr(decompose, "DENSE", dense)
        began = time.perf_counter()
        found.append([decompose.loess(x, span, at, q) for span, at, q in cases])
        took.append(time.perf_counter() - began)
    for a, b in zip(*found, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-7)
    assert took[0] * 3 < took[1]
