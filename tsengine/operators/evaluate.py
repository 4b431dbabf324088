"""Combination, accuracy metrics and direction scores. Actual values are rows (input_key, h, actual), null where missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASE_LAGS = {"H": 24, "M": 12, "Q": 4}


def combine_weighted(forecasts: DataFrame, weights: dict[str, float], name: str = "weighted") -> DataFrame:
    """Weighted mean by step over the named models; keys that lack one of them give no row. Weights sum to 1."""
    if len(weights) < 2 or abs(sum(weights.values()) - 1) > 1e-12:
        raise ValueError("two weights or more, with sum 1")
    wide = forecasts.where(F.col("model").isin(*weights)).groupBy("input_key", "h").pivot("model", list(weights)).agg(F.first("mean"))
    value = sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0))
    steps = wide.withColumn("mean", value)
    whole = F.count_if(F.col("mean").isNull()).over(Window.partitionBy("input_key")) == 0
    return steps.withColumn("whole", whole).where("whole").select("input_key", F.lit(name).alias("model"), "h", "mean")


def combine_comb(forecasts: DataFrame) -> DataFrame:
    """Equal thirds of SES, Holt and damped trend."""
    return combine_weighted(forecasts, {"ses": 1 / 3, "holt": 1 / 3, "damped": 1 - 2 / 3}, "comb")


def mase_lag(freq: Column) -> Column:
    return F.when(freq == "H", 24).when(freq == "M", 12).when(freq == "Q", 4).otherwise(1)


def naive_scale_of(array_col: str, lag: int) -> Column:
    """Mean absolute lag difference of the known values; null without any."""
    x, n = F.col(array_col), F.size(array_col)
    d = F.zip_with(F.slice(x, F.lit(1), F.greatest(n - lag, F.lit(0))), F.slice(x, F.lit(lag + 1), F.greatest(n - lag, F.lit(0))), lambda a, b: F.abs(b - a))
    known = F.filter(d, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def naive_scale(windows: DataFrame, lag: int, array_col: str = "history", key: str = "input_key") -> DataFrame:
    """(key, scale): mean absolute lag difference of the raw history."""
    return windows.select(key, naive_scale_of(array_col, lag).alias("scale"))


def _errors(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    return forecasts.join(actuals.select("input_key", "h", "actual"), ["input_key", "h"])


def smape_term() -> Column:
    size = F.abs("actual") + F.abs("mean")
    return F.when(size > 0, 200 * F.abs(F.col("actual") - F.col("mean")) / size)


def metric_smape(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Mean of 200 |a - f| / (|a| + |f|); 0/0 terms and missing values stay out."""
    return _errors(forecasts, actuals).groupBy("input_key", "model").agg(F.avg(smape_term()).alias("smape"))


def metric_mase(forecasts: DataFrame, actuals: DataFrame, scales: DataFrame) -> DataFrame:
    """MAE over the scale of the raw history; a zero or missing scale is a violation."""
    rows = _errors(forecasts, actuals).groupBy("input_key", "model").agg(F.avg(F.abs(F.col("actual") - F.col("mean"))).alias("mae")).join(scales, "input_key")
    good = F.col("scale") > 0
    return rows.select("input_key", "model", F.when(good, F.col("mae") / F.col("scale")).alias("mase"), F.when(~F.coalesce(good, F.lit(False)), "zero scale").alias("violation"))


def series_scores(rows: DataFrame, **more: Column) -> DataFrame:
    """(input_key, model, smape, mase, violation) from rows that hold mean, actual and scale: both metrics, and ``more`` aggregates, in one aggregation."""
    good = F.col("scale") > 0
    means = rows.groupBy("input_key", "model").agg(F.avg(smape_term()).alias("smape"), F.avg(F.abs(F.col("actual") - F.col("mean"))).alias("mae"), F.first("scale").alias("scale"), *[c.alias(n) for n, c in more.items()])
    return means.select("input_key", "model", *more, "smape", F.when(good, F.col("mae") / F.col("scale")).alias("mase"), F.when(~F.coalesce(good, F.lit(False)), "zero scale").alias("violation"))


def metric_owa(scores: DataFrame, reference: str = "naive2") -> DataFrame:
    """Half the ratio of mean sMAPE to the reference's, plus half the same for MASE."""
    means = scores.groupBy("model").agg(F.avg("smape").alias("smape"), F.avg("mase").alias("mase"))
    every = Window.partitionBy()  # a row a model; the scores are read once
    own = lambda c: F.max(F.when(F.col("model") == reference, F.col(c))).over(every)
    rows = means.withColumns({"rs": own("smape"), "rm": own("mase")})
    return rows.withColumn("owa", F.when((F.col("rs") > 0) & (F.col("rm") > 0), 0.5 * (F.col("smape") / F.col("rs") + F.col("mase") / F.col("rm")))).drop("rs", "rm")


def reference_row(reference: DataFrame, *by: str) -> DataFrame:
    """(by, rs, rm): the components of the one reference row, null if there is none or more than one. Without ``by`` always a single row."""
    facts = (reference.groupBy(*by) if by else reference).agg(F.first("smape").alias("rs"), F.first("mase").alias("rm"), F.count(F.lit(1)).alias("n_"))
    return facts.select(*by, *[F.when(F.col("n_") == 1, F.col(c)).alias(c) for c in ("rs", "rm")])


def rebase_owa(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """OWA from stored components against one reference row; null where a component is, where there isn't exactly one such row, or where it is not above 0."""
    ref = F.broadcast(reference_row(reference))  # a single row
    return scores.crossJoin(ref).withColumn("owa", F.when((F.col("rs") > 0) & (F.col("rm") > 0), 0.5 * (F.col("smape") / F.col("rs") + F.col("mase") / F.col("rm")))).drop("rs", "rm")


def point_metrics(forecasts: DataFrame, actuals: DataFrame, scales: DataFrame) -> DataFrame:
    """MSE, MAE, MASE, MAPE, sMAPE, RMSE, NRMSE and ND by key and model in one aggregation; missing actual values are masked."""
    e = F.col("actual") - F.col("mean")
    rows = _errors(forecasts, actuals).groupBy("input_key", "model").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col("actual") != 0, F.abs(e / F.col("actual")))).alias("mape"), F.avg(smape_term()).alias("smape"), F.avg(F.abs("actual")).alias("level"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    rows = rows.join(scales, "input_key").withColumn("rmse", F.sqrt("mse"))
    return rows.select("input_key", "model", "mse", "mae", ratio(F.col("mae"), F.col("scale")).alias("mase"), "mape", "smape", "rmse", ratio(F.col("rmse"), F.col("level")).alias("nrmse"), ratio(F.col("mae"), F.col("level")).alias("nd"))


def quantile_metrics(quantiles: DataFrame, actuals: DataFrame, scales: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Squared error of the median, MSIS of the outer interval, and the mean weighted quantile loss over levels in [0.1, 0.9]."""
    rows = quantiles.join(actuals.select("input_key", "h", "actual"), ["input_key", "h"]).where("actual is not null")
    e = F.col("actual") - F.col("q")
    loss = 2 * F.when(e >= 0, F.col("level") * e).otherwise((F.col("level") - 1) * e)
    middle = F.col("level").between(0.1, 0.9)
    pick = lambda p: F.max(F.when(F.col("level") == p, F.col("q")))
    steps = rows.groupBy("input_key", "model", "h").agg(F.first("actual").alias("a"), F.sum(F.when(middle, loss)).alias("loss"), F.count_if(middle).alias("k"), pick(0.5).alias("med"), pick(low).alias("lo"), pick(high).alias("hi"))
    a = F.col("a")
    width = (F.col("hi") - F.col("lo")) + 2 / (2 * low) * F.greatest(F.col("lo") - a, F.lit(0.0)) * 1.0 + 2 / (2 * low) * F.greatest(a - F.col("hi"), F.lit(0.0))
    out = steps.groupBy("input_key", "model").agg(F.avg((a - F.col("med")) ** 2).alias("mse_median"), F.avg(width).alias("width"), (F.sum("loss") / F.max("k")).alias("loss"), F.sum(F.abs(a)).alias("size")).join(scales, "input_key")
    return out.select("input_key", "model", "mse_median", F.when(F.col("scale") > 0, F.col("width") / F.col("scale")).alias("msis"), F.when(F.col("size") > 0, F.col("loss") / F.col("size")).alias("mean_weighted_quantile_loss"))


def metric_mask(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per key and model: how many steps count, and whether quantile metrics apply; none are made up for mean-only models."""
    rows = forecasts.join(actuals.select("input_key", "h", "actual"), ["input_key", "h"], "left")
    return rows.groupBy("input_key", "model", "capability").agg(F.count("actual").alias("n_used"), F.count_if(F.col("actual").isNull()).alias("n_masked")).withColumn("metric_set", F.when(F.col("capability") == "mean_only", "point").otherwise("point_and_quantile"))


def finite_metrics(scores: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows with an empty or non-finite metric, and its name."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(c)) for c in columns]))
    return scores.select(*keys, F.explode(bad).alias("metric"))


def forecast_direction(forecasts: DataFrame, origins: DataFrame) -> DataFrame:
    """1 where a step is above the origin, else 0."""
    return forecasts.join(origins.select("input_key", "origin"), "input_key").select("input_key", "model", "h", (F.col("mean") > F.col("origin")).cast("int").alias("label"))


def direction_score(predicted: DataFrame, labels: DataFrame, basis: str) -> DataFrame:
    """correct (0 or 1) by key, model and step on one basis; missing labels stay out."""
    truth = labels.select("input_key", "h", F.col("label").alias("truth")).where("truth is not null")
    return predicted.join(truth, ["input_key", "h"]).select("input_key", "model", "h", F.lit(basis).alias("basis"), (F.col("label") == F.col("truth")).cast("int").alias("correct"))


def direction_by_horizon(scores: DataFrame) -> DataFrame:
    return scores.groupBy("basis", "model", "h").agg(F.sum("correct").alias("correct_count"), F.count(F.lit(1)).alias("evaluation_count")).withColumn("accuracy", F.col("correct_count") / F.col("evaluation_count"))


def terminal_da(by_horizon: DataFrame) -> DataFrame:
    """The accuracy at the largest horizon present."""
    return by_horizon.groupBy("basis", "model").agg(F.max_by("accuracy", "h").alias("da"), F.max("h").alias("h"))


def basis_guard(scores: DataFrame, basis: str, keys: list[str]) -> DataFrame:
    """Violations: rows of another basis, and keys that stand more than once."""
    wrong = scores.where(F.col("basis") != basis).select(*keys, F.lit("basis").alias("violation"))
    twice = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate").alias("violation"))
    return wrong.unionByName(twice)
