"""Membership, rolling and official windows, direction labels, scaling and cohorts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.ranks import first_by_hash, numbered


def shuffled(seed: int, *keys: Column | str) -> Column:
    """A fixed pseudo-random order that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def test_count(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(1.0 - fraction) * n)).cast("int")


def split_membership(series: DataFrame, fraction: float, seed: int, key: str = "series_id", freq_col: str | None = None) -> DataFrame:
    """train or test for each series, by hash order within its frequency; no window sees more than a bin of the hash."""
    by = [freq_col] if freq_col else []
    rows = series.select(*by, key).distinct()
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("series_"))
    rows = rows.join(counts.withColumnRenamed(freq_col, "f_"), F.col(freq_col).eqNullSafe(F.col("f_"))).drop("f_") if by else rows.crossJoin(F.broadcast(counts))
    chosen = first_by_hash(rows, by, shuffled(seed, key), [key], test_count(F.col("series_"), fraction))
    return chosen.select(*by, key, F.when(F.col("chosen"), "test").otherwise("train").alias("partition"))


def membership_roles(series: DataFrame, split: DataFrame, key: str = "series_id") -> DataFrame:
    role = F.when(F.col("partition").isNull(), "evaluation_only").otherwise("modelling")
    return series.join(split.select(key, "partition"), key, "left").withColumn("role", role)


def rolling_blocks(series: DataFrame, length: int, horizon: int, array_col: str = "history") -> DataFrame:
    """Complete blocks from the start, stride length + horizon, no padding, the tail dropped."""
    stride = length + horizon
    count = F.floor(F.size(array_col) / stride).cast("int")
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    rows = series.withColumn("input_start", F.explode(starts))
    return rows.withColumns({"window": F.slice(array_col, F.col("input_start") + 1, F.lit(length)), "actual": F.slice(array_col, F.col("input_start") + 1 + length, F.lit(horizon)), "kind": F.lit("rolling")}).drop(array_col)


def official_window(series: DataFrame, length: int, array_col: str = "history", actual_col: str = "actual") -> DataFrame:
    """The last ``length`` values, padded on the left with the first one; the actual values are the test part as it is."""
    n = F.size(array_col)
    tail = F.slice(array_col, F.greatest(n - length, F.lit(0)) + 1, F.lit(length))
    window = F.concat(F.array_repeat(F.element_at(array_col, 1), F.greatest(F.lit(length) - n, F.lit(0))), tail)
    return series.withColumns({"window": window, "input_start": F.greatest(n - length, F.lit(0)), "kind": F.lit("official"), "actual": F.col(actual_col)}).drop(array_col)


def direction_labels(windows: DataFrame, actual_col: str = "actual", reference: Column | None = None) -> DataFrame:
    """1 above the reference (the last input value), 0 at or below it, null where the value is missing."""
    ref = F.element_at("window", -1) if reference is None else reference
    return windows.withColumn("reference", ref).withColumn("labels", F.transform(actual_col, lambda v: (v > F.col("reference")).cast("int")))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def fit_standardise(windows: DataFrame, array_col: str = "window") -> DataFrame:
    """centre, scale, count, constant: mean and sample deviation; a constant window (least = most) has its value and 1."""
    x = F.col(array_col)
    n = F.size(x)
    constant = (F.array_min(x) == F.array_max(x)) | (n == 1)
    out = windows.withColumns({"count": n, "constant": constant}).withColumn("centre", F.when(F.col("constant"), F.element_at(x, 1)).otherwise(_sum(x) / n))
    deviation = let(F.col("centre"), lambda c: F.sqrt(_sum(F.transform(x, lambda v: (v - c) * (v - c))) / (n - 1)))
    return out.withColumn("scale", F.when(F.col("constant"), F.lit(1.0)).otherwise(deviation))


def apply_standardise(windows: DataFrame, array_col: str = "window", name: str = "standard") -> DataFrame:
    """(v - centre) / scale; without a state the values stay."""
    state = F.struct(F.coalesce("centre", F.lit(0.0)).alias("c"), F.coalesce("scale", F.lit(1.0)).alias("s"))
    return windows.withColumn(name, let(state, lambda z: F.transform(array_col, lambda v: (v - z["c"]) / z["s"])))


def invert_standardise(forecasts: DataFrame, state: DataFrame, columns: list[str], key: str = "input_key") -> DataFrame:
    """centre + scale * v on the mean, the median and each quantile value."""
    rows = forecasts.join(state.select(key, "centre", "scale"), key, "left")
    back = {c: F.coalesce("centre", F.lit(0.0)) + F.coalesce("scale", F.lit(1.0)) * F.col(c) for c in columns}
    return rows.withColumns(back).drop("centre", "scale")


STEPS = {
    "standardise": (lambda v, c, s: (v - c) / s, lambda v, c, s: c + s * v),
    "log1p": (lambda v, c, s: F.log1p(v), lambda v, c, s: F.expm1(v)),
    "identity": (lambda v, c, s: v, lambda v, c, s: v),
}


def transform_steps(windows: DataFrame, recipe: list[str], direction: str = "forward", array_col: str = "window", name: str = "transformed") -> DataFrame:
    """Named steps in order, or their inverses in reverse order; an unknown step is an error."""
    if unknown := set(recipe) - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    chosen = [STEPS[r][0] for r in recipe] if direction == "forward" else [STEPS[r][1] for r in reversed(recipe)]

    def run(v, z):
        for step in chosen:
            v = step(v, z["c"], z["s"])
        return v

    state = F.struct(F.coalesce("centre", F.lit(0.0)).alias("c"), F.coalesce("scale", F.lit(1.0)).alias("s"))
    return windows.withColumn(name, let(state, lambda z: F.transform(array_col, lambda v: run(v, z))))


def window_dataset(windows: DataFrame, membership: DataFrame, key: str = "series_id") -> DataFrame:
    """The modelling row: state, standardised input, reference, labels and partition."""
    rows = apply_standardise(fit_standardise(direction_labels(windows)))
    return rows.join(membership.select(key, "partition"), key, "left").withColumn("basis", F.lit("prepared_origin"))


def class_quotas(counts: DataFrame, cap: int) -> DataFrame:
    """Quotas of classes (label, n): floor of the share, 1 at least, the rest one by one from the largest class on; windows over classes."""
    every = Window.partitionBy()
    order = Window.orderBy(F.col("n").desc(), "label")
    base = counts.withColumn("total", F.sum("n").over(every)).withColumn("quota", F.when(F.col("total") <= cap, F.col("n")).otherwise(F.greatest(F.floor(F.col("n") / F.col("total") * cap), F.lit(1))))
    base = base.withColumns({"rest": F.when(F.col("total") <= cap, 0).otherwise(cap - F.sum("quota").over(every)), "rank": F.row_number().over(order), "k": F.count(F.lit(1)).over(every)})
    share = F.floor(F.abs("rest") / F.col("k")) + F.when(F.col("rank") <= F.abs("rest") % F.col("k"), 1).otherwise(0)
    return base.select("label", "n", F.greatest(F.col("quota") + F.signum("rest") * share, F.lit(1)).cast("int").alias("quota"))


def stratified_cohort(windows: DataFrame, cap: int, seed: int, key: str = "input_key", label_col: str = "label") -> DataFrame:
    """At most about ``cap`` windows, each class by its quota in hash order; ref_order is another hash order."""
    counts = windows.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    quotas = F.broadcast(class_quotas(counts, cap).select(F.col("label").alias("l_"), "quota"))  # a row per class
    rows = windows.select(key, label_col).join(quotas, F.col(label_col) == F.col("l_")).drop("l_")
    chosen = first_by_hash(rows, [label_col], shuffled(seed, key), [key], F.col("quota")).where("chosen")
    return chosen.select(key, label_col, F.row_number().over(Window.orderBy(shuffled(seed + 1, key), key)).alias("ref_order"))  # cap rows, or one a class


def full_cohort(windows: DataFrame, key: str = "input_key") -> DataFrame:
    """All rolling windows of the training partition in key order."""
    chosen = windows.where((F.col("kind") == "rolling") & (F.col("partition") == "train")).select(key)
    return numbered(chosen, key, name="ref_order")


def feature_keys(cohort: DataFrame, windows: DataFrame, key: str = "input_key") -> DataFrame:
    """Keys of the cohort and of the official windows."""
    return cohort.select(key).union(windows.where(F.col("kind") == "official").select(key)).distinct()


def lambda_axis(lo: float, step: float, count: int) -> list[float]:
    return [round(lo + step * k, 3) for k in range(count)]


def n_test(total: int, fraction: float) -> int:
    return max(1, math.floor((1.0 - fraction) * total))
