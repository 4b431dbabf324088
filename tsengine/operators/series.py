"""Canonical series, keys, and the array and long forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = {"H": 24, "D": 1, "W": 1, "M": 12, "Q": 4, "Y": 1}


def canonical_series(series: DataFrame, horizon: int, key: str = "series_id") -> DataFrame:
    """Boundaries, end-exclusive and zero-based, and the reason why a series is rejected (null if it is not)."""
    n = F.size("target")
    bad = F.exists("target", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    reason = F.when(F.col(key).isNull(), "no id").when(F.col("target").isNull() | (n == 0), "empty").when(bad, "infinite").when(n <= horizon, "short")
    return series.withColumns({"observation_count": n, "train_end": n - horizon, "test_start": n - horizon, "horizon": F.lit(horizon), "reason": reason})


def split_history_test(series: DataFrame, horizon: int) -> DataFrame:
    """history [0, N-H) and actual [N-H, N)."""
    n = F.size("target")
    return series.withColumns({"history": F.slice("target", F.lit(1), F.greatest(n - horizon, F.lit(0))), "actual": F.slice("target", F.greatest(n - horizon, F.lit(0)) + 1, F.lit(horizon))})


def series_to_long(series: DataFrame, keys: list[str], array_col: str = "target") -> DataFrame:
    return series.select(*keys, F.posexplode(array_col).alias("t", "y"))


def long_to_series(long: DataFrame, keys: list[str], value_col: str = "y", name: str = "target") -> DataFrame:
    """One array a key in the order of t."""
    rows = F.sort_array(F.collect_list(F.struct("t", F.col(value_col).alias("y"))))
    return long.groupBy(*keys).agg(F.transform(rows, lambda r: r["y"]).alias(name))


def make_key(dataset: str, freq: str, series: Column, kind: Column | str, start: Column) -> Column:
    """dataset/freq/series/kind/start with nine digits, so the order of keys is the order of starts."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.concat_ws("/", F.lit(dataset), F.lit(freq), series.cast("string"), kind, F.format_string("%09d", start))


def split_key(key: Column) -> dict[str, Column]:
    parts = F.split(key, "/")
    return {n: parts[k] for k, n in enumerate(("dataset", "freq", "series", "kind"))} | {"start": parts[4].cast("int")}


def eligible_series(series: DataFrame, freq_dim: DataFrame) -> DataFrame:
    """Series whose history holds at least one input and one horizon of their frequency."""
    return series.join(freq_dim, "freq").where(F.col("train_end") >= F.col("input_length") + F.col("horizon"))


def input_policy(windows: DataFrame, models: dict[str, str]) -> DataFrame:
    """(input_key, model, basis, context, centre, scale): raw or standardised input for each model, with the state that inverts its output."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(b).alias("basis")) for m, b in models.items()])).alias("p")
    rows = windows.select("input_key", "raw", "standard", "centre", "scale", pairs).select("*", "p.*")
    raw = F.col("basis") == "raw"
    return rows.select("input_key", "model", "basis", F.when(raw, F.col("raw")).otherwise(F.col("standard")).alias("context"), F.when(~raw, F.col("centre")).alias("centre"), F.when(~raw, F.col("scale")).alias("scale"))
