"""Restart semantics as data work: what is planned, done, missing, counted and merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_keys(plan: DataFrame, results: DataFrame, key: str = "input_key") -> DataFrame:
    return plan.join(results.select(key), key, "left_anti")


def missing_keys(plan: DataFrame, results: DataFrame, key: str = "input_key") -> DataFrame:
    return plan.select(key).subtract(results.select(key))


def identity_match(a: DataFrame, b: DataFrame, key: str = "input_key") -> DataFrame:
    """Keys that only one of two sets has; empty if they are equal."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def stage_counts(plan: DataFrame, results: DataFrame, key: str = "input_key") -> DataFrame:
    """planned and done keys of each stage."""
    done = results.select("stage", key).distinct().withColumn("d", F.lit(1))
    return plan.join(done, ["stage", key], "left").groupBy("stage").agg(F.count(F.lit(1)).alias("planned"), F.count("d").alias("done"))


def merge_results(*parts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(union of the parts, keys that stand more than once)."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
