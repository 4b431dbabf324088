"""Accepted results: one row a key with several writers, killed writers, and scans that skip what they can't need."""

import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tsengine.functions.files import create_once
from tsengine.operators import evaluate, store
from tsengine.sources import panel


def folder():
    return f"file://{tempfile.mkdtemp(prefix='spark-')}/results"


def test_a_file_is_created_once(spark):
    path = f"{folder()}/commits/1"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: create_once(spark, path, f"writer {k}"), range(8)))
    assert sum(won) == 1
    assert spark.read.text(path).first()[0] == f"writer {won.index(True)}"


def test_two_writers_accept_a_key_once(spark):
    path = folder()
    rows = lambda k: spark.range(k * 40, k * 40 + 100).select(F.col("id").alias("input_key"), F.lit(k).alias("writer"))  # noqa: E731 - neighbours share 60 keys
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: panel.append_results(rows(k), path, "s"), range(4)))
    got = panel.read_results(spark, path, "s")
    assert got.count() == got.select("input_key").distinct().count() == 220
    rows(9).write.parquet(f"{path}/batches/killed")  # a writer that never came to its commit
    assert panel.read_results(spark, path, "s").count() == 220
    again = panel.append_results(rows(9), path, "s")
    assert again.count() == 320 and panel.append_results(rows(9), path, "other").count() == 100
    assert panel.read_results(spark, path, "none") is None


def test_one_row_a_key_whatever_the_order(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(50)], "input_key int, v int")
    picks = [{tuple(r) for r in panel.append_results(rows.repartition(n), folder(), "s").select("input_key", "v").collect()} for n in (1, 3, 7)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 5


def test_scan_skips_other_keys(spark):
    path = folder()
    spark.range(100_000).select(F.col("id").alias("input_key"), (F.col("id") * 2).alias("v"), F.lit("k").alias("kind")).repartitionByRange(10, "input_key").write.parquet(path)
    keys = spark.createDataFrame([(70_001,), (70_050,)], "input_key long")
    out = panel.scan_results(spark.read.parquet(path), keys, "k", ["v"])
    assert sorted(r["v"] for r in out.collect()) == [140_002, 140_100]
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(input_key,70001)" in plan and "LessThanOrEqual(input_key,70050)" in plan
    wide = spark.read.parquet(path).where("input_key between 70001 and 70050").select(F.input_file_name()).distinct().count()
    assert wide == 1 and panel.scan_results(spark.read.parquet(path), keys.limit(0), "k", ["v"]).count() == 0


def test_external_forecasts_keep_their_paths(spark):
    rows = [("a", "m", h, float(h)) for h in (3, 1, 2)] + [("b", "m", h, 1.0) for h in (1, 2)] + [("c", "m", h, float("nan") if h == 2 else 1.0) for h in (1, 2, 3)] + [("d", "m", h, 1.0) for h in (1, 2, 3, 3)]
    loaded = panel.load_external_forecasts(spark.createDataFrame(rows, "series_id string, model string, h int, mean double"), spark.createDataFrame([(k,) for k in "abcde"], "series_id string"), ["m"], 3)
    got = {r["series_id"]: (r["reason"], r["mean"]) for r in loaded.collect()}
    assert got == {"a": (None, [1.0, 2.0, 3.0]), "b": ("horizon", None), "c": ("not finite", None), "d": ("duplicate", None), "e": ("missing", None)}
    assert [tuple(r) for r in panel.imported_paths(loaded).orderBy("h").collect()] == [("a", "m", h, float(h)) for h in (1, 2, 3)]


def test_checks_that_find_something(spark):
    plan, done = spark.createDataFrame([(1,), (2,), (2,), (3,)], "input_key int"), spark.createDataFrame([(2,), (4,)], "input_key int")
    assert [r[0] for r in store.missing_keys(plan, done).orderBy("input_key").collect()] == [1, 3]
    assert sorted(map(tuple, store.identity_match(plan, done).collect())) == [(1, "left"), (2, "left"), (3, "left"), (4, "right")]
    scores = spark.createDataFrame([("a", 1.0, None), ("b", float("nan"), float("inf")), ("c", 1.0, 2.0)], "k string, x double, y double")
    assert sorted(map(tuple, evaluate.finite_metrics(scores, ["x", "y"], ["k"]).collect())) == [("a", "y"), ("b", "x"), ("b", "y")]


def test_failed_commits_end(spark, monkeypatch):
    monkeypatch.setattr(panel, "create_once", lambda *_: False)
    with pytest.raises(RuntimeError, match="3 tries"):
        panel.append_results(spark.range(3).select(F.col("id").alias("input_key")), folder(), "s", tries=3)
