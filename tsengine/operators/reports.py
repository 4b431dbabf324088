"""Report tables: selected models, panels, long metrics, totals over frequencies, matrices and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import reference_row


def table1(selected: DataFrame, reference: str, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Selected models with their metrics and the improvement 100 (1 - m / reference) of each."""
    by = by or []
    ref = selected.where(F.col("model") == reference).groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), *[F.first(m).alias(f"r_{m}") for m in metrics])
    ref = ref.select(*by, *[F.when(F.col("n_") == 1, F.col(f"r_{m}")).alias(f"r_{m}") for m in metrics])  # more than one reference row is none
    joined = selected.join(ref, by, "left") if by else selected.crossJoin(F.broadcast(ref))  # a single row
    return joined.select(*by, "model", *metrics, *[F.when(F.col(f"r_{m}") != 0, 100 * (1 - F.col(m) / F.col(f"r_{m}"))).alias(f"{m}_improvement") for m in metrics])


def table2(selected: DataFrame, reference: str) -> DataFrame:
    """Long panels: A terminal direction accuracy, B OWA, C improvement of OWA."""
    rows = table1(selected, reference, ["owa", "da"])
    return rows.select("model", F.explode(F.array(F.struct(F.lit("A").alias("panel"), F.col("da").alias("value")), F.struct(F.lit("B").alias("panel"), F.col("owa").alias("value")), F.struct(F.lit("C").alias("panel"), F.col("owa_improvement").alias("value")))).alias("p")).select("p.panel", "model", "p.value").where("value is not null")


def metrics_long(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return scores.unpivot(keys, metrics, "metric", "value").where("value is not null")


def aggregate_all(results: DataFrame, reference: str, frequencies: int) -> DataFrame:
    """Means over frequencies weighted by series counts, OWA anew; models that lack or repeat a frequency are named as violations."""
    n = F.sum("evaluation_count")
    weigh = lambda c: (F.sum(F.col(c) * F.col("evaluation_count")) / n).alias(c)
    rows = results.groupBy("model").agg(weigh("smape"), weigh("mase"), weigh("da"), n.alias("evaluation_count"), F.count(F.lit(1)).alias("k"), F.count_distinct("frequency").alias("f"))
    ref = F.broadcast(reference_row(rows.where(F.col("model") == reference)))  # a single row
    violation = F.when(F.col("k") > F.col("f"), "duplicate").when(F.col("f") != frequencies, "incomplete")
    return rows.crossJoin(ref).select("model", "smape", "mase", "da", "evaluation_count", (0.5 * (F.col("smape") / F.col("rs") + F.col("mase") / F.col("rm"))).alias("owa"), violation.alias("violation"))


def accuracy_matrix(by_horizon: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    return by_horizon.groupBy(*keys).pivot("model", models).agg(F.first("accuracy"))


def incomplete_models(by_horizon: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """The (model, block) pairs that are missing."""
    want = by_horizon.select(*keys).distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return want.join(by_horizon.select(*keys, "model"), [*keys, "model"], "left_anti")


def mean_ranks(by_horizon: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Mean over blocks of the rank by falling accuracy, ties by their mean rank; no rows if any model is incomplete."""
    block = Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, "accuracy")
    rows = by_horizon.where(F.col("model").isin(*models)).withColumn("rank", F.rank().over(block.orderBy(F.col("accuracy").desc())) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    lacking = F.broadcast(incomplete_models(by_horizon, models, keys).agg(F.count(F.lit(1)).alias("lacking")))
    return rows.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("blocks")).crossJoin(lacking).where("lacking = 0").drop("lacking")
