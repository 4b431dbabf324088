"""The sensitivity surface of direction adjustments, selection, and the oracle multiplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from .evaluate import reference_row, smape_term

UP, DOWN = (1.0, 0.005, 25), (1.0, -0.005, 21)


def lambda_grid(spark: SparkSession, up=UP, down=DOWN) -> DataFrame:
    """All pairs of two inclusive axes, rounded to three places."""
    axis = lambda n, a: spark.range(a[2]).select(F.round(F.lit(a[0]) + F.col("id") * F.lit(a[1]), 3).alias(n))
    return axis("lambda_up", up).crossJoin(axis("lambda_down", down))


def _gate() -> Column:
    have = (F.col("last") > F.col("origin")).cast("int")
    return F.when(have == F.col("want"), "keep").when(F.col("want") == 1, "up").otherwise("down")


def _wanted(directions: DataFrame, origins: DataFrame) -> DataFrame:
    """(input_key, want, origin): the classifier's last direction."""
    return directions.groupBy("input_key").agg(F.max_by("label", "h").alias("want")).join(origins.select("input_key", "origin"), "input_key")


def gates(forecasts: DataFrame, directions: DataFrame, origins: DataFrame) -> DataFrame:
    """(input_key, model, gate): keep where the base path's last direction agrees with the classifier's, else up or down."""
    last = forecasts.groupBy("input_key", "model").agg(F.max_by("mean", "h").alias("last"))
    return last.join(_wanted(directions, origins), "input_key").select("input_key", "model", _gate().alias("gate"))


def gated(forecasts: DataFrame, directions: DataFrame, origins: DataFrame) -> DataFrame:
    """The forecasts with their path's gate and origin, read once: a window over the steps of a path."""
    last = F.max_by("mean", "h").over(Window.partitionBy("input_key", "model"))
    return forecasts.withColumn("last", last).join(_wanted(directions, origins), "input_key").withColumn("gate", _gate()).drop("last", "want")


def direction_adjust(forecasts: DataFrame, directions: DataFrame, origins: DataFrame, up: float | Column, down: float | Column) -> DataFrame:
    """The whole path times 1, up or down by its gate."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    factor = F.when(F.col("gate") == "up", as_col(up)).when(F.col("gate") == "down", as_col(down)).otherwise(F.lit(1.0))
    return gated(forecasts, directions, origins).withColumn("mean", F.col("mean") * factor)


def sensitivity_surface(forecasts: DataFrame, directions: DataFrame, actuals: DataFrame, origins: DataFrame, scales: DataFrame, reference: DataFrame, up=UP, down=DOWN) -> DataFrame:
    """Mean sMAPE, MASE, OWA and direction counts for every (model, lambda_up, lambda_down).

    A series' multiplier depends on one of the two lambdas at most, so sums are taken once for each gate and lambda of its
    axis and only the three small tables of sums are combined over the grid.
    """
    spark = forecasts.sparkSession
    axis = lambda a: F.array(*[F.round(F.lit(a[0]) + k * F.lit(a[1]), 3) for k in range(a[2])])
    rows = gated(forecasts, directions, origins).join(actuals.select("input_key", "h", "actual"), ["input_key", "h"]).join(scales.select("input_key", "scale"), "input_key")
    rows = rows.withColumn("lambda", F.explode(F.when(F.col("gate") == "up", axis(up)).when(F.col("gate") == "down", axis(down)).otherwise(F.array(F.lit(1.0)))))
    rows = rows.withColumn("mean", F.col("mean") * F.col("lambda"))
    right = ((F.col("mean") > F.col("origin")) == (F.col("actual") > F.col("origin"))).cast("int")
    series = rows.groupBy("model", "gate", "lambda", "input_key").agg(F.avg(smape_term()).alias("smape"), (F.avg(F.abs(F.col("actual") - F.col("mean"))) / F.first("scale")).alias("mase"), F.sum(right).alias("correct"), F.count("actual").alias("steps"))
    sums = series.groupBy("model", "gate", "lambda").agg(F.sum("smape").alias("s"), F.sum("mase").alias("m"), F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("steps").alias("k"))
    # the sums of a model (a row for each gate and lambda of its axis) stand in one map, which every point of the grid reads
    key = lambda gate, value: F.concat_ws(":", gate, value.cast("string"))
    maps = sums.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(key(F.col("gate"), F.col("lambda")), F.struct("s", "m", "c", "n", "k")))).alias("sums"))
    full = maps.crossJoin(F.broadcast(lambda_grid(spark, up, down)))  # UP x DOWN points
    at = {"keep": F.lit(1.0), "up": F.col("lambda_up"), "down": F.col("lambda_down")}
    full = full.withColumns({g: F.try_element_at("sums", key(F.lit(g), v)) for g, v in at.items()})
    add = lambda x: sum((F.coalesce(F.col(f"{g}.{x}"), F.lit(0)) for g in at), F.lit(0))
    ref = F.broadcast(reference_row(reference))  # a single row
    out = full.select("model", "lambda_up", "lambda_down", (add("s") / add("n")).alias("smape"), (add("m") / add("n")).alias("mase"), add("c").cast("long").alias("correct_count"), add("k").cast("long").alias("step_count"), add("n").cast("long").alias("evaluation_count")).crossJoin(ref)
    return out.withColumn("owa", 0.5 * (F.col("smape") / F.col("rs") + F.col("mase") / F.col("rm"))).drop("rs", "rm")


def select_candidate(surface: DataFrame) -> DataFrame:
    """The winner of each model by OWA, then total departure from 1, up and down departures, and the lambdas."""
    up, down = F.round(F.abs(F.col("lambda_up") - 1), 6), F.round(F.abs(F.col("lambda_down") - 1), 6)
    order = Window.partitionBy("model").orderBy("owa", up + down, up, down, "lambda_up", "lambda_down")
    return surface.withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def selected_paths(forecasts: DataFrame, directions: DataFrame, origins: DataFrame, selection: DataFrame) -> DataFrame:
    """The adjusted paths of the winners only."""
    rows = forecasts.join(selection.select("model", "lambda_up", "lambda_down"), "model")
    return direction_adjust(rows, directions, origins, F.col("lambda_up"), F.col("lambda_down"))


def oracle_multiplier(forecasts: DataFrame, actuals: DataFrame, count: int = 1001) -> DataFrame:
    """Per (input_key, model) the multiplier of 0.500 ... 1.500 with the least sMAPE (the first of equal ones), its value, and near ties within sqrt(eps)."""
    paths = forecasts.join(actuals.select("input_key", "h", "actual"), ["input_key", "h"]).groupBy("input_key", "model").agg(F.sort_array(F.collect_list(F.struct("h", "mean", "actual"))).alias("p"))

    def objective(k):
        lam = F.round(F.lit(0.5) + k * F.lit(0.001), 3)
        terms = F.filter(F.transform("p", lambda s: F.struct((F.abs(s["actual"]) + F.abs(s["mean"] * lam)).alias("d"), F.abs(s["actual"] - s["mean"] * lam).alias("e"))), lambda s: s["d"] > 0)
        total = F.aggregate(terms, F.lit(0.0), lambda a, s: a + 200 * s["e"] / s["d"])
        return F.struct(F.when(F.size(terms) > 0, total / F.size(terms)).alias("o"), lam.alias("lam"))

    def judged(tried):
        def with_best(best):
            ties = F.size(F.filter(tried, lambda s: s["o"] <= best["o"] + 2.0**-26))
            return F.struct(best["lam"].alias("multiplier"), best["o"].alias("smape"), ties.alias("ties"), F.when(best.isNull() | F.exists(tried, lambda s: s["o"].isNull()), "not finite").alias("violation"))

        return let(F.array_min(F.filter(tried, lambda s: s["o"].isNotNull())), with_best)

    out = paths.withColumn("r_", F.explode(F.array(let(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), objective), judged))))
    return out.select("input_key", "model", "r_.*")

