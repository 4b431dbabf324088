"""Filling gaps and taming outliers, within the history only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_period(series: DataFrame, period_dim: DataFrame, override: int | None = None) -> DataFrame:
    """The seasonal period of each series' frequency, or the override, and where it comes from."""
    period = F.lit(override).cast("int") if override is not None else F.col("default_period")
    source = F.lit("override" if override is not None else "frequency")
    return series.join(period_dim, "freq", "left").withColumns({"period": period, "period_source": source}).drop("default_period")


def clean_standard(long: DataFrame, key: str = "series_id", value_col: str = "y", name: str = "y_clean", period: int = 1, segment: int | None = None) -> DataFrame:
    """Linear interpolation between the neighbours of a gap, constant beyond the ends; finite values stay.

    With a ``period`` it is the values less their season that are interpolated (``season_of``). ``segment``: for very long series, steps in one sorted run; see ``clean_segments``.
    """
    if period > 1:
        rows = season_of(clean_standard(long, key, value_col, "filled_", segment=segment), period, key, "filled_").withColumn("adjusted_", F.col(value_col) - F.col("season_"))
        rows = clean_standard(rows, key, "adjusted_", "smooth_", segment=segment)
        return rows.withColumn(name, F.when(F.col(value_col).isNotNull(), F.col(value_col)).otherwise(F.col("smooth_") + F.col("season_"))).drop("filled_", "season_", "adjusted_", "smooth_")
    if segment is not None:
        return clean_segments(long, segment, key, value_col, name)
    back = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)  # backward: a frame to the end would be read anew for each row
    at = F.when(F.col(value_col).isNotNull(), F.col("t"))
    rows = long.withColumns({"y0": F.last(value_col, True).over(back), "t0": F.last(at, True).over(back), "y1": F.last(value_col, True).over(ahead), "t1": F.last(at, True).over(ahead)})
    return rows.withColumn(name, _blend(F.col(value_col))).drop("y0", "t0", "y1", "t1")


def _blend(value: Column) -> Column:
    """The value, or what lies between (t0, y0) and (t1, y1)."""
    blend = F.col("y0") + (F.col("y1") - F.col("y0")) * ((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return F.when(value.isNotNull(), value).otherwise(F.coalesce(blend, "y0", "y1"))


def clean_segments(long: DataFrame, segment: int, key: str = "series_id", value_col: str = "y", name: str = "y_clean") -> DataFrame:
    """The same as without segments, for series of any length: no task sorts more than ``segment`` steps of one.

    Each segment knows the first and the last value in it; a window over the segments of a series, a row each, carries these to the segments without own ones on that side, and the
    steps of a segment look within it first and else to what was carried.
    """
    known = long.withColumns({"seg_": F.floor(F.col("t") / segment), "p_": F.when(F.col(value_col).isNotNull(), F.struct("t", F.col(value_col).alias("y")))})
    ends = known.groupBy(key, "seg_").agg(F.min("p_").alias("first_"), F.max("p_").alias("last_"))  # of structs, so by time
    before = Window.partitionBy(key).orderBy("seg_").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(F.desc("seg_")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("k_"), F.col("seg_").alias("s_"), F.last("last_", True).over(before).alias("c0_"), F.last("first_", True).over(after).alias("c1_"))
    rows = known.join(carried, F.col(key).eqNullSafe(F.col("k_")) & (F.col("seg_") == F.col("s_"))).drop("k_", "s_")
    back = Window.partitionBy(key, "seg_").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "seg_").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a_": F.coalesce(F.last("p_", True).over(back), "c0_"), "b_": F.coalesce(F.last("p_", True).over(ahead), "c1_")})
    rows = rows.withColumns({"y0": F.col("a_.y"), "t0": F.col("a_.t"), "y1": F.col("b_.y"), "t1": F.col("b_.t")})
    return rows.withColumn(name, _blend(F.col(value_col))).drop("y0", "t0", "y1", "t1", "a_", "b_", "c0_", "c1_", "seg_", "p_")


def season_of(rows: DataFrame, period: int, key: str = "series_id", value_col: str = "y_clean", name: str = "season_", robust: bool = False) -> DataFrame:
    """``rows`` (without gaps, ``t`` without holes) with the additive season of their step's phase ``t % period``: the mean (``robust``: the median) distance from a centred moving average over one period, less the mean of all phases.

    0 for series of less than two periods.
    """
    half = period // 2
    span = Window.partitionBy(key).orderBy("t").rowsBetween(-half, half)
    ends = (F.first(value_col).over(span) + F.last(value_col).over(span)) / 2 if period % 2 == 0 else F.lit(0.0)
    whole = F.count(F.lit(1)).over(span) == 2 * half + 1
    away = F.when(whole, F.col(value_col) - (F.sum(value_col).over(span) - ends) / period)
    rows = rows.withColumns({"away_": away, "phase_": F.pmod(F.col("t"), F.lit(period))})
    means = rows.groupBy(key, "phase_").agg((F.percentile("away_", 0.5) if robust else F.avg("away_")).alias("m_"), F.count(F.lit(1)).alias("n_"))
    of_key = Window.partitionBy(key)
    enough = (F.sum("n_").over(of_key) >= 2 * period) & (F.count("m_").over(of_key) == period)
    means = means.select(F.col(key).alias("k_"), F.col("phase_").alias("f_"), F.when(enough, F.col("m_") - F.avg("m_").over(of_key)).otherwise(0.0).alias(name))
    return rows.join(means, F.col(key).eqNullSafe(F.col("k_")) & (F.col("phase_") == F.col("f_"))).drop("k_", "f_", "away_", "phase_")


def clean_robust(long: DataFrame, key: str = "series_id", k: int = 3, fence: float = 3.0, period: int = 1) -> DataFrame:
    """Values whose distance from the centred rolling median leaves the quartile fence of their series become gaps; then gaps are filled.

    With a ``period`` medians and fences are those of the values less a season of medians, so one outlier moves no other value of its phase, and the filling is that of ``clean_standard`` with the period.
    """
    rows = long
    if period > 1:
        rows = season_of(clean_standard(long, key, "y", "filled_"), period, key, "filled_", robust=True).drop("filled_")
    near = Window.partitionBy(key).orderBy("t").rowsBetween(-k, k)
    level = F.col("y") - F.col("season_") if period > 1 else F.col("y")
    rows = rows.withColumn("level_", level).withColumn("resid", F.col("level_") - F.percentile("level_", 0.5).over(near))
    ends = rows.groupBy(key).agg(F.percentile("resid", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    rows = rows.join(ends, key).withColumn("wide", fence * (F.col("q")[1] - F.col("q")[0]))
    inside = (F.col("resid") >= F.col("q")[0] - F.col("wide")) & (F.col("resid") <= F.col("q")[1] + F.col("wide"))
    rows = rows.withColumn("y_in", F.when(inside, F.col("y"))).drop("resid", "q", "wide", "level_", "season_")
    return clean_standard(rows, key, "y_in", period=period).drop("y_in")


def clean_audit(cleaned: DataFrame, key: str = "series_id") -> DataFrame:
    return cleaned.groupBy(key).agg(F.count_if(F.col("y").isNull()).alias("missing_before"), F.count_if(F.col("y_clean").isNull()).alias("missing_after"), F.count_if(F.col("y") != F.col("y_clean")).alias("values_changed"))


def clean_contract(cleaned: DataFrame, lengths: DataFrame, mode: str = "standard", key: str = "series_id") -> DataFrame:
    """Series whose cleaned values are not finite or of the wrong number or, in standard mode, changed where they were finite."""
    bad = F.col("y_clean").isNull() | F.isnan("y_clean") | (F.abs("y_clean") == float("inf"))
    facts = cleaned.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(F.col("y").isNotNull() & (F.col("y") != F.col("y_clean"))).alias("n_changed"))
    reason = F.when(F.col("n_bad") > 0, "not finite").when(F.col("n") != F.col("expected"), "length").when(F.lit(mode == "standard") & (F.col("n_changed") > 0), "changed")
    return facts.join(lengths.select(key, "expected"), key).withColumn("violation", reason).where("violation is not null").select(key, "violation")
