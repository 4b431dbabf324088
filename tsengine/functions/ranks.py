"""Selections by rank without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4
_held: list[DataFrame] = []  # what ``numbered`` has persisted


def first_by_hash(rows: DataFrame, by: list[str], digest: Column, ties: list[str], quota: Column) -> DataFrame:
    """``rows`` with ``chosen``: whether a row is among the first ``quota`` of its class ``by`` in the order of a hash of hex digits, then ``ties``.

    Rows fall into 16 ** DIGITS bins by the first digits. A window runs over the counts of a class's bins, and another one over the rows of
    the one bin in which the quota of a class is reached.
    """
    binned = rows.withColumns({"hash_": digest, "quota_": quota}).withColumn("bin_", F.conv(F.substring("hash_", 1, DIGITS), 16, 10).cast("int"))
    counts = binned.groupBy(*by, "bin_").agg(F.count(F.lit(1)).alias("n_"), F.first("quota_").alias("q_"))
    upto = F.sum("n_").over(Window.partitionBy(*by).orderBy("bin_"))
    edge = counts.withColumn("upto_", upto).where(F.col("upto_") >= F.col("q_")).groupBy(*by).agg(F.min(F.struct("bin_", (F.col("upto_") - F.col("n_")).alias("before"))).alias("edge_"))
    if by:
        joined = binned.join(edge.withColumnsRenamed({b: f"{b}_e_" for b in by}), [F.col(b).eqNullSafe(F.col(f"{b}_e_")) for b in by], "left").drop(*(f"{b}_e_" for b in by))
    else:
        joined = binned.crossJoin(F.broadcast(edge.groupBy().agg(F.first("edge_").alias("edge_"))))  # one row
    at = F.col("edge_.bin_")
    inside = F.row_number().over(Window.partitionBy(*by, "bin_").orderBy("hash_", *ties)) if by else F.row_number().over(Window.partitionBy("bin_").orderBy("hash_", *ties))
    near = joined.where(F.col("bin_") == at).withColumn("chosen", inside + F.col("edge_.before") <= F.col("quota_"))
    far = joined.where(at.isNull() | (F.col("bin_") != at)).withColumn("chosen", at.isNull() | (F.col("bin_") < at))
    return far.unionByName(near).drop("hash_", "bin_", "edge_", "quota_")


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with row numbers from 1 in the order of columns: sorted range partitions, and a prefix sum over one count for each.

    The sorted rows are persisted, until ``release``: both uses see the same partitions, and a lost one is made again by the same bounds.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id(), "at_": place}).persist()
    _held.append(ranged)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return ranged.join(F.broadcast(counts), "part_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def release() -> None:
    """Give back what ``numbered`` has persisted; its results can still be computed."""
    while _held:
        _held.pop().unpersist()
