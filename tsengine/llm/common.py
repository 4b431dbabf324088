"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import shared_folder as new_folder

_made: list[str] = []  # folders of this process that still exist


def shared_folder(spark: SparkSession, name: str, scratch: bool = True) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; ``scratch``: ``remove_scratch`` may remove it.

    The setting is read from the session. Where it is unset, a session with a local master gets a
    local folder; on a cluster that is an error.
    """
    folder = new_folder(spark, name)
    if scratch:
        if not _made:
            atexit.register(remove_scratch)
        _made.append(folder)
    return folder


def remove_scratch(since: int = 0, until: int | None = None) -> None:
    """Remove the folders made so far, or those from ``since`` to ``until`` by number; results that read them can't be read afterwards.

    Called at the end of the process, by the pipeline after each stage, and by callers who have used their results.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for folder in _made[since:until]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:until]


def n_scratch() -> int:
    """How many folders there are; what is made later can be removed by this number."""
    return len(_made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with row numbers from 1 in the order of columns: sorted range partitions, written, and a prefix sum over one count for each."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id(), "at_": place})
    rows = stored(rows, "numbered")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return rows.join(F.broadcast(counts), "part_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")


def open_folder(folder: str):
    """(file system, path): any store that pyarrow reaches by URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def added_name(columns: list[str], name: str) -> str:
    """The name of a column that an operator adds to others: ``name``, or ``name_2``, ``name_3`` ... where the input has it already."""
    taken, k, out = {c.lower() for c in columns}, 1, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def uniform(*columns: Column | str) -> Column:
    """A number in (0, 1) fixed by the columns: the first 13 hex digits of an md5, offset by half a step."""
    text = F.concat_ws("|", *[c if isinstance(c, Column) else F.lit(c) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def as_one(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as a large_binary or large_string array without nulls (null reads as empty)."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    return values


def utf8_pieces(values: pa.Array, limit: int = 1 << 20):
    """Split a string array into runs of whole rows of about ``limit`` bytes.

    Yields (first row, data, starts): the rows' UTF-8 bytes as one uint8 array and the offset of
    each row in it, with the total length last. A longer row is a run of its own.
    """
    binary = pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)
    values = values.cast(pa.large_binary() if binary else pa.large_string())
    n = len(values)
    if not n:
        return
    offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    row = 0
    if not offsets[-1] - offsets[0]:
        yield 0, data[:0], offsets - offsets[0]
        return
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def slices(text: str, cut, size: int = 1 << 20):
    """A long text in slices of about ``size`` characters, each ending behind the first character of a match of the pattern ``cut``."""
    at = 0
    while len(text) - at > size and (m := cut.search(text, at + size)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
