"""Reading, building and writing panels of series, forecasts and results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.files import create_once, exists, sha256_of

SERIES_SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.TimestampNTZType()), T.StructField("freq", T.StringType()), T.StructField("target", T.ArrayType(T.FloatType()))])


def scan_series(spark: SparkSession, path: str, schema: T.StructType = SERIES_SCHEMA) -> DataFrame:
    """Read source records; a file whose columns or types differ from the schema is an error."""
    found = spark.read.parquet(path)
    got, want = ([(f.name, f.dataType.simpleString()) for f in s.fields] for s in (found.schema, schema))
    if got != want:
        raise ValueError(f"source schema differs: {got} instead of {want}")
    return found


def build_panel(facts: DataFrame, series_col: str, time_col: str, value_col: str, grain: str = "day") -> DataFrame:
    """(series_id, ds, y): exact decimal sums of a value by series and calendar step."""
    ds = F.date_trunc(grain, F.col(time_col)).cast("timestamp_ntz" if grain in ("hour", "minute", "second") else "date")
    return facts.groupBy(F.col(series_col).alias("series_id"), ds.alias("ds")).agg(F.sum(F.col(value_col).cast("decimal(18,2)")).cast("double").alias("y"))


def fill_calendar(panel: DataFrame, grain: str = "day", bounds: tuple[str, str] | str = "series") -> DataFrame:
    """(series_id, ds, t, y) on a regular calendar, y null in gaps; bounds are fixed dates or each series' own first and last step."""
    step = F.expr(f"interval 1 {grain}")
    if bounds == "series":
        spans = panel.groupBy("series_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    else:
        kind = panel.schema["ds"].dataType
        spans = panel.select("series_id").distinct().select("series_id", F.lit(bounds[0]).cast(kind).alias("lo"), F.lit(bounds[1]).cast(kind).alias("hi"))
    frame = spans.select("series_id", F.posexplode(F.sequence("lo", "hi", step)).alias("t", "ds"))
    return frame.join(panel, ["series_id", "ds"], "left").select("series_id", "ds", "t", "y")


def select_population(series: DataFrame, n: int, freq: str | None = None, freq_col: str = "freq", order_col: str = "source_row") -> DataFrame:
    """The first n series of a frequency in source order, by a distributed top-n."""
    kept = series if freq is None else series.where(F.col(freq_col) == freq)
    return kept.orderBy(order_col).limit(n)


def check_population(series: DataFrame, n: int, key: str = "series_id") -> DataFrame:
    """A violation row if the population is short or has duplicates; empty if it is right."""
    facts = series.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
    return facts.withColumn("violation", F.when(F.col("n_rows") < n, "short").when(F.col("n_keys") < F.col("n_rows"), "duplicate")).where("violation is not null")


def fetch_pending_series(series: DataFrame, done_keys: DataFrame, key: str = "series_id") -> DataFrame:
    """Only the rows whose key is not done."""
    return series.join(done_keys.select(key), key, "left_anti")


def scan_results(results: DataFrame, keys: DataFrame | None = None, kind: str | None = None, fields: list[str] | None = None, key: str = "input_key") -> DataFrame:
    """Results of a kind and a set of keys, projected to some fields.

    The least and the greatest key are literals of a filter that reaches the file scan, so row groups and files without such keys aren't read.
    """
    out = results if kind is None else results.where(F.col("kind") == kind)
    if keys is not None:
        low, high = keys.agg(F.min(key), F.max(key)).first()
        out = out.where(F.col(key).between(F.lit(low), F.lit(high)) if low is not None else F.lit(False))
        out = out.join(keys.select(key), key, "left_semi")
    return out.select(key, *fields) if fields else out


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, stage, batch) of the committed batches, in their order; a row a batch."""
    if not exists(spark, f"{path}/commits"):
        return []
    rows = spark.read.text(f"{path}/commits", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("long").alias("n"), "value").collect()
    return sorted((r["n"], *r["value"].split("\t")) for r in rows)


def read_results(spark: SparkSession, path: str, stage: str) -> DataFrame | None:
    """The rows that a stage has accepted: those of its committed batches. None before the first one."""
    batches = [f"{path}/batches/{b}" for _, s, b in _commits(spark, path) if s == stage]
    return spark.read.parquet(*batches).withColumn("stage", F.lit(stage)) if batches else None


def append_results(results: DataFrame, path: str, stage: str, key: str = "input_key", tries: int = 100) -> DataFrame:
    """Append the rows whose key the stage has not accepted yet, one row a key; returns what the stage now holds.

    A batch is written to a folder of its own and counts once its name stands in the next numbered file of ``commits``, which only one writer can create. A writer that comes second takes the
    keys that the others have accepted meanwhile out of its batch and tries the next number, so no key is accepted twice. What a killed writer leaves is never read. Of several
    rows with one key, that with the smallest hash of all its values is taken.
    """
    spark = results.sparkSession
    least = results.groupBy(key).agg(F.min_by(F.struct(*results.columns), F.xxhash64(*results.columns)).alias("r_"))
    rows = least.select("r_.*")
    for _ in range(tries):
        seen = _commits(spark, path)
        done = [f"{path}/batches/{b}" for _, s, b in seen if s == stage]
        fresh = rows.join(spark.read.parquet(*done).select(key), key, "left_anti") if done else rows
        batch = uuid.uuid4().hex
        fresh.write.parquet(f"{path}/batches/{batch}")
        rows = spark.read.schema(results.select(*fresh.columns).schema).parquet(f"{path}/batches/{batch}")
        if (done and rows.isEmpty()) or create_once(spark, f"{path}/commits/{(seen[-1][0] if seen else 0) + 1:010d}", f"{stage}\t{batch}"):
            return read_results(spark, path, stage)
    raise RuntimeError(f"no commit in {tries} tries")


def load_external_forecasts(forecasts: DataFrame, series: DataFrame, models: list[str], horizon: int, key: str = "series_id") -> DataFrame:
    """Per wanted (series, model): n, the imported path ``mean`` as an array in the order of steps, and a reason if it is missing, duplicated, short or not finite (then without the path).

    ``imported_paths`` gives the valid ones as forecast rows for the later stages.
    """
    wanted = series.select(key).distinct().crossJoin(series.sparkSession.createDataFrame([(m,) for m in models], "model string"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("h", "mean"))), lambda s: s["mean"])
    got = forecasts.groupBy(key, "model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("n_h"), F.count_if(F.col("mean").isNull() | F.isnan("mean") | (F.abs("mean") == float("inf"))).alias("n_bad"), F.min("h").alias("lo"), F.max("h").alias("hi"), path.alias("path"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n") > F.col("n_h"), "duplicate").when((F.col("n_h") != horizon) | (F.col("lo") != 1) | (F.col("hi") != horizon), "horizon").when(F.col("n_bad") > 0, "not finite")
    return wanted.join(got, [key, "model"], "left").withColumn("reason", reason).select(key, "model", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "reason", F.when(F.col("reason").isNull(), F.col("path")).alias("mean"), F.lit("imported").alias("origin"))


def imported_paths(loaded: DataFrame, key: str = "series_id") -> DataFrame:
    """(input_key, model, h, mean) of what ``load_external_forecasts`` found valid, as the forecast pool gives them."""
    rows = loaded.where("reason is null").select(F.col(key).cast("string").alias("input_key"), "model", F.posexplode("mean").alias("h", "mean"))
    return rows.withColumn("h", F.col("h") + 1)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder; paths are relative to it. A task reads a file in blocks, never as one value."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    root = store.makeQualified(top).toString().rstrip("/") + "/"
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")  # the content isn't read

    def run(batches):
        for pdf in batches:
            yield pdf.assign(sha256=[sha256_of(p) for p in pdf["path"]])

    found = names.mapInPandas(run, "path string, length long, sha256 string")
    short = F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/")
    root = re.sub("^([a-z0-9]+:)/+", r"\1/", root)
    return found.select(F.substring(short, F.lit(len(root) + 1), F.length(short)).alias("path"), F.col("length").alias("size"), "sha256")


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of files (path, size, sha256), as ``file_digests`` gives them, against a manifest: ok, changed, missing or unexpected."""
    have = found.select("path", F.col("size").alias("found_size"), F.col("sha256").alias("found_sha"))
    status = F.when(F.col("found_size").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when((F.col("size") != F.col("found_size")) | (F.col("sha256") != F.col("found_sha")), "changed").otherwise("ok")
    return manifest.join(have, "path", "full_outer").select("path", status.alias("status"))


def write_tables(df: DataFrame, path: str, columns: list[str]) -> None:
    """Publish a result table as CSV files with a header and a fixed order of columns."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)
