"""All registered queries and their SQL. Each query applies an operator to panels built from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decompose, ranks, search
from ..functions.files import shared_folder
from ..operators import clean, direction, evaluate, features, forecast, reports, sensitivity, series, store, windows, winters
from ..sources import panel as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FIRST, LAST, DAYS, L, H = "1995-01-01", "2001-08-01", 2405, 64, 14
LEVELS = [0.025, 0.1, 0.5, 0.9, 0.975]


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql if sql.lstrip().upper().startswith("WITH") else BASE + sql
        return fn

    return add


# ---- the panels, in Spark and in SQL ----


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def facts(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))  # customers grow with the input: never through the driver, however small their files
    return src.build_panel(rows, "c_nationkey", "o_orderdate", "o_totalprice")


def daily(spark, d):
    return src.fill_calendar(facts(spark, d), "day", (FIRST, LAST))


def cleaned(spark, d):
    return clean.clean_standard(daily(spark, d).where(F.col("t") < DAYS - H))


_frames: dict[tuple[str, str, str], DataFrame] = {}


def _frame_of(spark, d, name, long, cut, horizon):
    """One row a series: history (cleaned, the first ``cut`` steps) and actual (the ``horizon`` steps behind as they are).

    Nearly every query starts from such a frame, some several times, so it is persisted for the session; ``forget_frames`` drops it.
    """
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _frames:
        long = clean.clean_standard(long.withColumn("y_in", F.when(F.col("t") < cut, F.col("y"))), value_col="y_in")
        rows = long.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("t", "y", "y_clean"))).alias("r"))
        _frames[key] = rows.select("series_id", F.transform(F.slice("r", 1, cut), lambda r: r["y_clean"]).alias("history"), F.transform(F.slice("r", cut + 1, horizon), lambda r: r["y"]).alias("actual")).persist()
    return _frames[key]


def frame(spark, d):
    return _frame_of(spark, d, "D", daily(spark, d), DAYS - H, H)


def _kept(spark, d, name, make):
    """The result of a stage that others read, persisted for the session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _frames:
        _frames[key] = make().persist()
    return _frames[key]


def forget_frames() -> None:
    """Drop all that is kept for the session: panels, results of stages, forests, numbered rows. For tables that have changed, and between measurements."""
    while _frames:
        _frames.popitem()[1].unpersist()
    _forests.clear()
    ranks.release()


def history(spark, d):
    return frame(spark, d).select("series_id", "history")


def actual_long(spark, d):
    rows = frame(spark, d).select(F.col("series_id").cast("string").alias("input_key"), F.posexplode("actual").alias("h", "actual"))
    return rows.withColumn("h", F.col("h") + 1)


def official(spark, d):
    """input_key, series_id, window (64 values), actual (14), kind."""
    return windows.official_window(frame(spark, d), L).withColumn("input_key", F.col("series_id").cast("string"))


def rolling(spark, d):
    """input_key = series/start, window, actual."""
    return windows.rolling_blocks(history(spark, d), L, H).withColumn("input_key", F.concat_ws("/", F.col("series_id").cast("string"), F.format_string("%09d", "input_start")))


def scales(spark, d, lag=1):
    return evaluate.naive_scale(history(spark, d).withColumn("input_key", F.col("series_id").cast("string")), lag)


def origins(spark, d):
    return official(spark, d).select("input_key", F.element_at("window", -1).alias("origin"))


def drift_direction(spark, d):
    """A stand-in classifier: the direction of the last input step, for every horizon."""
    rows = official(spark, d).select("input_key", (F.element_at("window", -1) > F.element_at("window", -2)).cast("int").alias("label"))
    return rows.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(H))))


def forecasts(spark, d):
    """All models on the official windows, with actual value, scale and origin: the result of the forecasting stage, which evaluation reads again and again."""
    rows = windows.official_window(frame(spark, d).withColumn("scale", evaluate.naive_scale_of("history", 1)), L)
    rows = rows.withColumns({"input_key": F.col("series_id").cast("string"), "origin": F.element_at("window", -1)})
    out = forecast.forecast_pool(rows, H, None, 1, keep=["actual", "scale", "origin"])
    return _kept(spark, d, "forecasts", lambda: out.withColumn("actual", F.element_at("actual", F.col("h"))))


def pool(spark, d, models=forecast.POOL):
    return forecasts(spark, d).where(F.col("model").isin(*models)).select("input_key", "model", "h", "mean")


def r(c, n=4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def fit_sql(name, method, source="offw", x="w"):
    """The fit of each array: the best point (alpha, beta, phi) of the method's grid, of equal errors the first, then the rounds of the search, each a table. Struct f with l, b and the point."""
    first = 1 if method == "ses" else 2
    guess = "(p.l + phi * p.b)"
    step = f"{{'sse': p.sse + (q.l - {guess}) * (q.l - {guess}), 'l': {guess} + alpha * (q.l - {guess}), 'b': phi * p.b + alpha * beta * (q.l - {guess})}}"
    slope = "w[2] - w[1]" if first == 2 else "0.0::DOUBLE"
    best = f"SELECT input_key, arg_min({{'sse': s.sse, 'l': s.l, 'b': s.b, 'alpha': alpha, 'beta': beta, 'phi': phi}}, (s.sse, k)) AS f FROM (SELECT input_key, k, alpha, beta, phi, list_reduce(list_transform(w[{first}:], lambda v: {{'sse': 0.0::DOUBLE, 'l': v, 'b': {slope}}}), lambda p, q: {step}) AS s FROM (SELECT input_key, {x} AS w FROM {source}) CROSS JOIN g) GROUP BY input_key"
    values = lambda rows: "(VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE)" for k, (a, b, p) in enumerate(rows)) + ")"
    out = [f"{name}0 AS MATERIALIZED (WITH g AS (SELECT * FROM {values(forecast.GRIDS[method])} g(k, alpha, beta, phi)) {best})"]
    size = forecast.STEPS[method]
    for turn in range(1, search.ROUNDS + 1):
        moved = [f"least(greatest(f.{c} + {o} * {s}::DOUBLE, {lo}::DOUBLE), {hi}::DOUBLE)" if s else f"f.{c}" for c, o, s, lo, hi in zip(("alpha", "beta", "phi"), "abp", size, forecast.LOW, forecast.HIGH, strict=True)]
        near = f"SELECT input_key, k, {moved[0]} AS alpha, {moved[1]} AS beta, {moved[2]} AS phi FROM {name}{turn - 1} CROSS JOIN {values(search.offsets(size))} o(k, a, b, p)"
        last = name if turn == search.ROUNDS else f"{name}{turn}"
        out.append(f"{last} AS MATERIALIZED (WITH g AS ({near}) {best.replace('CROSS JOIN g', 'JOIN g USING (input_key)')})")
        size = tuple(s / 2 for s in size)
    return ",\n".join(out)


BASE = f"""WITH RECURSIVE facts AS MATERIALIZED (SELECT c_nationkey AS series_id, o_orderdate::DATE AS ds, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
cal AS (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY))::DATE AS ds),
daily AS MATERIALIZED (SELECT s.series_id, c.ds, date_diff('day', DATE '{FIRST}', c.ds)::INT AS t, f.y FROM (SELECT DISTINCT series_id FROM facts) s CROSS JOIN cal c LEFT JOIN facts f ON f.series_id = s.series_id AND f.ds = c.ds),
nb AS (SELECT series_id, t, y, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM daily WHERE t < {DAYS - H}
 WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cleaned AS MATERIALIZED (SELECT series_id, t, y, CASE WHEN y IS NOT NULL THEN y ELSE coalesce(y0 + (y1 - y0) * ((t - t0)::DOUBLE / (t1 - t0)::DOUBLE), y0, y1) END AS y_clean FROM nb),
off AS MATERIALIZED (SELECT series_id::VARCHAR AS input_key, t - {DAYS - H - L} AS i, y_clean AS v FROM cleaned WHERE t >= {DAYS - H - L}),
offw AS MATERIALIZED (SELECT input_key, list(v ORDER BY i) AS w FROM off GROUP BY 1),
act AS MATERIALIZED (SELECT series_id::VARCHAR AS input_key, t - {DAYS - H - 1} AS h, y AS actual FROM daily WHERE t >= {DAYS - H}),
blocks AS (SELECT series_id, (t // {L + H}) * {L + H} AS input_start, t % {L + H} AS i, y_clean AS v FROM cleaned WHERE t < {(DAYS - H) // (L + H) * (L + H)}),
rw AS MATERIALIZED (SELECT series_id::VARCHAR || '/' || lpad(input_start::VARCHAR, 9, '0') AS input_key, series_id, input_start::INT AS input_start, list(v ORDER BY i) FILTER (WHERE i < {L}) AS w, list(v ORDER BY i) FILTER (WHERE i >= {L}) AS a FROM blocks GROUP BY ALL),
hs AS (SELECT unnest(generate_series(1, {H}))::INT AS h),
scale AS MATERIALIZED (SELECT series_id::VARCHAR AS input_key, avg(d) AS scale FROM (SELECT series_id, abs(y_clean - lag(y_clean) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM cleaned) GROUP BY 1),
{fit_sql("sesf", "ses")},
{fit_sql("holtf", "holt")},
{fit_sql("dampedf", "damped")},
slope AS (SELECT input_key, regr_slope(v, i) AS b FROM off GROUP BY 1),
fc AS MATERIALIZED (SELECT input_key, m AS model, h, w[{L}] AS mean FROM offw CROSS JOIN hs CROSS JOIN (SELECT unnest(['naive', 'snaive', 'naive2']) AS m) UNION ALL SELECT input_key, 'rw_drift', h, w[{L}] + h * (w[{L}] - w[1]) / {L - 1} FROM offw CROSS JOIN hs
 UNION ALL SELECT input_key, 'ses', h, f.l FROM sesf CROSS JOIN hs UNION ALL SELECT input_key, 'theta', h, f.l + 0.5 * b * h FROM sesf JOIN slope USING (input_key) CROSS JOIN hs UNION ALL SELECT input_key, 'holt', h, f.l + h * f.b FROM holtf CROSS JOIN hs
 UNION ALL SELECT input_key, 'damped', h, f.l + f.phi * (1 - pow(f.phi, h)) / (1 - f.phi) * f.b FROM dampedf CROSS JOIN hs),
err AS MATERIALIZED (SELECT fc.*, actual, CASE WHEN abs(actual) + abs(mean) > 0 THEN 200 * abs(actual - mean) / (abs(actual) + abs(mean)) END AS term FROM fc JOIN act USING (input_key, h)),
sc AS MATERIALIZED (SELECT input_key, model, avg(term) AS smape, avg(abs(actual - mean)) / any_value(scale) AS mase FROM err JOIN scale USING (input_key) GROUP BY ALL),
owa0 AS MATERIALIZED (SELECT model, avg(smape) AS smape, avg(mase) AS mase FROM sc GROUP BY 1),
owa AS (SELECT a.model, a.smape, a.mase, 0.5 * (a.smape / b.smape + a.mase / b.mase) AS owa FROM owa0 a CROSS JOIN (SELECT * FROM owa0 WHERE model = 'naive2') b),
org AS (SELECT input_key, w[{L}] AS origin, (w[{L}] > w[{L - 1}])::INT AS label FROM offw),
dsc AS MATERIALIZED (SELECT input_key, model, h, ((mean > origin) = (actual > origin))::INT AS correct FROM fc JOIN act USING (input_key, h) JOIN org USING (input_key) WHERE actual IS NOT NULL),
dbh AS MATERIALIZED (SELECT 'raw_origin' AS basis, model, h, sum(correct)::BIGINT AS correct_count, count(*) AS evaluation_count, sum(correct) / count(*)::DOUBLE AS accuracy FROM dsc GROUP BY ALL)
"""

# ---- sources ----


@query("SELECT series_id, ds, y FROM facts")
def build_panel(spark, d):
    return facts(spark, d)


@query("SELECT series_id, ds, t, y FROM daily")
def fill_calendar(spark, d):
    return daily(spark, d)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_series(spark, d):
    from pyspark.sql import types as T

    kinds = {"c_custkey": T.LongType(), "c_name": T.StringType(), "c_nationkey": T.IntegerType(), "c_acctbal": T.DoubleType(), "c_mktsegment": T.StringType()}
    return src.scan_series(spark, f"{d}/customer.parquet", T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50")
def select_population(spark, d):
    return src.select_population(table(spark, d, "customer"), 50, "BUILDING", "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, 'duplicate' AS violation FROM lineitem")
def check_population(spark, d):
    return src.check_population(table(spark, d, "lineitem"), 1, "l_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def fetch_pending_series(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return src.fetch_pending_series(table(spark, d, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def scan_results(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return src.scan_results(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "kind"), keys, "F", ["o_totalprice"], "o_orderkey")


@query(f", own AS (SELECT input_key::INT AS series_id, model, h, CASE WHEN input_key::INT % 5 = 1 AND h = 3 THEN 'nan'::DOUBLE ELSE mean END AS mean FROM fc WHERE model = 'naive2' AND NOT (input_key::INT % 5 = 2 AND h = 14)) SELECT s.series_id, m.model, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < {H} THEN 'horizon' WHEN bad THEN 'not finite' END AS reason, CASE WHEN n = {H} AND NOT bad THEN len(p) ELSE 0 END::INT AS steps, CASE WHEN n = {H} AND NOT bad THEN p[1] END AS first, CASE WHEN n = {H} AND NOT bad THEN p[-1] END AS last, 'imported' AS origin FROM (SELECT DISTINCT series_id FROM facts) s CROSS JOIN (SELECT unnest(['naive2', 'archived']) AS model) m LEFT JOIN (SELECT series_id, model, count(*) AS n, bool_or(isnan(mean)) AS bad, list(round(mean, 4) ORDER BY h) AS p FROM own GROUP BY ALL) o ON o.series_id = s.series_id AND o.model = m.model")
def load_external_forecasts(spark, d):
    """Imported paths: some series lack a step, some have a value that is not a number, one model is missing."""
    own = forecast.fc_naive2(official(spark, d), H).withColumn("series_id", F.col("input_key").cast("int")).where(~((F.col("series_id") % 5 == 2) & (F.col("h") == H)))
    own = own.withColumn("mean", F.when((F.col("series_id") % 5 == 1) & (F.col("h") == 3), float("nan")).otherwise(F.col("mean")))
    out = src.load_external_forecasts(own, facts(spark, d).select("series_id").distinct(), ["naive2", "archived"], H)
    return out.withColumns({"steps": F.when(F.col("mean").isNotNull(), F.size("mean")).otherwise(0), "first": r(F.element_at("mean", 1)), "last": r(F.element_at("mean", -1))}).drop("mean")


@query("WITH f AS (SELECT doc_id::VARCHAR AS path FROM documents), m AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS path, doc_id % 5 = 0 AS other FROM documents) SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unexpected' WHEN other THEN 'changed' ELSE 'ok' END AS status FROM f FULL JOIN m ON f.path = m.path")
def verify_manifest(spark, d):
    """Texts stand for files; of the manifest every seventh name and every fifth hash is wrong."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha256"), "doc_id")
    wrong = files.withColumn("path", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "path")).otherwise(F.col("path"))).withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return src.verify_manifest(files.drop("doc_id"), wrong.drop("doc_id"))


@query("WITH o AS (SELECT o_orderkey AS input_key, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F') SELECT input_key, price, 'import' AS stage FROM o")
def append_results(spark, d):
    """Half of the rows, then all of them: each key is accepted once."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("input_key"), F.col("o_totalprice").alias("price"))
    folder = shared_folder(spark, "results")
    src.append_results(rows.where("input_key % 2 = 0"), folder, "import")
    return src.append_results(rows, folder, "import").select("input_key", "price", "stage")


@query("WITH o AS (SELECT * FROM orders) SELECT o_orderpriority, o_orderkey, o_totalprice FROM o")
def write_tables(spark, d):
    """Written as CSV and read back."""
    folder = shared_folder(spark, "tables")
    src.write_tables(table(spark, d, "orders"), folder, ["o_orderpriority", "o_orderkey", "o_totalprice"])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").schema)
    return spark.read.csv(folder, header=True, schema=kinds)


# ---- canonical forms ----


@query(f"SELECT series_id, count(*)::INT AS observation_count, (count(*) - {H})::INT AS train_end, (count(*) - {H})::INT AS test_start, CASE WHEN count(*) <= {H} THEN 'short' END AS reason FROM facts GROUP BY 1")
def canonical_series(spark, d):
    rows = facts(spark, d).groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ds", "y"))), lambda s: s["y"]).alias("target"))
    return series.canonical_series(rows, H).select("series_id", "observation_count", "train_end", "test_start", "reason")


@query(f"SELECT series_id, {DAYS - H}::INT AS n_history, {H}::INT AS n_actual, round(sum(y) FILTER (WHERE t < {DAYS - H}), 2) AS s_history, round(sum(y) FILTER (WHERE t >= {DAYS - H}), 2) AS s_actual FROM daily GROUP BY 1")
def split_history_test(spark, d):
    add = lambda c: F.round(F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v), 2)
    some = lambda c: F.when(F.exists(c, lambda v: v.isNotNull()), add(c))
    rows = series.split_history_test(series.long_to_series(daily(spark, d), ["series_id"]), H)
    return rows.select("series_id", F.size("history").alias("n_history"), F.size("actual").alias("n_actual"), some("history").alias("s_history"), some("actual").alias("s_actual"))


@query("SELECT series_id, t, y FROM daily")
def series_to_long(spark, d):
    return series.series_to_long(series.long_to_series(daily(spark, d), ["series_id"]), ["series_id"])


@query("SELECT series_id, len(a)::INT AS n, list_count(a)::INT AS n_known, round(a[1], 2) AS first, round(a[-1], 2) AS last FROM (SELECT series_id, list(y ORDER BY t) AS a FROM daily GROUP BY 1)")
def long_to_series(spark, d):
    rows = series.long_to_series(daily(spark, d), ["series_id"])
    return rows.select("series_id", F.size("target").alias("n"), F.size(F.array_compact("target")).alias("n_known"), r(F.element_at("target", 1), 2).alias("first"), r(F.element_at("target", -1), 2).alias("last"))


@query("SELECT 'sales/D/' || series_id || '/rolling/' || lpad(input_start::VARCHAR, 9, '0') AS key, series_id::VARCHAR AS series, input_start AS start FROM rw")
def make_keys(spark, d):
    rows = rolling(spark, d).select(series.make_key("sales", "D", F.col("series_id"), "rolling", F.col("input_start")).alias("key"))
    parts = series.split_key(F.col("key"))
    return rows.select("key", parts["series"].alias("series"), parts["start"].alias("start"))


@query("SELECT o_custkey::BIGINT AS series_id, (count(*) - 2)::INT AS train_end FROM orders GROUP BY 1 HAVING count(*) - 2 >= 8")
def eligible_series(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg((F.count(F.lit(1)) - 2).cast("int").alias("train_end")).withColumn("freq", F.lit("D"))
    return series.eligible_series(rows, spark.createDataFrame([("D", 6, 2)], "freq string, input_length int, horizon int")).select("series_id", "train_end")


STD = f", st AS (SELECT input_key, w, list_avg(w) AS m, list_stddev_samp(w) AS s FROM offw)"


@query(STD + f" SELECT input_key, model, basis, round(CASE WHEN basis = 'raw' THEN w[{L}] ELSE (w[{L}] - m) / s END, 4) AS last, round(CASE WHEN basis = 'raw' THEN NULL ELSE m END, 4) AS centre FROM st CROSS JOIN (SELECT unnest(['naive2', 'theta']) AS model, unnest(['raw', 'standard']) AS basis)")
def input_policy(spark, d):
    rows = windows.apply_standardise(windows.fit_standardise(official(spark, d))).withColumn("raw", F.col("window"))
    out = series.input_policy(rows, {"naive2": "raw", "theta": "standard"})
    return out.select("input_key", "model", "basis", r(F.element_at("context", -1)).alias("last"), r("centre").alias("centre"))


# ---- cleaning ----


@query("SELECT c_custkey, p.period::INT AS period, 'frequency' AS period_source FROM customer JOIN (SELECT unnest(['H','D','W','M','Q','Y']) AS f, unnest([24,1,1,12,4,1]) AS period) p ON p.f = CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'D' END")
def resolve_period(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("D").alias("freq"))
    dim = spark.createDataFrame(list(series.PERIODS.items()), "freq string, default_period int")
    return clean.resolve_period(rows, dim).select("c_custkey", "period", "period_source")


@query("SELECT series_id, t, round(y_clean, 7) AS y_clean FROM cleaned")
def clean_standard(spark, d):
    return cleaned(spark, d).select("series_id", "t", r("y_clean", 7).alias("y_clean"))


@query("SELECT series_id, t, round(y_clean, 7) AS y_clean FROM cleaned")
def clean_segments(spark, d):
    """The same panel by segments of 100 steps, as very long series are cleaned."""
    return clean.clean_standard(daily(spark, d).where(F.col("t") < DAYS - H), segment=100).select("series_id", "t", r("y_clean", 7).alias("y_clean"))


ROBUST = f""", rr AS (SELECT series_id, t, y, y - quantile_cont(y, 0.5) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS resid FROM daily WHERE t < {DAYS - H}),
qq AS (SELECT series_id, quantile_cont(resid, 0.25) AS a, quantile_cont(resid, 0.75) AS b FROM rr GROUP BY 1),
ri AS (SELECT series_id, t, y, CASE WHEN resid >= a - 3 * (b - a) AND resid <= b + 3 * (b - a) THEN y END AS yi FROM rr JOIN qq USING (series_id)),
rn AS (SELECT series_id, t, y, yi, last_value(yi IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN yi IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(yi IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN yi IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM ri
 WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query(ROBUST + "SELECT series_id, t, round(CASE WHEN yi IS NOT NULL THEN yi ELSE coalesce(y0 + (y1 - y0) * ((t - t0)::DOUBLE / (t1 - t0)::DOUBLE), y0, y1) END, 7) AS y_clean FROM rn")
def clean_robust(spark, d):
    return clean.clean_robust(daily(spark, d).where(F.col("t") < DAYS - H)).select("series_id", "t", r("y_clean", 7).alias("y_clean"))


@query("SELECT series_id, count(*) FILTER (WHERE y IS NULL) AS missing_before, count(*) FILTER (WHERE y_clean IS NULL) AS missing_after, count(*) FILTER (WHERE y <> y_clean) AS values_changed FROM cleaned GROUP BY 1")
def clean_audit(spark, d):
    return clean.clean_audit(cleaned(spark, d))


@query("SELECT series_id, 'length' AS violation FROM cleaned WHERE series_id % 2 = 0 GROUP BY 1")
def clean_contract(spark, d):
    want = facts(spark, d).select("series_id").distinct().withColumn("expected", DAYS - H - F.when(F.col("series_id") % 2 == 0, 1).otherwise(0))
    return clean.clean_contract(cleaned(spark, d), want)


# ---- membership, windows, labels, scaling ----

SPLIT = ", sp AS (SELECT series_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '123', series_id)), series_id) <= greatest(1, floor((1.0::DOUBLE - 0.8::DOUBLE) * count(*) OVER ())) THEN 'test' ELSE 'train' END AS partition FROM (SELECT DISTINCT series_id FROM facts))"


def membership(spark, d):
    return _kept(spark, d, "membership", lambda: windows.split_membership(frame(spark, d).select("series_id"), 0.8, 123))


@query(SPLIT + " SELECT series_id, partition FROM sp")
def split_membership(spark, d):
    return membership(spark, d)


@query(SPLIT + " SELECT n_nationkey AS series_id, partition, CASE WHEN partition IS NULL THEN 'evaluation_only' ELSE 'modelling' END AS role FROM nation LEFT JOIN sp ON series_id = n_nationkey AND n_nationkey <> 3")
def membership_roles(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("series_id"))
    return windows.membership_roles(rows, membership(spark, d).where("series_id <> 3"))


@query(f"SELECT input_key, len(w)::INT AS n_in, len(a)::INT AS n_out, round(w[1], 7) AS first, round(w[{L}], 7) AS last, round(a[{H}], 7) AS final FROM rw")
def rolling_blocks(spark, d):
    e = lambda c, k: r(F.element_at(c, k), 7)
    return rolling(spark, d).select("input_key", F.size("window").alias("n_in"), F.size("actual").alias("n_out"), e("window", 1).alias("first"), e("window", -1).alias("last"), e("actual", -1).alias("final"))


@query("SELECT input_key, i::INT AS i, round(v, 7) AS v FROM off")
def official_window(spark, d):
    return official(spark, d).select("input_key", F.posexplode("window").alias("i", "v")).select("input_key", "i", r("v", 7).alias("v"))


LABELS = f", lb AS (SELECT input_key, series_id, input_start, w, h, (a[h] > w[{L}])::INT AS label FROM rw CROSS JOIN hs)"


def labelled(spark, d):
    return windows.direction_labels(rolling(spark, d))


@query(LABELS + " SELECT input_key, h, label FROM lb")
def direction_labels(spark, d):
    return labelled(spark, d).select("input_key", F.posexplode("labels").alias("h", "label")).select("input_key", (F.col("h") + 1).alias("h"), "label")


@query(f"SELECT input_key, round(list_avg(w), 4) AS centre, round(CASE WHEN list_min(w) = list_max(w) THEN 1.0 ELSE list_stddev_samp(w) END, 4) AS scale, {L}::INT AS n, list_min(w) = list_max(w) AS constant FROM rw")
def fit_standardise(spark, d):
    return windows.fit_standardise(rolling(spark, d)).select("input_key", r("centre").alias("centre"), r("scale").alias("scale"), F.col("count").alias("n"), "constant")


@query(STD + " SELECT input_key, i::INT AS i, round((v - m) / s, 6) AS z FROM st JOIN off USING (input_key)")
def apply_standardise(spark, d):
    rows = windows.apply_standardise(windows.fit_standardise(official(spark, d)))
    return rows.select("input_key", F.posexplode("standard").alias("i", "z")).select("input_key", "i", r("z", 6).alias("z"))


@query("SELECT input_key, i::INT AS i, round(v, 6) AS v FROM off")
def invert_standardise(spark, d):
    state = windows.apply_standardise(windows.fit_standardise(official(spark, d)))
    rows = state.select("input_key", F.posexplode("standard").alias("i", "v"))
    return windows.invert_standardise(rows, state, ["v"]).select("input_key", "i", r("v", 6).alias("v"))


@query(", lw AS (SELECT input_key, list_transform(w, lambda v: ln(1 + v)) AS w FROM offw), ls AS (SELECT input_key, w, list_avg(w) AS m, list_stddev_samp(w) AS s FROM lw) SELECT ls.input_key, i::INT AS i, round((w[i + 1] - m) / s, 6) + 0.0 AS v, round(v, 6) AS restored FROM ls JOIN off USING (input_key)")
def transform_steps(spark, d):
    """Logarithms, standardised by a state fitted on them; and back by the inverse steps in reverse order."""
    logs = windows.transform_steps(official(spark, d).withColumns({"centre": F.lit(0.0), "scale": F.lit(1.0)}), ["log1p"], name="logs").drop("centre", "scale")
    rows = windows.transform_steps(windows.fit_standardise(logs, "logs"), ["log1p", "identity", "standardise"])
    rows = windows.transform_steps(rows, ["log1p", "identity", "standardise"], "inverse", "transformed", "restored")
    out = rows.select("input_key", F.posexplode(F.arrays_zip("transformed", "restored")).alias("i", "p"))
    return out.select("input_key", "i", (r("p.transformed", 6) + 0.0).alias("v"), r("p.restored", 6).alias("restored"))


DATASET = LABELS + SPLIT + f", ds AS (SELECT input_key, series_id, input_start, list_avg(w) AS centre, w[{L}] AS reference, sum(label)::INT AS ups, max(label) FILTER (WHERE h = {H}) AS label, max(label) FILTER (WHERE h = 1) AS first_label FROM lb GROUP BY ALL), dd AS (SELECT ds.*, partition FROM ds JOIN sp USING (series_id))"


def dataset(spark, d):
    rows = windows.window_dataset(rolling(spark, d), membership(spark, d)).withColumn("label", F.element_at("labels", -1))
    return _kept(spark, d, "dataset", lambda: rows)


@query(DATASET + " SELECT input_key, round(centre, 4) AS centre, round(reference, 7) AS reference, ups, label, partition, 'prepared_origin' AS basis FROM dd")
def window_dataset(spark, d):
    ups = F.aggregate("labels", F.lit(0), lambda a, v: a + v)
    return dataset(spark, d).select("input_key", r("centre").alias("centre"), r("reference", 7).alias("reference"), ups.alias("ups"), "label", "partition", "basis")


def cohort_sql(cap):
    return DATASET + f""", dc AS (SELECT input_key, first_label AS label FROM dd WHERE partition = 'train' AND first_label IS NOT NULL), cn AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM dc GROUP BY 1), cq AS (SELECT label, n, CASE WHEN total <= {cap} THEN n ELSE greatest(floor(n / total::DOUBLE * {cap}), 1) END AS quota, total FROM cn),
cr AS (SELECT *, CASE WHEN total <= {cap} THEN 0 ELSE {cap} - sum(quota) OVER () END AS rest, row_number() OVER (ORDER BY n DESC, label) AS rk, count(*) OVER () AS k FROM cq),
cf AS (SELECT label, greatest(quota + sign(rest) * (floor(abs(rest) / k) + CASE WHEN rk <= abs(rest) % k THEN 1 ELSE 0 END), 1) AS quota FROM cr),
co AS (SELECT input_key, label, row_number() OVER (ORDER BY md5(concat_ws('|', '124', input_key)), input_key) AS ref_order FROM (SELECT input_key, dc.label, quota, row_number() OVER (PARTITION BY dc.label ORDER BY md5(concat_ws('|', '123', input_key)), input_key) AS rk FROM dc JOIN cf ON cf.label = dc.label) WHERE rk <= quota)"""


COHORT = cohort_sql(10_000)


def cohort(spark, d, cap=10_000):
    """The references: rolling windows of training series, by the first horizon's label."""
    first = dataset(spark, d).where("kind = 'rolling' and partition = 'train'").withColumn("label", F.element_at("labels", 1))
    return _kept(spark, d, f"cohort {cap}", lambda: windows.stratified_cohort(first.where("label is not null"), cap, 123))


@query(COHORT + " SELECT input_key, label, ref_order::INT AS ref_order FROM co")
def stratified_cohort(spark, d):
    return cohort(spark, d)


@query(cohort_sql(100) + " SELECT input_key, label, ref_order::INT AS ref_order FROM co", name="stratified_cohort_capped")
def stratified_cohort_capped(spark, d):
    """With a cap below the number of windows, so quotas act on the given tables."""
    return cohort(spark, d, 100)


@query(DATASET + " SELECT input_key, row_number() OVER (ORDER BY input_key) AS ref_order FROM dd WHERE partition = 'train'")
def full_cohort(spark, d):
    return windows.full_cohort(dataset(spark, d))


@query(COHORT + " SELECT input_key FROM co UNION SELECT input_key FROM offw")
def feature_keys(spark, d):
    return windows.feature_keys(cohort(spark, d), official(spark, d).select("input_key", "kind"))


# ---- features ----


def z(spark, d):
    return features.z_scored(rolling(spark, d).select("input_key", "window"))


def z_sql(source="rw"):
    return f", zz AS MATERIALIZED (SELECT input_key, list_transform(w, lambda v: CASE WHEN list_min(w) < list_max(w) THEN (v - list_avg(w)) / list_stddev_samp(w) ELSE 0.0 END) AS z FROM {source}), zl AS MATERIALIZED (SELECT input_key, unnest(z) AS v, unnest(range(len(z))) AS i FROM zz)"


Z = z_sql()
CROSSING = ", md AS (SELECT input_key, median(v) AS m FROM zl GROUP BY 1), cp AS (SELECT a.input_key, sum(((a.v > m) <> (b.v > m))::INT)::DOUBLE AS crossing_points FROM zl a JOIN zl b ON a.input_key = b.input_key AND b.i = a.i + 1 JOIN md ON md.input_key = a.input_key GROUP BY 1)"
FLAT = ", bn AS (SELECT zl.input_key, i, CASE WHEN list_max(z) > list_min(z) THEN least(floor((v - list_min(z)) / (list_max(z) - list_min(z)) * 10), 9) ELSE 0 END AS b FROM zl JOIN zz USING (input_key)), isl AS (SELECT input_key, b, row_number() OVER (PARTITION BY input_key ORDER BY i) - row_number() OVER (PARTITION BY input_key, b ORDER BY i) AS g FROM bn), rn AS (SELECT input_key, b, g, count(*) AS n FROM isl GROUP BY ALL), fs AS (SELECT input_key, max(n)::DOUBLE AS flat_spots FROM rn GROUP BY 1)"
TILES = f", tl AS (SELECT input_key, i // 10 AS k, var_samp(v) AS a, avg(v) AS b FROM zl WHERE i < {L // 10 * 10} GROUP BY ALL), ts AS (SELECT input_key, var_samp(a) AS lumpiness, var_samp(b) AS stability FROM tl GROUP BY 1)"


@query(f"SELECT input_key, {L}.0::DOUBLE AS series_length, 0.0::DOUBLE AS nperiods, 1.0::DOUBLE AS seasonal_period FROM rw")
def feat_shape(spark, d):
    return features.feat_shape(z(spark, d)).select("input_key", "series_length", "nperiods", "seasonal_period")


ACF = """, d0 AS (SELECT input_key, i, v FROM zl), d1 AS (SELECT a.input_key, a.i, b.v - a.v AS v FROM zl a JOIN zl b ON a.input_key = b.input_key AND b.i = a.i + 1), d2 AS (SELECT a.input_key, a.i, b.v - a.v AS v FROM d1 a JOIN d1 b ON a.input_key = b.input_key AND b.i = a.i + 1),
al AS (SELECT 0 AS k, * FROM d0 UNION ALL SELECT 1, * FROM d1 UNION ALL SELECT 2, * FROM d2), ac AS MATERIALIZED (SELECT k, input_key, i, v - avg(v) OVER (PARTITION BY k, input_key) AS c FROM al), pw AS MATERIALIZED (SELECT k, input_key, sum(c * c) AS p FROM ac GROUP BY ALL),
lg AS MATERIALIZED (SELECT a.k, a.input_key, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM ac a JOIN ac b ON a.k = b.k AND a.input_key = b.input_key AND b.i - a.i BETWEEN 1 AND 10 GROUP BY ALL), af AS MATERIALIZED (SELECT k, input_key, sum(s) FILTER (WHERE lag = 1) / any_value(p) AS a1, sum((s / p) * (s / p)) AS a10 FROM lg JOIN pw USING (k, input_key) GROUP BY ALL)
"""
PACF = """, rl AS (SELECT k, input_key, list(s / p ORDER BY lag) AS r FROM lg JOIN pw USING (k, input_key) WHERE p > 1e-20 GROUP BY ALL),
pf AS (SELECT k, input_key, list_reduce(list_transform(range(6), lambda j: {'j': j, 'phi': []::DOUBLE[], 'e': 1.0::DOUBLE, 's': 0.0::DOUBLE}), lambda p, q: list_transform([CASE WHEN p.e > 1e-12 THEN (r[q.j] - coalesce(list_sum(list_transform(p.phi, lambda x, i: x * r[q.j - i])), 0)) / p.e ELSE 0.0 END], lambda a: {'j': q.j, 'phi': list_append(list_transform(p.phi, lambda x, i: x - a * p.phi[len(p.phi) + 1 - i]), a), 'e': p.e * (1 - a * a), 's': p.s + a * a})[1]).s AS s FROM rl),
pc AS (SELECT input_key, coalesce(max(s) FILTER (WHERE k = 0), 0.0) AS x_pacf5, coalesce(max(s) FILTER (WHERE k = 1), 0.0) AS diff1x_pacf5, coalesce(max(s) FILTER (WHERE k = 2), 0.0) AS diff2x_pacf5, 0.0::DOUBLE AS seas_pacf FROM zz LEFT JOIN pf USING (input_key) GROUP BY 1)
"""
# the lags are made orthogonal one after another; what is left of the squares is what they do not explain
def gram_sql(name, vectors, steps, least):
    """Rounds of orthogonalisation: vs[1] loses what vs[2], vs[3] ... explain, one after another; {name}(input_key, k, vs) has round k."""
    return f"""{name}(input_key, k, vs) AS (SELECT input_key, 1, list_transform(vs, lambda x: list_transform(x, lambda e: e - list_avg(x))) FROM {vectors}
 UNION ALL SELECT input_key, k + 1, list_transform(vs, lambda x, i: CASE WHEN (i = 1 OR i > k + 1) AND list_dot_product(vs[k + 1], vs[k + 1]) > {least} THEN list_transform([list_dot_product(x, vs[k + 1]) / list_dot_product(vs[k + 1], vs[k + 1])], lambda c: list_transform(x, lambda e, j: e - c * vs[k + 1][j]))[1] ELSE x END) FROM {name} WHERE k <= {steps})"""


def lags_sql(n):
    return f"list_transform(range(13), lambda k: list_transform(range(13, {n + 1}), lambda t: s[t - k]))"


# the lags are made orthogonal one after another; what is left of the squares is what they do not explain
ARCH = f""", aq AS (SELECT input_key, list_transform(z, lambda v: (v - list_avg(z)) * (v - list_avg(z))) AS s FROM zz), av AS (SELECT input_key, {lags_sql(L)} AS vs FROM aq),
{gram_sql("gs", "av", 12, 1e-18)},
ah AS (SELECT b.input_key, CASE WHEN list_dot_product(a.vs[1], a.vs[1]) > 1e-18 THEN 1 - list_dot_product(b.vs[1], b.vs[1]) / list_dot_product(a.vs[1], a.vs[1]) ELSE 0.0 END AS arch_lm FROM gs b JOIN gs a ON a.input_key = b.input_key AND a.k = 1 WHERE b.k = 13)
"""
SHAPE = f""", nv AS (SELECT input_key, [z[2:], z[:{L - 1}], list_transform(z[:{L - 1}], lambda v: v ** 2), list_transform(z[:{L - 1}], lambda v: v ** 3)] AS vs FROM zz),
{gram_sql("ng", "nv", 3, 1e-12)},
nu AS (SELECT input_key, list_transform(vs[1], lambda e: e * e) AS s, list_dot_product(vs[1], vs[1]) AS uu FROM ng WHERE k = 2), nw AS (SELECT input_key, list_dot_product(vs[1], vs[1]) AS vv FROM ng WHERE k = 4),
nl AS (SELECT input_key, unnest(list_transform(s, lambda e: e - list_avg(s))) AS c, unnest(range({L - 1})) AS i FROM nu), np AS (SELECT input_key, sum(c * c) AS p FROM nl GROUP BY 1), na AS (SELECT a.input_key, b.i - a.i AS lag, sum(a.c * b.c) AS q FROM nl a JOIN nl b ON a.input_key = b.input_key AND b.i - a.i BETWEEN 1 AND 12 GROUP BY ALL), nf AS (SELECT input_key, sum((q / p) * (q / p)) AS arch_acf FROM na JOIN np USING (input_key) WHERE p > 0 GROUP BY 1),
nr AS (SELECT input_key, {lags_sql(L - 1)} AS vs FROM nu), {gram_sql("nh", "nr", 12, 1e-18)}, ne AS (SELECT b.input_key, CASE WHEN list_dot_product(a.vs[1], a.vs[1]) > 1e-18 THEN 1 - list_dot_product(b.vs[1], b.vs[1]) / list_dot_product(a.vs[1], a.vs[1]) ELSE 0.0 END AS r2 FROM nh b JOIN nh a ON a.input_key = b.input_key AND a.k = 1 WHERE b.k = 13),
sh AS (SELECT zz.input_key, uu >= 1e-9 AND vv >= 1e-9 AND p >= 1e-9 AS good, CASE WHEN good THEN 10 * ln(uu / vv) ELSE 0.0 END AS nonlinearity, CASE WHEN good THEN nf.arch_acf ELSE 0.0 END AS arch_acf, CASE WHEN good THEN r2 ELSE 0.0 END AS arch_r2 FROM zz JOIN nu USING (input_key) JOIN nw USING (input_key) JOIN np USING (input_key) LEFT JOIN nf USING (input_key) JOIN ne USING (input_key))
"""
SPECTRUM = f""", pg AS MATERIALIZED (SELECT input_key, j, sum(c * cos(2 * pi() * j * i / {L})) ** 2 + sum(c * sin(2 * pi() * j * i / {L})) ** 2 AS power FROM (SELECT input_key, i, v - avg(v) OVER (PARTITION BY input_key) AS c FROM zl) CROSS JOIN (SELECT unnest(range(1, {L // 2 + 1})) AS j) GROUP BY ALL), pt AS (SELECT input_key, sum(power) AS total FROM pg GROUP BY 1),
sp AS (SELECT input_key, CASE WHEN any_value(total) > 1e-20 THEN -sum(CASE WHEN power / total > 1e-15 THEN power / total * ln(power / total) ELSE 0 END) / ln({L // 2}) ELSE 0.0 END AS entropy, CASE WHEN any_value(total) > 1e-20 THEN 0.5 + least(greatest(-regr_slope(ln(greatest(power, 1e-12)), ln(4 * sin(pi() * j / {L}) ** 2)) FILTER (WHERE j <= {int(L**0.5)}), 0), 0.5) ELSE 0.5 END AS hurst FROM pg JOIN pt USING (input_key) GROUP BY 1)
"""
UNITROOT = f""", kp AS (SELECT input_key, sum(s * s) AS ss FROM (SELECT input_key, sum(c) OVER (PARTITION BY input_key ORDER BY i) AS s FROM ac WHERE k = 0) GROUP BY 1), kl AS (SELECT input_key, any_value(p) AS p, any_value(p) / {L} + 2 * sum((1 - lag / 4.0::DOUBLE) * s / {L}) FILTER (WHERE lag <= 3) AS lr FROM lg JOIN pw USING (k, input_key) WHERE k = 0 GROUP BY 1),
pr AS (SELECT * FROM (SELECT input_key, i, v AS y, lag(v) OVER (PARTITION BY input_key ORDER BY i) AS l FROM zl) WHERE l IS NOT NULL), pn AS (SELECT input_key, i, y - avg(y) OVER g AS yc, y, l - avg(l) OVER g AS lc FROM pr WINDOW g AS (PARTITION BY input_key)), pb AS (SELECT input_key, sum(lc * y) / greatest(sum(lc * lc), 1e-300) AS b, sum(lc * lc) AS ll FROM pn GROUP BY 1),
pu AS (SELECT input_key, i, yc - b * lc AS u FROM pn JOIN pb USING (input_key)), pv AS (SELECT input_key, sum(u * u) / {L - 1} AS g0, 2 * (0.75 * sum(u * u1) + 0.5 * sum(u * u2) + 0.25 * sum(u * u3)) / {L - 1} AS more FROM (SELECT *, lag(u, 1, 0) OVER g AS u1, lag(u, 2, 0) OVER g AS u2, lag(u, 3, 0) OVER g AS u3 FROM pu WINDOW g AS (PARTITION BY input_key ORDER BY i)) GROUP BY 1),
ur AS (SELECT kp.input_key, CASE WHEN p > 1e-20 THEN ss / ({L * L} * greatest(lr, 1e-300)) ELSE 0.0 END AS unitroot_kpss, CASE WHEN p > 1e-20 THEN {L - 1} * (b - 1) - 0.5 * more * {(L - 1) ** 2} / greatest(ll, 1e-300) ELSE 0.0 END AS unitroot_pp FROM kp JOIN kl USING (input_key) JOIN pb USING (input_key) JOIN pv USING (input_key))
"""
DECOMP = f""", dt AS (SELECT input_key, z, list_transform(range(1, {L + 1}), lambda i: (z[greatest(i - 2, 1)] + z[greatest(i - 1, 1)] + z[i] + z[least(i + 1, {L})] + z[least(i + 2, {L})]) / 5) AS tr FROM zz), de AS (SELECT input_key, unnest(z) AS v, unnest(tr) AS t, unnest(range({L})) AS i FROM dt),
dr AS MATERIALIZED (SELECT *, v - t - avg(v - t) OVER (PARTITION BY input_key) AS c, i - {(L - 1) / 2} AS x, (i - {(L - 1) / 2}) * (i - {(L - 1) / 2}) - {sum((k - (L - 1) / 2) ** 2 for k in range(L)) / L} AS q FROM de),
da AS (SELECT a.input_key, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM dr a JOIN dr b ON a.input_key = b.input_key AND b.i - a.i BETWEEN 1 AND 10 GROUP BY ALL), db AS (SELECT input_key, sum(c * c) AS p, var_pop(v) AS vv, var_pop(v - t) AS vr, sum(t * x) / sqrt(sum(x * x)) AS li, sum(t * q) / sqrt(sum(q * q)) AS cu FROM dr GROUP BY 1),
ds2 AS (SELECT input_key, var_samp((p - c * c * {L} / {L - 1}) / {L - 2}) AS spike FROM dr JOIN db USING (input_key) GROUP BY 1), dq AS (SELECT input_key, sum(s) FILTER (WHERE lag = 1) / greatest(any_value(p), 1e-300) AS e1, sum((s / greatest(p, 1e-300)) * (s / greatest(p, 1e-300))) AS e10 FROM da JOIN db USING (input_key) GROUP BY 1),
dz AS (SELECT input_key, CASE WHEN vv > 0 THEN greatest(0.0, 1 - vr / vv) ELSE 0.0 END AS trend_ma, CASE WHEN vv > 0 THEN li ELSE 0.0 END AS linearity_ma, CASE WHEN vv > 0 THEN cu ELSE 0.0 END AS curvature_ma, CASE WHEN vv > 0 THEN e1 ELSE 0.0 END AS e_acf1_ma, CASE WHEN vv > 0 THEN e10 ELSE 0.0 END AS e_acf10_ma, 0.0::DOUBLE AS seasonal_strength_ma, 0.0::DOUBLE AS peak_ma, 0.0::DOUBLE AS trough_ma, CASE WHEN vv > 0 THEN spike ELSE 0.0 END AS spike_ma FROM db JOIN ds2 USING (input_key) JOIN dq USING (input_key))
"""
SMOOTHING = ", " + fit_sql("zh", "holt", "zz", "z") + ", " + fit_sql("zd", "damped", "zz", "z") + ", sm AS (SELECT zh.input_key, zh.f.alpha AS alpha, zh.f.beta AS beta, zd.f.alpha AS hw_alpha, zd.f.beta AS hw_beta FROM zh JOIN zd USING (input_key))"


def rounded(names, n=5, table=""):
    return ", ".join(f"round({table}{c}, {n}) + 0.0 AS {c}" for c in names)


@query(Z + ACF + " SELECT input_key, round(max(a1) FILTER (WHERE k = 0), 5) + 0.0 AS x_acf1, round(max(a10) FILTER (WHERE k = 0), 5) + 0.0 AS x_acf10, round(max(a1) FILTER (WHERE k = 1), 5) + 0.0 AS diff1_acf1, round(max(a10) FILTER (WHERE k = 1), 5) + 0.0 AS diff1_acf10, round(max(a1) FILTER (WHERE k = 2), 5) + 0.0 AS diff2_acf1, round(max(a10) FILTER (WHERE k = 2), 5) + 0.0 AS diff2_acf10 FROM af GROUP BY 1")
def feat_acf(spark, d):
    out = features.feat_acf(z(spark, d))
    return out.select("input_key", *[r(c, 5).alias(c) for c in ("x_acf1", "x_acf10", "diff1_acf1", "diff1_acf10", "diff2_acf1", "diff2_acf10")])


@query(Z + ACF + PACF + f"SELECT input_key, {rounded(features.PACF)} FROM pc")
def feat_pacf(spark, d):
    return features.feat_pacf(z(spark, d)).select("input_key", *[r(c, 5).alias(c) for c in features.PACF])


@query(Z + CROSSING + " SELECT input_key, crossing_points FROM cp")
def feat_crossing(spark, d):
    return features.feat_crossing(z(spark, d)).select("input_key", "crossing_points")


@query(Z + FLAT + " SELECT input_key, flat_spots FROM fs")
def feat_flat_spots(spark, d):
    return features.feat_flat_spots(z(spark, d)).select("input_key", "flat_spots")


@query(Z + TILES + " SELECT input_key, round(lumpiness, 6) AS lumpiness, round(stability, 6) AS stability FROM ts")
def feat_tiles(spark, d):
    return features.feat_tiles(z(spark, d)).select("input_key", r("lumpiness", 6).alias("lumpiness"), r("stability", 6).alias("stability"))


@query(Z + ARCH + " SELECT input_key, round(arch_lm, 4) AS arch_lm FROM ah")
def feat_arch(spark, d):
    return features.feat_arch(z(spark, d)).select("input_key", r("arch_lm", 4).alias("arch_lm"))


@query(Z + SPECTRUM + f"SELECT input_key, {rounded(features.SPECTRUM)} FROM sp")
def feat_spectrum(spark, d):
    return features.feat_spectrum(z(spark, d)).select("input_key", *[r(c, 5).alias(c) for c in features.SPECTRUM])


@query(Z + SHAPE + f"SELECT input_key, {rounded(features.SHAPE, 4)} FROM sh")
def feat_nonlinear(spark, d):
    return features.feat_nonlinear(z(spark, d)).select("input_key", *[r(c).alias(c) for c in features.SHAPE])


@query(Z + ACF + UNITROOT + f"SELECT input_key, {rounded(features.UNITROOT)} FROM ur")
def feat_unitroot(spark, d):
    return features.feat_unitroot(z(spark, d)).select("input_key", *[r(c, 5).alias(c) for c in features.UNITROOT])


@query(Z + DECOMP + f"SELECT input_key, {rounded(features.DECOMP)} FROM dz")
def feat_decomp(spark, d):
    return features.feat_decomp(z(spark, d)).select("input_key", *[r(c, 5).alias(c) for c in features.DECOMP])


@query(z_sql("offw") + SMOOTHING + " SELECT input_key, alpha, beta, hw_alpha, hw_beta FROM sm")
def feat_smoothing(spark, d):
    return features.feat_smoothing(features.z_scored(official(spark, d).select("input_key", "window"))).select("input_key", "alpha", "beta", "hw_alpha", "hw_beta")


def loess_sql():
    """The robust local trend of 64 values in five rounds (dtr: input_key, i, v, t)."""
    index, dist, weight = decompose.neighbours(L, decompose.trend_span(L), np.arange(L))
    rows = ", ".join(f"({i}, {j}, {d}::DOUBLE, {w!r}::DOUBLE)" for i in range(L) for j, d, w in zip(index[i].tolist(), dist[i].tolist(), weight[i].tolist(), strict=True) if w > 0)
    fit = lambda trust: f"SELECT x.input_key, n.i, sum(w * {trust}) AS s0, sum(w * {trust} * d) AS s1, sum(w * {trust} * d * d) AS s2, sum(w * {trust} * x.v) AS t0, sum(w * {trust} * d * x.v) AS t1, max(x.v) FILTER (WHERE d = 0) AS near"
    value = "CASE WHEN s0 <= 0 THEN near WHEN s0 * s2 - s1 * s1 > 1e-9 * greatest(s0 * s0, 1e-300) THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS t"
    out = [f"ln0 AS MATERIALIZED (SELECT * FROM (VALUES {rows}) n(i, j, d, w))", f"lt0 AS MATERIALIZED (SELECT input_key, i, {value} FROM ({fit('1')} FROM zl x JOIN ln0 n ON n.j = x.i GROUP BY ALL))"]
    for k in range(1, decompose.ROBUST + 1):
        out.append(f"lr{k} AS (SELECT input_key, i, v, v - t AS r FROM zl JOIN lt{k - 1} USING (input_key, i)), lh{k} AS (SELECT input_key, greatest(6 * median(abs(r)), 2 * avg(abs(r))) AS h FROM lr{k} GROUP BY 1)")
        out.append(f"lw{k} AS MATERIALIZED (SELECT input_key, i, v, CASE WHEN h <= 0 THEN 1.0 WHEN abs(r) / h < 1 THEN (1 - (abs(r) / h) ** 2) ** 2 ELSE 0.0 END AS q FROM lr{k} JOIN lh{k} USING (input_key))")
        out.append(f"lt{k} AS MATERIALIZED (SELECT input_key, i, {value} FROM ({fit('x.q')} FROM lw{k} x JOIN ln0 n ON n.j = x.i GROUP BY ALL))")
    return ", " + ",\n".join(out)


STL = loess_sql() + DECOMP.replace(DECOMP[: DECOMP.index("dr AS")], f", de AS (SELECT input_key, v, t, i FROM zl JOIN lt{decompose.ROBUST} USING (input_key, i)),\n").replace("_ma", "")


@query(Z + STL + f"SELECT input_key, {rounded(features.STL)} FROM dz")
def feat_stl(spark, d):
    """Windows have no period here: the trend is a robust local regression."""
    return features.feat_stl(z(spark, d)).select("input_key", *[r(c, 5).alias(c) for c in features.STL])


def seasonal_windows(spark, d, freq):
    return features.z_scored(panel_windows(spark, d, freq).select("input_key", "window"))


@query()
def feat_published(spark, d):
    """All 42 features of the windows of the daily, monthly and hourly panels."""
    parts = [features.feat_published(features.z_scored(official(spark, d).select("input_key", "window"))).withColumn("freq", F.lit("D"))]
    parts += [features.feat_published(seasonal_windows(spark, d, f), p["period"]).withColumn("freq", F.lit(f)) for f, p in PANELS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).select("freq", "input_key", *[r(c).alias(c) for c in features.PUBLISHED])


VECTOR = z_sql("offw") + ACF + PACF + ARCH + UNITROOT + DECOMP + SPECTRUM + SHAPE + SMOOTHING + CROSSING + FLAT + TILES + f""", ax AS (SELECT input_key, coalesce(max(a1) FILTER (WHERE k = 0), 0) AS x_acf1, coalesce(max(a10) FILTER (WHERE k = 0), 0) AS x_acf10, coalesce(max(a1) FILTER (WHERE k = 1), 0) AS diff1_acf1, coalesce(max(a10) FILTER (WHERE k = 1), 0) AS diff1_acf10, coalesce(max(a1) FILTER (WHERE k = 2), 0) AS diff2_acf1, coalesce(max(a10) FILTER (WHERE k = 2), 0) AS diff2_acf10, 0.0::DOUBLE AS seas_acf1 FROM af GROUP BY 1),
ve AS (SELECT *, 0.0::DOUBLE AS nperiods, 1.0::DOUBLE AS seasonal_period, {L}.0::DOUBLE AS series_length FROM ax JOIN pc USING (input_key) JOIN ah USING (input_key) JOIN ur USING (input_key) JOIN dz USING (input_key) JOIN sp USING (input_key) JOIN sh USING (input_key) JOIN sm USING (input_key) JOIN cp USING (input_key) JOIN fs USING (input_key) JOIN ts USING (input_key))
"""


@query(VECTOR + f"SELECT input_key, {rounded(features.ORDER, 4)} FROM ve")
def feat_vector(spark, d):
    out = features.feat_vector(features.z_scored(official(spark, d).select("input_key", "window")))
    return out.select("input_key", *[r(c).alias(c) for c in features.ORDER])


# ---- forecasts ----


@query(f", sd AS (SELECT input_key, sqrt(avg((v - p) * (v - p))) AS s FROM (SELECT input_key, v, lag(v) OVER (PARTITION BY input_key ORDER BY i) AS p FROM off) WHERE p IS NOT NULL GROUP BY 1) SELECT input_key, 'naive' AS model, h, round(w[{L}], 4) AS mean, round(s * sqrt(h), 4) AS se FROM offw JOIN sd USING (input_key) CROSS JOIN hs")
def fc_naive(spark, d):
    return forecast.fc_naive(official(spark, d), H).select("input_key", "model", "h", r("mean").alias("mean"), r("se").alias("se"))


@query(f", sd AS (SELECT a.input_key, sqrt(avg((b.v - a.v) * (b.v - a.v))) AS s FROM off a JOIN off b ON a.input_key = b.input_key AND b.i = a.i + 7 GROUP BY 1) SELECT input_key, 'snaive' AS model, h, round(w[{L} - 7 + ((h - 1) % 7) + 1], 4) AS mean, round(s * sqrt((h - 1) // 7 + 1), 4) AS se FROM offw JOIN sd USING (input_key) CROSS JOIN hs")
def fc_snaive(spark, d):
    return forecast.fc_snaive(official(spark, d), H, 7).select("input_key", "model", "h", r("mean").alias("mean"), r("se").alias("se"))


@query(f", sl AS (SELECT input_key, w, (w[{L}] - w[1]) / {L - 1} AS b FROM offw), sd AS (SELECT input_key, sqrt(sum((v - p - b) * (v - p - b)) / {L - 1}) AS s FROM (SELECT input_key, v, lag(v) OVER (PARTITION BY input_key ORDER BY i) AS p FROM off) JOIN sl USING (input_key) WHERE p IS NOT NULL GROUP BY 1) SELECT input_key, 'rw_drift' AS model, h, round(w[{L}] + h * b, 4) AS mean, round(s * sqrt(h * (1 + h / {L - 1}.0::DOUBLE)), 4) AS se FROM sl JOIN sd USING (input_key) CROSS JOIN hs")
def fc_rw_drift(spark, d):
    return forecast.fc_rw_drift(official(spark, d), H).select("input_key", "model", "h", r("mean").alias("mean"), r("se").alias("se"))


SEAS = f", sc0 AS (SELECT input_key, i, v - avg(v) OVER (PARTITION BY input_key) AS c FROM off), sp0 AS (SELECT input_key, sum(c * c) AS p FROM sc0 GROUP BY 1), sl0 AS (SELECT a.input_key, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM sc0 a JOIN sc0 b ON a.input_key = b.input_key AND b.i - a.i BETWEEN 1 AND 7 GROUP BY ALL), sq0 AS (SELECT input_key, abs(max(s / p) FILTER (WHERE lag = 7)) > 1.645 / sqrt({L}) * sqrt(1 + 2 * sum((s / p) * (s / p)) FILTER (WHERE lag < 7)) AS seasonal FROM sl0 JOIN sp0 USING (input_key) GROUP BY 1)"


@query(SEAS + " SELECT input_key, seasonal FROM sq0")
def seasonality_test(spark, d):
    return forecast.seasonality_test(official(spark, d), 7).select("input_key", "seasonal")


SADJ = SEAS + f", ma AS (SELECT a.input_key, a.i, any_value(a.v) / avg(b.v) AS ratio FROM off a JOIN off b ON a.input_key = b.input_key AND b.i BETWEEN a.i - 3 AND a.i + 3 WHERE a.i BETWEEN 3 AND {L - 4} GROUP BY ALL), sf AS (SELECT input_key, i % 7 AS s, avg(ratio) AS f FROM ma GROUP BY ALL), sg AS (SELECT input_key, s, CASE WHEN seasonal THEN f / avg(f) OVER (PARTITION BY input_key) ELSE 1.0 END AS f FROM sf JOIN sq0 USING (input_key))"


@query(SADJ + " SELECT input_key, s::INT AS s, round(f, 6) AS f FROM sg")
def seasonal_adjust(spark, d):
    return forecast.seasonal_adjust(official(spark, d), 7).select("input_key", F.posexplode("factors").alias("s", "f")).select("input_key", "s", r("f", 6).alias("f"))


@query(SADJ + f" SELECT o.input_key, 'naive2' AS model, h, round(w[{L}] / a.f * b.f, 3) AS mean FROM offw o CROSS JOIN hs JOIN sg a ON a.input_key = o.input_key AND a.s = {(L - 1) % 7} JOIN sg b ON b.input_key = o.input_key AND b.s = ({L} + h - 1) % 7")
def fc_naive2(spark, d):
    return forecast.fc_naive2(official(spark, d), H, 7).withColumn("mean", r("mean", 3))


@query("SELECT input_key, model, h, round(mean, 3) AS mean FROM fc WHERE model = 'ses'")
def fc_ses(spark, d):
    return forecast.fc_ses(official(spark, d), H).withColumn("mean", r("mean", 3))


@query("SELECT input_key, model, h, round(mean, 2) AS mean FROM fc WHERE model = 'holt'")
def fc_holt(spark, d):
    return forecast.fc_holt(official(spark, d), H).withColumn("mean", r("mean", 2))


@query("SELECT input_key, model, h, round(mean, 2) AS mean FROM fc WHERE model = 'damped'")
def fc_damped(spark, d):
    return forecast.fc_damped(official(spark, d), H).withColumn("mean", r("mean", 2))


@query(f"SELECT input_key, model, h, round(mean, 3) AS mean, round(sqrt(f.sse / {L - 1}) * sqrt(1 + (h - 1) * f.alpha * f.alpha), 3) AS se FROM fc JOIN sesf USING (input_key) WHERE model = 'theta'")
def fc_theta(spark, d):
    return forecast.fc_theta(official(spark, d), H).select("input_key", "model", "h", r("mean", 3).alias("mean"), r("se", 3).alias("se"))


THETA_SE = f"SELECT input_key, model, h, mean, sqrt(f.sse / {L - 1}) * sqrt(1 + (h - 1) * f.alpha * f.alpha) AS se FROM fc JOIN sesf USING (input_key) WHERE model = 'theta'"


@query(f" SELECT input_key, model, h, level, round(mean + z * se, 3) AS q FROM ({THETA_SE}) CROSS JOIN (SELECT unnest([0.025, 0.1, 0.5, 0.9, 0.975])::DOUBLE AS level, unnest([-1.9599639845400536, -1.2815515655446008, 0.0, 1.2815515655446008, 1.9599639845400536])::DOUBLE AS z)")
def theta_quantiles(spark, d):
    return forecast.interval_quantiles(forecast.fc_theta(official(spark, d), H), LEVELS).withColumn("q", r("q", 3))


QZ = ", zq AS (SELECT unnest([0.025, 0.1, 0.5, 0.9, 0.975])::DOUBLE AS level, unnest([-1.9599639845400536, -1.2815515655446008, 0.0, 1.2815515655446008, 1.9599639845400536])::DOUBLE AS z), sd AS (SELECT input_key, sqrt(avg((v - p) * (v - p))) AS s FROM (SELECT input_key, v, lag(v) OVER (PARTITION BY input_key ORDER BY i) AS p FROM off) WHERE p IS NOT NULL GROUP BY 1), " + f"fq AS (SELECT input_key, 'naive' AS model, h, level, w[{L}] + z * s * sqrt(h) AS q FROM offw JOIN sd USING (input_key) CROSS JOIN hs CROSS JOIN zq)"


def quantiles(spark, d):
    return forecast.interval_quantiles(forecast.fc_naive(official(spark, d), H), LEVELS)


@query(QZ + " SELECT input_key, model, h, level, round(q, 3) AS q FROM fq")
def interval_quantiles(spark, d):
    return quantiles(spark, d).withColumn("q", r("q", 3))


SPREAD = f""", s1 AS (SELECT input_key, sqrt(avg((v - p) * (v - p))) AS s, sqrt(sum((v - p - (w[{L}] - w[1]) / {L - 1}) * (v - p - (w[{L}] - w[1]) / {L - 1})) / {L - 1}) AS sd FROM (SELECT input_key, v, lag(v) OVER (PARTITION BY input_key ORDER BY i) AS p FROM off) JOIN offw USING (input_key) WHERE p IS NOT NULL GROUP BY 1),
js AS (SELECT unnest(range(1, {H})) AS j), dv AS (SELECT input_key, h, coalesce(sum((f.alpha + f.alpha * f.beta * f.phi * (1 - pow(f.phi, j)) / (1 - f.phi)) ** 2), 0) AS v FROM dampedf CROSS JOIN hs LEFT JOIN js ON j < h GROUP BY ALL), hv AS (SELECT input_key, h, coalesce(sum((f.alpha + f.alpha * f.beta * j) ** 2), 0) AS v FROM holtf CROSS JOIN hs LEFT JOIN js ON j < h GROUP BY ALL),
se AS (SELECT fc.*, CASE WHEN model IN ('naive', 'snaive', 'naive2') THEN s1.s * sqrt(h) WHEN model = 'rw_drift' THEN s1.sd * sqrt(h * (1 + h / {L - 1}.0::DOUBLE)) WHEN model = 'holt' THEN sqrt(hf.f.sse / {L - 2} * (1 + hv.v)) WHEN model = 'damped' THEN sqrt(df.f.sse / {L - 2} * (1 + dv.v)) ELSE sqrt(sf.f.sse / {L - 1} * (1 + (h - 1) * sf.f.alpha * sf.f.alpha)) END AS se FROM fc JOIN s1 USING (input_key) JOIN hv USING (input_key, h) JOIN dv USING (input_key, h) JOIN sesf sf USING (input_key) JOIN holtf hf USING (input_key) JOIN dampedf df USING (input_key))
"""


@query(SPREAD + "SELECT input_key, model, h, level, round(mean + z * se, 2) AS q FROM se CROSS JOIN (SELECT unnest([0.025, 0.1, 0.5, 0.9, 0.975])::DOUBLE AS level, unnest([-1.9599639845400536, -1.2815515655446008, 0.0, 1.2815515655446008, 1.9599639845400536])::DOUBLE AS z)")
def pool_quantiles(spark, d):
    """The quantiles of all models of the pool by their error recursions."""
    return forecast.interval_quantiles(forecast.forecast_pool(official(spark, d), H, errors=True), LEVELS).withColumn("q", r("q", 2))


@query()
def comb_quantiles(spark, d):
    """The mixture of the three smoothing methods by simulated futures."""
    return forecast.mixture_quantiles(official(spark, d), H, LEVELS).withColumn("q", r("q", 3))


@query("SELECT input_key, model, h, round(mean, 2) AS mean FROM fc WHERE NOT (model = 'rw_drift' AND input_key::INT % 2 = 1)")
def forecast_pool(spark, d):
    done = table(spark, d, "nation").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").cast("string").alias("input_key"), F.lit("rw_drift").alias("model"))
    return forecast.forecast_pool(official(spark, d), H, None, 1, done).withColumn("mean", r("mean", 2))


@query(f"SELECT input_key, h, 'ses' AS requested, CASE WHEN input_key::INT % 2 = 0 THEN 'naive2' ELSE 'ses' END AS executed, input_key::INT % 2 = 0 AS fallback_used, round(CASE WHEN input_key::INT % 2 = 0 THEN max(mean) FILTER (WHERE model = 'naive2') ELSE max(mean) FILTER (WHERE model = 'ses') END, 3) AS mean FROM fc GROUP BY input_key, h")
def forecast_fallback(spark, d):
    w = official(spark, d)
    first = forecast.fc_ses(w, H).where(F.col("input_key").cast("int") % 2 == 1)
    return forecast.forecast_fallback(first, forecast.fc_naive2(w, H), "ses", "naive2").withColumn("mean", r("mean", 3))


@query("SELECT input_key, 'naive' AS model, 'horizon' AS violation FROM offw WHERE input_key::INT % 2 = 0")
def forecast_contract(spark, d):
    f = forecast.fc_naive(official(spark, d), H).where((F.col("input_key").cast("int") % 2 == 1) | (F.col("h") < H))
    return forecast.forecast_contract(f, quantiles(spark, d), H, LEVELS)


@query(QZ + " SELECT input_key, model, h, level, round(q, 3) AS q, h % 2 = 0 AS rearranged FROM fq")
def noncrossing_quantiles(spark, d):
    q = quantiles(spark, d).withColumn("level", F.when(F.col("h") % 2 == 0, F.round(1 - F.col("level"), 3)).otherwise(F.col("level")))
    return forecast.noncrossing_quantiles(q).withColumn("q", r("q", 3))


@query(f"SELECT input_key, 'mean7' AS model, h, CASE WHEN input_key::INT % 3 <> 0 THEN round(list_sum(w[{L - 6}:]) / 7, 4) END AS mean, CASE WHEN input_key::INT % 3 = 0 THEN 'ValueError: not {H} finite values' END AS error FROM offw CROSS JOIN hs")
def apply_forecaster(spark, d):
    """A user's function that gives too few values for every third series."""
    rows = official(spark, d).withColumn("window", F.when(F.col("series_id") % 3 == 0, F.slice("window", 1, 3)).otherwise(F.col("window")))
    out = forecast.apply_forecaster(rows, lambda x: [float(sum(x[-7:]) / 7)] * (H if len(x) > 3 else 2), H, "mean7")
    steps = out.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(H))))
    return steps.select("input_key", "model", "h", r(F.element_at("mean", F.col("h"))).alias("mean"), "error")


# ---- direction ----


@query("SELECT DISTINCT greatest(1, least(greatest(1, round_even((0.1::DOUBLE * greatest(n, m)), 0)::INT), n - 1, m - 1))::INT AS width, n, m FROM (SELECT (n_nationkey + 2)::INT AS n, 64::INT AS m FROM nation UNION ALL SELECT (n_nationkey + 2)::INT, (n_nationkey + 2)::INT FROM nation)")
def dtw_width(spark, d):
    n = (F.col("n_nationkey") + 2).cast("int")
    rows = table(spark, d, "nation")
    rows = rows.select(n.alias("n"), F.lit(64).alias("m")).unionByName(rows.select(n.alias("n"), n.alias("m")))
    return rows.select(direction.dtw_width(F.col("n"), F.col("m")).alias("width"), "n", "m").distinct()


def dtw_sql(pairs, n=L, width=6):
    """dg: the distance of each pair (ka, kb, a, b) of ``n`` values, by diagonals of the table of costs: a cell needs its neighbours on the last two."""
    return f""", dp AS ({pairs}),
dg(ka, kb, a, b, k, d1, d2) USING KEY (ka, kb) AS (SELECT ka, kb, a, b, 0, list_transform(range({n + 1}), lambda i: CASE WHEN i = 1 THEN abs(a[1] - b[1]) ELSE 'inf'::DOUBLE END), list_transform(range({n + 1}), lambda i: 'inf'::DOUBLE) FROM dp
 UNION SELECT ka, kb, a, b, k + 1, list_transform(range({n + 1}), lambda i: CASE WHEN i >= 1 AND k + 3 - i BETWEEN 1 AND {n} AND abs(2 * i - k - 3) <= {width} THEN least(d1[i] + abs(a[i] - b[k + 3 - i]), d1[i + 1] + abs(a[i] - b[k + 3 - i]), d2[i] + 2 * abs(a[i] - b[k + 3 - i])) ELSE 'inf'::DOUBLE END), d1 FROM dg WHERE k < {2 * n - 2})"""


@query(dtw_sql("SELECT a.input_key AS ka, b.input_key AS kb, a.w AS a, b.w AS b FROM offw a JOIN offw b ON a.input_key::INT + 1 = b.input_key::INT") + f" SELECT ka, kb, round(d1[{L + 1}], 4) AS distance FROM dg WHERE k = {2 * L - 2}")
def dtw_distance(spark, d):
    a = official(spark, d).select(F.col("input_key").alias("ka"), F.col("series_id").alias("sa"), F.col("window").alias("a"))
    b = official(spark, d).select(F.col("input_key").alias("kb"), F.col("series_id").alias("sb"), F.col("window").alias("b"))
    return direction.dtw_distance(a.join(b, F.col("sa") + 1 == F.col("sb"))).select("ka", "kb", r("distance").alias("distance"))


def refs(spark, d):
    return dataset(spark, d).select("input_key", F.col("standard").alias("v"), "labels").join(cohort(spark, d).select("input_key", "ref_order"), "input_key").withColumnRenamed("input_key", "ref_key")


def query_windows(spark, d):
    return windows.apply_standardise(windows.fit_standardise(official(spark, d))).select("input_key", F.col("standard").alias("v"))


@query()  # SQL takes minutes for it; a test compares it with all pairs
def dtw_1nn(spark, d):
    return direction.dtw_1nn(query_windows(spark, d), refs(spark, d))


SHORT = 16
TAILS = f", sq1 AS (SELECT input_key, list_transform(w[{L - SHORT + 1}:], lambda v: (v - m) / CASE WHEN list_min(w) = list_max(w) THEN 1.0 ELSE s END) AS v FROM (SELECT input_key, w, list_avg(w) AS m, list_stddev_samp(w) AS s FROM offw)), sr1 AS (SELECT input_key, ref_order, list_transform(w[{L - SHORT + 1}:], lambda v: (v - m) / CASE WHEN list_min(w) = list_max(w) THEN 1.0 ELSE s END) AS v FROM (SELECT input_key, w, list_avg(w) AS m, list_stddev_samp(w) AS s FROM rw) JOIN co USING (input_key))"


@query(COHORT + TAILS + dtw_sql("SELECT q.input_key AS ka, r.input_key AS kb, q.v AS a, r.v AS b FROM sq1 q CROSS JOIN sr1 r", SHORT, 2) + f" SELECT ka AS input_key, arg_min(kb, (d1[{SHORT + 1}], ref_order)) AS ref_key, arg_min(ref_order, (d1[{SHORT + 1}], ref_order))::BIGINT AS ref_order, round(min(d1[{SHORT + 1}]), 6) AS distance FROM dg JOIN co ON co.input_key = kb WHERE k = {2 * SHORT - 2} GROUP BY ka")
def dtw_1nn_short(spark, d):
    """The same over the last values of each window, which SQL can compare with all pairs."""
    last = lambda rows: rows.withColumn("v", F.slice("v", L - SHORT + 1, SHORT))
    return direction.dtw_1nn(last(query_windows(spark, d)), last(refs(spark, d))).withColumn("distance", r("distance", 6))


@query("WITH q AS (SELECT vec_id::VARCHAR AS input_key, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id::VARCHAR AS ref_key, vec_id AS ref_order, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT input_key, ref_key, ref_order, list_distance(q.v, r.v) AS distance FROM q JOIN r ON input_key <> ref_key), b AS (SELECT *, row_number() OVER (PARTITION BY input_key ORDER BY distance, ref_order) AS rk FROM p) SELECT input_key, ref_key, ref_order, round(distance, 6) AS distance FROM b WHERE rk = 1")
def knn_join_l2(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("input_key"), "v")
    refs_ = e.select(F.col("vec_id").cast("string").alias("ref_key"), F.col("vec_id").alias("ref_order"), "v")
    return direction.knn_join_l2(q, refs_, skip_own=True).withColumn("distance", r("distance", 6))


@query(f", rs AS (SELECT input_key, w, j, greatest((j + 0.5) * {L} / 512.0::DOUBLE - 0.5, 0.0)::DOUBLE AS x FROM offw CROSS JOIN (SELECT unnest(range(512)) AS j)) SELECT input_key, j::INT AS j, round(w[least(floor(x), {L - 1})::INT + 1] * (1 - (x - floor(x))) + w[least(floor(x) + 1, {L - 1})::INT + 1] * (x - floor(x)) + 0.0001::DOUBLE, 3) AS v FROM rs")
def linear_resize(spark, d):
    return direction.linear_resize(official(spark, d), 512).select("input_key", F.posexplode("resized").alias("j", "v")).select("input_key", "j", r(F.col("v") + 0.0001, 3).alias("v"))  # many values lie halfway between two thousandths, which engines round either way


@query(COHORT + f" SELECT co.input_key, ref_order::INT AS ref_order, {L}::INT AS n_features, lb.label FROM co JOIN lb ON lb.input_key = co.input_key AND lb.h = 3 WHERE lb.label IS NOT NULL")
def training_matrix(spark, d):
    v, c = dataset(spark, d), cohort(spark, d)
    return direction.training_matrix(v.select("input_key", F.col("standard").alias("v")), v.select("input_key", "labels"), c, 3).select("input_key", "ref_order", F.size("features").alias("n_features"), "label")


_forests: dict[tuple[str, str], dict] = {}


def forests(spark, d):
    """The forests of all horizons, fitted once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key in _forests:
        return _forests[key]
    v = dataset(spark, d).select("input_key", "kind", "partition", F.col("standard").alias("v"), "labels").persist()  # read by every fit
    _forests[key] = direction.rf_fit_horizons(v.select("input_key", "v"), v.select("input_key", "labels"), windows.full_cohort(v), H)
    v.unpersist()
    return _forests[key]


@query(DATASET + " SELECT h, CASE WHEN min(lb.label) = max(lb.label) THEN 0 ELSE 200 END::INT AS trees, count(lb.label) AS n_rows FROM dd JOIN lb USING (input_key) WHERE partition = 'train' GROUP BY h HAVING count(lb.label) > 0")
def rf_fit_horizons(spark, d):
    """A row a horizon: its trees (0: a constant) and how many rows it was fitted on."""
    rows = dataset(spark, d)
    sizes = direction.training_rows(rows.select("input_key", "labels"), windows.full_cohort(rows), H)
    trees = [(h, 0 if isinstance(m, int) else m.getNumTrees) for h, m in forests(spark, d).items()]
    return sizes.join(F.broadcast(spark.createDataFrame(trees, "h int, trees int")), "h").select("h", "trees", "n_rows")  # a row a horizon


@query()
def rf_predict_horizons(spark, d):
    return direction.rf_predict_horizons(query_windows(spark, d), forests(spark, d))


@query(f"SELECT input_key, 'drift' AS model FROM offw WHERE input_key::INT % 2 = 0")
def prediction_contract(spark, d):
    rows = drift_direction(spark, d).where((F.col("input_key").cast("int") % 2 == 1) | (F.col("h") < H)).withColumn("model", F.lit("drift"))
    return forecast.prediction_contract(rows, H)


# ---- combination and metrics ----


@query("SELECT input_key, 'comb' AS model, h, round(sum(mean) / 3, 2) AS mean FROM fc WHERE model IN ('ses', 'holt', 'damped') GROUP BY ALL")
def combine_comb(spark, d):
    return evaluate.combine_comb(pool(spark, d, ("ses", "holt", "damped"))).withColumn("mean", r("mean", 2))


@query("SELECT input_key, 'weighted' AS model, h, round(sum(mean * CASE model WHEN 'naive2' THEN 0.25 ELSE 0.75 END), 6) AS mean FROM fc WHERE model IN ('naive2', 'rw_drift') GROUP BY ALL")
def combine_weighted(spark, d):
    return evaluate.combine_weighted(pool(spark, d, ("naive2", "rw_drift")), {"naive2": 0.25, "rw_drift": 0.75}).withColumn("mean", r("mean", 6))


@query("SELECT f AS freq, CASE f WHEN 'H' THEN 24 WHEN 'M' THEN 12 WHEN 'Q' THEN 4 ELSE 1 END::INT AS lag, count(*) AS n FROM (SELECT ['H','D','W','M','Q','Y'][(c_nationkey % 6) + 1] AS f FROM customer) GROUP BY ALL")
def mase_lag(spark, d):
    freq = F.element_at(F.array(*map(F.lit, "HDWMQY")), F.col("c_nationkey") % 6 + 1)
    return table(spark, d, "customer").select(freq.alias("freq")).groupBy("freq").agg(F.count(F.lit(1)).alias("n")).select("freq", evaluate.mase_lag(F.col("freq")).alias("lag"), "n")


@query("SELECT input_key, model, round(smape, 4) AS smape FROM sc")
def metric_smape(spark, d):
    return evaluate.metric_smape(pool(spark, d), actual_long(spark, d)).withColumn("smape", r("smape"))


@query("SELECT input_key, model, round(mase, 5) AS mase, NULL::VARCHAR AS violation FROM sc")
def metric_mase(spark, d):
    return evaluate.metric_mase(pool(spark, d), actual_long(spark, d), scales(spark, d)).withColumn("mase", r("mase", 5))


def series_scores(spark, d):
    """sMAPE and MASE of every model in one pass: forecasts carry the actual values and the scale of their window."""
    return evaluate.series_scores(forecasts(spark, d))


def owa_table(spark, d):
    return evaluate.metric_owa(series_scores(spark, d))


@query("SELECT model, round(smape, 4) AS smape, round(mase, 5) AS mase, round(owa, 5) AS owa FROM owa")
def metric_owa(spark, d):
    return owa_table(spark, d).select("model", r("smape").alias("smape"), r("mase", 5).alias("mase"), r("owa", 5).alias("owa"))


QUERIES["baseline_comparison"], ORACLE_SQL["baseline_comparison"] = metric_owa, ORACLE_SQL["metric_owa"]


@query("SELECT a.model, round(0.5 * (a.smape / b.smape + a.mase / b.mase), 5) AS owa FROM owa a CROSS JOIN (SELECT * FROM owa WHERE model = 'ses') b")
def rebase_owa(spark, d):
    rows = owa_table(spark, d).drop("owa")
    return evaluate.rebase_owa(rows, rows.where("model = 'ses'")).select("model", r("owa", 5).alias("owa"))


@query("SELECT input_key, model, round(avg((actual - mean) * (actual - mean)), 0) AS mse, round(avg(abs(actual - mean)), 3) AS mae, round(avg(abs(actual - mean)) / any_value(scale), 5) AS mase, round(avg(CASE WHEN actual <> 0 THEN abs((actual - mean) / actual) END), 5) AS mape, round(avg(term), 4) AS smape, round(sqrt(avg((actual - mean) * (actual - mean))), 3) AS rmse, round(sqrt(avg((actual - mean) * (actual - mean))) / avg(abs(actual)), 5) AS nrmse, round(avg(abs(actual - mean)) / avg(abs(actual)), 5) AS nd FROM err JOIN scale USING (input_key) GROUP BY ALL")
def point_metrics(spark, d):
    out = evaluate.point_metrics(pool(spark, d), actual_long(spark, d), scales(spark, d))
    places = {"mse": 0, "mae": 3, "mase": 5, "mape": 5, "smape": 4, "rmse": 3, "nrmse": 5, "nd": 5}
    return out.select("input_key", "model", *[r(c, n).alias(c) for c, n in places.items()])


@query(QZ + """, st AS (SELECT input_key, model, h, any_value(actual) AS a, sum(CASE WHEN level BETWEEN 0.1 AND 0.9 THEN 2 * CASE WHEN actual >= q THEN level * (actual - q) ELSE (level - 1) * (actual - q) END END) AS loss, max(q) FILTER (WHERE level = 0.5) AS med, max(q) FILTER (WHERE level = 0.025) AS lo, max(q) FILTER (WHERE level = 0.975) AS hi FROM fq JOIN act USING (input_key, h) WHERE actual IS NOT NULL GROUP BY ALL)
SELECT input_key, model, round(avg((a - med) * (a - med)), 0) AS mse_median, round(avg((hi - lo) + 40 * greatest(lo - a, 0) + 40 * greatest(a - hi, 0)) / any_value(scale), 4) AS msis, round(sum(loss) / 3 / sum(abs(a)), 5) AS mean_weighted_quantile_loss FROM st JOIN scale USING (input_key) GROUP BY ALL""")
def quantile_metrics(spark, d):
    out = evaluate.quantile_metrics(quantiles(spark, d), actual_long(spark, d), scales(spark, d))
    return out.select("input_key", "model", r("mse_median", 0).alias("mse_median"), r("msis").alias("msis"), r("mean_weighted_quantile_loss", 5).alias("mean_weighted_quantile_loss"))


@query(f"SELECT input_key, model, CASE WHEN model = 'ses' THEN 'mean_only' ELSE 'quantile' END AS capability, count(actual) AS n_used, count(*) - count(actual) AS n_masked, CASE WHEN model = 'ses' THEN 'point' ELSE 'point_and_quantile' END AS metric_set FROM err GROUP BY ALL")
def metric_mask(spark, d):
    f = pool(spark, d).withColumn("capability", F.when(F.col("model") == "ses", "mean_only").otherwise("quantile"))
    return evaluate.metric_mask(actual_long(spark, d), f)


@query("SELECT input_key, model, m AS metric FROM (SELECT input_key, model, unnest([CASE WHEN k = 0 THEN 'smape' END, CASE WHEN k < 3 THEN 'mase' END]) AS m FROM (SELECT input_key, model, input_key::INT % 4 AS k FROM sc)) WHERE m IS NOT NULL")
def finite_metrics(spark, d):
    """Of every fourth series the actual values are missing; some scales are infinite or not a number."""
    k = F.col("input_key").cast("int") % 4
    rows = forecasts(spark, d).withColumns({"actual": F.when(k > 0, F.col("actual")), "scale": F.when(k == 1, float("nan")).when(k == 2, 0.0).otherwise(F.col("scale"))})
    out = evaluate.series_scores(rows).withColumn("mase", F.when(k == 1, float("nan")).otherwise(F.col("mase")))
    return evaluate.finite_metrics(out, ["smape", "mase"], ["input_key", "model"])


@query("SELECT input_key, model, h, (mean > origin)::INT AS label FROM fc JOIN org USING (input_key)")
def forecast_direction(spark, d):
    return evaluate.forecast_direction(pool(spark, d), origins(spark, d))


def scored(spark, d):
    o = origins(spark, d)
    truth = actual_long(spark, d).join(o, "input_key").select("input_key", "h", (F.col("actual") > F.col("origin")).cast("int").alias("label"))
    return evaluate.direction_score(evaluate.forecast_direction(pool(spark, d), o), truth, "raw_origin")


def by_horizon(spark, d):
    return evaluate.direction_by_horizon(scored(spark, d))


@query("SELECT input_key, model, h, 'raw_origin' AS basis, correct FROM dsc")
def direction_score(spark, d):
    return scored(spark, d)


@query("SELECT basis, model, h, correct_count, evaluation_count, round(accuracy, 6) AS accuracy FROM dbh")
def direction_by_horizon(spark, d):
    return by_horizon(spark, d).withColumn("accuracy", r("accuracy", 6))


@query("SELECT basis, model, round(arg_max(accuracy, h), 6) AS da, max(h) AS h FROM dbh GROUP BY ALL")
def terminal_da(spark, d):
    return evaluate.terminal_da(by_horizon(spark, d)).withColumn("da", r("da", 6))


@query("SELECT model, h, 'basis' AS violation FROM dbh WHERE h = 3")
def basis_guard(spark, d):
    rows = by_horizon(spark, d).withColumn("basis", F.when(F.col("h") == 3, "prepared_origin").otherwise(F.col("basis")))
    return evaluate.basis_guard(rows, "raw_origin", ["model", "h"])


# ---- sensitivity ----

GRID = ", gu AS (SELECT round(1 + 0.005::DOUBLE * unnest(range(25)), 3) AS lambda_up), gd AS (SELECT round(1 - 0.005::DOUBLE * unnest(range(21)), 3) AS lambda_down)"


GATE = f", gt AS (SELECT input_key, model, label, origin, CASE WHEN (last > origin)::INT = label THEN 'keep' WHEN label = 1 THEN 'up' ELSE 'down' END AS gate FROM (SELECT input_key, model, arg_max(mean, h) AS last FROM fc GROUP BY ALL) JOIN org USING (input_key))"


@query(GATE + GRID + ", gn AS (SELECT model, count(*) FILTER (WHERE gate = 'up') AS n_up, count(*) FILTER (WHERE gate = 'down') AS n_down FROM gt GROUP BY 1) SELECT model, lambda_up, lambda_down, CASE WHEN lambda_up = 1 THEN 0 ELSE n_up END + CASE WHEN lambda_down = 1 THEN 0 ELSE n_down END AS n_moved FROM gn CROSS JOIN gu CROSS JOIN gd")
def lambda_grid(spark, d):
    """How many series each point of the grid moves, for each model."""
    gates = sensitivity.gates(pool(spark, d), drift_direction(spark, d), origins(spark, d))
    counts = gates.groupBy("model").agg(F.count_if(F.col("gate") == "up").alias("n_up"), F.count_if(F.col("gate") == "down").alias("n_down"))
    moved = F.when(F.col("lambda_up") == 1, 0).otherwise(F.col("n_up")) + F.when(F.col("lambda_down") == 1, 0).otherwise(F.col("n_down"))
    return counts.crossJoin(F.broadcast(sensitivity.lambda_grid(spark))).select("model", "lambda_up", "lambda_down", moved.alias("n_moved"))  # 525 points


@query(GATE + " SELECT input_key, model, h, round(mean * CASE gate WHEN 'up' THEN 1.1 WHEN 'down' THEN 0.9 ELSE 1 END, 3) AS mean FROM fc JOIN gt USING (input_key, model)")
def direction_adjust(spark, d):
    out = sensitivity.direction_adjust(pool(spark, d), drift_direction(spark, d), origins(spark, d), 1.1, 0.9)
    return out.select("input_key", "model", "h", r("mean", 3).alias("mean"))


SURFACE = GATE + GRID + """, ss AS (SELECT f.model, lambda_up, lambda_down, f.input_key, avg(CASE WHEN abs(actual) + abs(m) > 0 THEN 200 * abs(actual - m) / (abs(actual) + abs(m)) END) AS s, avg(abs(actual - m)) / any_value(scale) AS ma, sum(((m > origin) = (actual > origin))::INT) AS c, count(actual) AS k FROM (SELECT fc.*, lambda_up, lambda_down, origin, mean * CASE gate WHEN 'up' THEN lambda_up WHEN 'down' THEN lambda_down ELSE 1 END AS m FROM fc JOIN gt USING (input_key, model) CROSS JOIN gu CROSS JOIN gd) f JOIN act USING (input_key, h) JOIN scale USING (input_key) GROUP BY f.model, lambda_up, lambda_down, f.input_key),
sf2 AS (SELECT model, lambda_up, lambda_down, sum(s) / count(*) AS smape, sum(ma) / count(*) AS mase, sum(c)::BIGINT AS correct_count, sum(k)::BIGINT AS step_count, count(*) AS evaluation_count FROM ss GROUP BY ALL), sfo AS (SELECT a.*, 0.5 * (a.smape / b.smape + a.mase / b.mase) AS owa FROM sf2 a CROSS JOIN (SELECT * FROM owa WHERE model = 'naive2') b)"""


def surface(spark, d):
    ref = owa_table(spark, d).where("model = 'naive2'")
    return sensitivity.sensitivity_surface(pool(spark, d), drift_direction(spark, d), actual_long(spark, d), origins(spark, d), scales(spark, d), ref)


@query(SURFACE + " SELECT model, lambda_up, lambda_down, round(smape, 4) AS smape, round(mase, 5) AS mase, correct_count, step_count, evaluation_count, round(owa, 5) AS owa FROM sfo")
def sensitivity_surface(spark, d):
    return surface(spark, d).select("model", "lambda_up", "lambda_down", r("smape").alias("smape"), r("mase", 5).alias("mase"), "correct_count", "step_count", "evaluation_count", r("owa", 5).alias("owa"))


@query(SURFACE + " SELECT model, lambda_up, lambda_down, round(smape, 4) AS smape, round(mase, 5) AS mase, correct_count, evaluation_count, round(owa, 5) AS owa FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(owa, 10), round(abs(lambda_up - 1) + abs(lambda_down - 1), 6), round(abs(lambda_up - 1), 6), round(abs(lambda_down - 1), 6), lambda_up, lambda_down) AS rk FROM sfo) WHERE rk = 1")
def select_candidate(spark, d):
    return sensitivity.select_candidate(surface(spark, d)).select("model", "lambda_up", "lambda_down", r("smape").alias("smape"), r("mase", 5).alias("mase"), "correct_count", "evaluation_count", r("owa", 5).alias("owa"))


WINNERS = "(SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(owa, 10), round(abs(lambda_up - 1) + abs(lambda_down - 1), 6), round(abs(lambda_up - 1), 6), round(abs(lambda_down - 1), 6), lambda_up, lambda_down) AS rk FROM sfo)"


@query(SURFACE + f" SELECT input_key, model, h, round(mean * CASE gate WHEN 'up' THEN lambda_up WHEN 'down' THEN lambda_down ELSE 1 END, 2) AS mean FROM fc JOIN gt USING (input_key, model) JOIN (SELECT model, lambda_up, lambda_down FROM {WINNERS} WHERE rk = 1) USING (model)")
def selected_paths(spark, d):
    """Every model's forecasts under the pair that wins on its surface."""
    out = sensitivity.selected_paths(pool(spark, d), drift_direction(spark, d), origins(spark, d), sensitivity.select_candidate(surface(spark, d)))
    return out.select("input_key", "model", "h", r("mean", 2).alias("mean"))


@query(""", om AS (SELECT input_key, model, round(0.5 + k * 0.001::DOUBLE, 3) AS lam, avg(CASE WHEN abs(actual) + abs(mean * round(0.5 + k * 0.001::DOUBLE, 3)) > 0 THEN 200 * abs(actual - mean * round(0.5 + k * 0.001::DOUBLE, 3)) / (abs(actual) + abs(mean * round(0.5 + k * 0.001::DOUBLE, 3))) END) AS o FROM err CROSS JOIN (SELECT unnest(range(1001)) AS k) GROUP BY ALL) SELECT input_key, model, round(arg_min(lam, (o, lam)), 3) AS multiplier, round(any_value(least_o), 4) AS smape, count(*) FILTER (WHERE o <= least_o + pow(2.0::DOUBLE, -26))::INT AS ties, NULL::VARCHAR AS violation FROM (SELECT *, min(o) OVER (PARTITION BY input_key, model) AS least_o FROM om) GROUP BY ALL""")
def oracle_multiplier(spark, d):
    return sensitivity.oracle_multiplier(pool(spark, d), actual_long(spark, d)).select("input_key", "model", "multiplier", r("smape").alias("smape"), "ties", "violation")


# ---- reports ----


def selected(spark, d):
    return owa_table(spark, d).join(evaluate.terminal_da(by_horizon(spark, d)).select("model", "da"), "model")


SEL = ", se AS (SELECT o.model, smape, mase, owa, da FROM owa o JOIN (SELECT model, arg_max(accuracy, h) AS da FROM dbh GROUP BY 1) t ON t.model = o.model), sr AS (SELECT * FROM se WHERE model = 'naive2')"


@query(SEL + " SELECT se.model, round(se.smape, 4) AS smape, round(se.owa, 5) AS owa, round(100 * (1 - se.smape / sr.smape), 4) + 0.0 AS smape_improvement, round(100 * (1 - se.owa / sr.owa), 4) + 0.0 AS owa_improvement FROM se CROSS JOIN sr")
def table1(spark, d):
    return reports.table1(selected(spark, d), "naive2", ["smape", "owa"]).select("model", r("smape").alias("smape"), r("owa", 5).alias("owa"), r("smape_improvement").alias("smape_improvement"), r("owa_improvement").alias("owa_improvement"))


@query(SEL + " SELECT 'A' AS panel, model, round(da, 4) AS value FROM se WHERE da IS NOT NULL UNION ALL SELECT 'B', model, round(owa, 4) FROM se UNION ALL SELECT 'C', se.model, round(100 * (1 - se.owa / sr.owa), 4) + 0.0 FROM se CROSS JOIN sr")
def table2(spark, d):
    return reports.table2(selected(spark, d), "naive2").withColumn("value", r("value"))


@query(SEL + " SELECT model, metric, round(value, 4) AS value FROM (SELECT model, unnest(['smape', 'mase', 'owa', 'da']) AS metric, unnest([smape, mase, owa, da]) AS value FROM se) WHERE value IS NOT NULL")
def metrics_long(spark, d):
    return reports.metrics_long(selected(spark, d), ["model"], ["smape", "mase", "owa", "da"]).withColumn("value", r("value"))


FREQ = f", ld AS (SELECT input_key, model, correct FROM dsc WHERE h = {H}), fr AS (SELECT s.model, n_regionkey::VARCHAR AS frequency, avg(s.smape) AS smape, avg(s.mase) AS mase, avg(correct) AS da, count(*) AS evaluation_count FROM sc s JOIN ld ON ld.input_key = s.input_key AND ld.model = s.model JOIN nation ON n_nationkey = s.input_key::INT GROUP BY ALL), fa AS (SELECT model, sum(smape * evaluation_count) / sum(evaluation_count) AS smape, sum(mase * evaluation_count) / sum(evaluation_count) AS mase, sum(da * evaluation_count) / sum(evaluation_count) AS da, sum(evaluation_count)::BIGINT AS evaluation_count FROM fr GROUP BY 1)"


@query(FREQ + " SELECT a.model, round(a.smape, 4) AS smape, round(a.mase, 5) AS mase, round(a.da, 5) AS da, a.evaluation_count, round(0.5 * (a.smape / b.smape + a.mase / b.mase), 5) AS owa FROM fa a CROSS JOIN (SELECT * FROM fa WHERE model = 'naive2') b")
def aggregate_all(spark, d):
    """Scores and last-step directions by region, then over all regions."""
    right = scored(spark, d).where(F.col("h") == H).select("input_key", "model", "correct")
    region = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("input_key"), F.col("n_regionkey").cast("string").alias("frequency"))
    rows = series_scores(spark, d).join(right, ["input_key", "model"]).join(region, "input_key").groupBy("model", "frequency").agg(F.avg("smape").alias("smape"), F.avg("mase").alias("mase"), F.avg("correct").alias("da"), F.count(F.lit(1)).alias("evaluation_count"))
    out = reports.aggregate_all(rows, "naive2", table(spark, d, "region").count())
    return out.select("model", r("smape").alias("smape"), r("mase", 5).alias("mase"), r("da", 5).alias("da"), "evaluation_count", r("owa", 5).alias("owa"))


@query("SELECT h, round(max(accuracy) FILTER (WHERE model = 'naive2'), 6) AS naive2, round(max(accuracy) FILTER (WHERE model = 'rw_drift'), 6) AS rw_drift, round(max(accuracy) FILTER (WHERE model = 'ses'), 6) AS ses FROM dbh GROUP BY 1")
def accuracy_matrix(spark, d):
    models = ["naive2", "rw_drift", "ses"]
    return reports.accuracy_matrix(by_horizon(spark, d), models, ["h"]).select("h", *[r(m, 6).alias(m) for m in models])


@query(", rk AS (SELECT model, h, rank() OVER (PARTITION BY h ORDER BY accuracy DESC) + (count(*) OVER (PARTITION BY h, accuracy) - 1) / 2.0::DOUBLE AS rank FROM dbh) SELECT model, round(avg(rank), 6) AS mean_rank, count(*) AS blocks FROM rk GROUP BY 1")
def mean_ranks(spark, d):
    return reports.mean_ranks(by_horizon(spark, d), list(forecast.POOL), ["h"]).withColumn("mean_rank", r("mean_rank", 6))


@query("SELECT DISTINCT h, 'forest' AS model FROM dbh UNION ALL SELECT h, 'ses' FROM dbh WHERE model = 'ses' AND h > 10")
def incomplete_models(spark, d):
    rows = by_horizon(spark, d).where("not (model = 'ses' and h > 10)")
    return reports.incomplete_models(rows, ["naive2", "ses", "forest"], ["h"])


# ---- seasonal panels ----

#: Monthly sales by supplier and hourly events by type; the windows hold three cycles or more, so the seasonal path acts.
PANELS = {
    "M": {"table": "lineitem", "columns": ("l_suppkey", "l_shipdate", "l_extendedprice"), "grain": "month", "bounds": ("1995-01-01", "2001-11-01"), "steps": 83, "window": 72, "horizon": 6, "period": 12},
    "H": {"table": "events", "columns": ("event_type", "ts", "value"), "grain": "hour", "bounds": ("2024-01-01 00:00:00", "2024-01-30 23:00:00"), "steps": 720, "window": 168, "horizon": 48, "period": 24},
}


def panel_long(spark, d, freq):
    p = PANELS[freq]
    return src.fill_calendar(src.build_panel(table(spark, d, p["table"]), *p["columns"], p["grain"]), p["grain"], p["bounds"])


def fill_sql(name, source, value, columns="series_id, t, y"):
    """A table with gaps of ``value`` filled linearly (column v)."""
    return f"""{name}n AS (SELECT *, last_value({value} IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN {value} IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value({value} IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN {value} IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM {source}
 WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS MATERIALIZED (SELECT {columns}, CASE WHEN {value} IS NOT NULL THEN {value} ELSE coalesce(y0 + (y1 - y0) * ((t - t0)::DOUBLE / (t1 - t0)::DOUBLE), y0, y1) END AS v FROM {name}n)"""


def season_sql(name, source, m, middle="avg(away)"):
    """The season of each phase from a filled table (column v)."""
    half = m // 2
    return f"""{name}w AS (SELECT series_id, t, CASE WHEN count(*) OVER w = {2 * half + 1} THEN v - (sum(v) OVER w{f" - (first_value(v) OVER w + last_value(v) OVER w) / 2" if m % 2 == 0 else ""}) / {m} END AS away FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
{name}m AS (SELECT series_id, t % {m} AS phase, {middle} AS mm, count(*) AS n FROM {name}w GROUP BY ALL), {name} AS MATERIALIZED (SELECT series_id, phase, CASE WHEN sum(n) OVER k >= {2 * m} AND count(mm) OVER k = {m} THEN mm - avg(mm) OVER k ELSE 0.0 END AS season FROM {name}m WINDOW k AS (PARTITION BY series_id))"""


def seasonal_clean_sql(freq):
    p = PANELS[freq]
    series_, time_, value_ = p["columns"]
    m = p["period"]
    return f"""WITH facts AS (SELECT {series_}::VARCHAR AS series_id, date_diff('{p["grain"]}', TIMESTAMP '{p["bounds"][0]}', {time_}::TIMESTAMP)::INT AS t, sum({value_}::DECIMAL(18,2))::DOUBLE AS y FROM {p["table"]} GROUP BY ALL),
whole AS MATERIALIZED (SELECT series_id, t, y FROM (SELECT series_id, unnest(range({p["steps"]}))::INT AS t FROM (SELECT DISTINCT series_id FROM facts)) LEFT JOIN facts USING (series_id, t)),
{fill_sql("f1", "whole", "y")}, {season_sql("s1", "f1", m)}, {season_sql("s0", "f1", m, "quantile_cont(away, 0.5)")},
ad AS (SELECT w.series_id, w.t, w.y, w.y - season AS a, season FROM whole w JOIN s1 ON s1.series_id = w.series_id AND phase = w.t % {m}), {fill_sql("st", "ad", "a", "series_id, t, y, season")},
ar AS (SELECT w.series_id, w.t, w.y, w.y - season AS a FROM whole w JOIN s0 ON s0.series_id = w.series_id AND phase = w.t % {m}),
rr AS (SELECT *, a - quantile_cont(a, 0.5) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS resid FROM ar), qq AS (SELECT series_id, quantile_cont(resid, 0.25) AS q0, quantile_cont(resid, 0.75) AS q1 FROM rr GROUP BY 1),
ri AS (SELECT series_id, t, CASE WHEN resid >= q0 - 3 * (q1 - q0) AND resid <= q1 + 3 * (q1 - q0) THEN y END AS y FROM rr JOIN qq USING (series_id)),
{fill_sql("f2", "ri", "y")}, {season_sql("s2", "f2", m)}, ae AS (SELECT w.series_id, w.t, w.y, w.y - season AS a, season FROM ri w JOIN s2 ON s2.series_id = w.series_id AND phase = w.t % {m}), {fill_sql("ro", "ae", "a", "series_id, t, y, season")}
SELECT '{freq}' AS freq, st.series_id, st.t, CASE WHEN st.y IS NOT NULL THEN st.y ELSE st.v + st.season END AS standard, CASE WHEN ro.y IS NOT NULL THEN ro.y ELSE ro.v + ro.season END AS robust FROM st JOIN ro USING (series_id, t)"""


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT * FROM ({seasonal_clean_sql(f)})" for f in PANELS) + ") SELECT freq, series_id, t, round(standard, 5) + 0.0 AS standard, round(robust, 5) + 0.0 AS robust FROM u")
def clean_seasonal(spark, d):
    """Both ways of cleaning on the monthly and the hourly panel, with their periods."""
    parts = []
    for f, p in PANELS.items():
        long = panel_long(spark, d, f).select(F.col("series_id").cast("string").alias("series_id"), "t", "y")
        robust = clean.clean_robust(long, period=p["period"]).select("series_id", "t", F.col("y_clean").alias("robust"))
        both = clean.clean_standard(long, period=p["period"]).join(robust, ["series_id", "t"])
        parts.append(both.select(F.lit(f).alias("freq"), "series_id", "t", (r("y_clean", 5) + 0.0).alias("standard"), (r("robust", 5) + 0.0).alias("robust")))
    return parts[0].unionByName(parts[1])


def panel_windows(spark, d, freq):
    """The official window of each series, with actual, scale and origin."""
    p = PANELS[freq]
    rows = _frame_of(spark, d, freq, panel_long(spark, d, freq), p["steps"] - p["horizon"], p["horizon"])
    rows = rows.withColumns({"input_key": F.col("series_id").cast("string"), "scale": evaluate.naive_scale_of("history", p["period"])})
    return windows.official_window(rows, p["window"]).withColumn("origin", F.element_at("window", -1))


def panel_forecasts(spark, d, freq):
    p = PANELS[freq]
    rows = forecast.forecast_pool(panel_windows(spark, d, freq), p["horizon"], None, p["period"], keep=["actual", "scale", "origin"])
    return rows.withColumn("actual", F.element_at("actual", F.col("h"))).withColumn("freq", F.lit(freq))


def panel_sql(freq, select):
    p = PANELS[freq]
    series_, time_, value_ = p["columns"]
    n, w, hz, m = p["steps"], p["window"], p["horizon"], p["period"]
    half = m // 2
    return f"""WITH RECURSIVE facts AS (SELECT {series_} AS series_id, date_diff('{p["grain"]}', TIMESTAMP '{p["bounds"][0]}', {time_}::TIMESTAMP)::INT AS t, sum({value_}::DECIMAL(18,2))::DOUBLE AS y FROM {p["table"]} GROUP BY ALL),
whole AS MATERIALIZED (SELECT series_id, t, y FROM (SELECT series_id, unnest(range({n}))::INT AS t FROM (SELECT DISTINCT series_id FROM facts)) LEFT JOIN facts USING (series_id, t)),
nb AS (SELECT series_id, t, y, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM whole WHERE t < {n - hz}
 WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cleaned AS MATERIALIZED (SELECT series_id::VARCHAR AS input_key, t, CASE WHEN y IS NOT NULL THEN y ELSE coalesce(y0 + (y1 - y0) * ((t - t0)::DOUBLE / (t1 - t0)::DOUBLE), y0, y1) END AS v FROM nb),
off AS MATERIALIZED (SELECT input_key, t - {n - hz - w} AS i, v FROM cleaned WHERE t >= {n - hz - w}), act AS MATERIALIZED (SELECT series_id::VARCHAR AS input_key, t - {n - hz - 1} AS h, y AS actual FROM whole WHERE t >= {n - hz}), hs AS (SELECT unnest(range(1, {hz + 1}))::INT AS h),
scale AS (SELECT input_key, avg(abs(v - p)) AS scale FROM (SELECT input_key, v, lag(v, {m}) OVER (PARTITION BY input_key ORDER BY t) AS p FROM cleaned) GROUP BY 1),
c0 AS MATERIALIZED (SELECT input_key, i, v - avg(v) OVER (PARTITION BY input_key) AS c FROM off), p0 AS (SELECT input_key, sum(c * c) AS p FROM c0 GROUP BY 1), l0 AS (SELECT a.input_key, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM c0 a JOIN c0 b ON a.input_key = b.input_key AND b.i - a.i BETWEEN 1 AND {m} GROUP BY ALL),
sq AS (SELECT input_key, {w} >= 3 * {m} AND any_value(p) > 0 AND abs(max(s / p) FILTER (WHERE lag = {m})) > 1.645 / sqrt({w}) * sqrt(1 + 2 * sum((s / p) * (s / p)) FILTER (WHERE lag < {m})) AS seasonal FROM l0 JOIN p0 USING (input_key) GROUP BY 1),
ma AS (SELECT a.input_key, a.i, any_value(a.v) / ((sum(b.v) - sum(b.v) FILTER (WHERE abs(b.i - a.i) = {half}) / 2) / {m}) AS ratio FROM off a JOIN off b ON a.input_key = b.input_key AND b.i BETWEEN a.i - {half} AND a.i + {half} WHERE a.i BETWEEN {half} AND {w - half - 1} GROUP BY ALL),
sf AS (SELECT input_key, i % {m} AS s, avg(ratio) AS f FROM ma GROUP BY ALL), sg AS MATERIALIZED (SELECT input_key, s, CASE WHEN coalesce(seasonal, false) AND min(f) OVER (PARTITION BY input_key) > 0 THEN f / avg(f) OVER (PARTITION BY input_key) ELSE 1.0 END AS f FROM sf JOIN sq USING (input_key)),
adj AS MATERIALIZED (SELECT input_key, list(v ORDER BY i) AS w, list(v / f ORDER BY i) AS a, regr_slope(v / f, i) AS slope FROM off JOIN sg USING (input_key) WHERE s = i % {m} GROUP BY 1),
{fit_sql("sesf", "ses", "adj", "a")},
{fit_sql("holtf", "holt", "adj", "a")},
{fit_sql("dampedf", "damped", "adj", "a")},
wide AS (SELECT adj.*, h, sg.f AS back, sesf.f.l AS l, holtf.f AS ho, dampedf.f AS da FROM adj JOIN sesf USING (input_key) JOIN holtf USING (input_key) JOIN dampedf USING (input_key) CROSS JOIN hs JOIN sg ON sg.input_key = adj.input_key AND sg.s = ({w} + h - 1) % {m}),
fc AS MATERIALIZED (SELECT input_key, h, w[{w}] AS origin, unnest({list(forecast.POOL)}) AS model, unnest([w[{w}], w[{w - m} + ((h - 1) % {m}) + 1], w[{w}] + h * (w[{w}] - w[1]) / {w - 1}, a[{w}] * back, l * back, (ho.l + h * ho.b) * back, (da.l + da.phi * (1 - pow(da.phi, h)) / (1 - da.phi) * da.b) * back, (l + 0.5 * slope * h) * back]) AS mean FROM wide),
err AS (SELECT fc.*, actual, scale, CASE WHEN abs(actual) + abs(mean) > 0 THEN 200 * abs(actual - mean) / (abs(actual) + abs(mean)) END AS term FROM fc JOIN act USING (input_key, h) JOIN scale USING (input_key)),
sc AS MATERIALIZED (SELECT input_key, model, avg(term) AS smape, avg(abs(actual - mean)) / any_value(scale) AS mase, max(((mean > origin) = (actual > origin))::INT) FILTER (WHERE h = {hz}) AS correct FROM err GROUP BY ALL),
ow AS (SELECT model, avg(smape) AS smape, avg(mase) AS mase, avg(correct) AS da, count(*) AS n FROM sc GROUP BY 1)
{select}"""


def of_panels(select):
    return "WITH u AS (" + " UNION ALL ".join(f"SELECT * FROM ({panel_sql(f, select.format(freq=f))})" for f in PANELS) + ") "


@query(of_panels("SELECT '{freq}' AS freq, input_key, model, h, mean FROM fc") + "SELECT freq, input_key, model, h, round(mean, 2) AS mean FROM u")
def seasonal_paths(spark, d):
    """All models on the monthly and the hourly panel, with seasonal adjustment where the test asks for it."""
    parts = [panel_forecasts(spark, d, f).select("freq", "input_key", "model", "h", r("mean", 2).alias("mean")) for f in PANELS]
    return parts[0].unionByName(parts[1])


def winters_sql(freq):
    """Additive seasonal smoothing of a panel's official windows: grid, then the rounds of the search; struct f with the last state."""
    p = PANELS[freq]
    n, m = p["window"], p["period"]
    first = f"list_avg(w[1:{m}])"
    rise = f"((list_avg(w[{m + 1}:{2 * m}]) - {first}) / {m})"
    start = f"{{'sse': 0.0::DOUBLE, 'l': {first} + {rise} * {(m - 1) / 2}, 'b': {rise}, 's': list_transform(range({m}), lambda q: w[q + 1] - {first} - {rise} * (q - {(m - 1) / 2}))}}"
    miss = "(q.l - (p.l + p.b + p.s[1]))"
    step = f"{{'sse': p.sse + {miss} * {miss}, 'l': p.l + p.b + alpha * {miss}, 'b': p.b + alpha * beta * {miss}, 's': list_append(p.s[2:], p.s[1] + gamma * (1 - alpha) * {miss})}}"
    state = f"list_reduce(list_prepend({start}, list_transform(w[{m + 1}:], lambda v: {{'sse': 0.0::DOUBLE, 'l': v, 'b': 0.0::DOUBLE, 's': NULL::DOUBLE[]}})), lambda p, q: {step})"
    best = f"SELECT input_key, arg_min({{'sse': z.sse, 'l': z.l, 'b': z.b, 's': z.s, 'alpha': alpha, 'beta': beta, 'gamma': gamma}}, (z.sse, k)) AS f FROM (SELECT input_key, k, alpha, beta, gamma, {state} AS z FROM (SELECT input_key, w FROM adj) CROSS JOIN g) GROUP BY input_key"
    values = lambda rows: "(VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in enumerate(rows)) + ")"
    out, size = [f"hw0 AS MATERIALIZED (WITH g AS (SELECT * FROM {values(winters.GRID)} g(k, alpha, beta, gamma)) {best})"], winters.STEPS
    for turn in range(1, search.ROUNDS + 1):
        moved = [f"least(greatest(f.{c} + {o} * {s}::DOUBLE, {lo}::DOUBLE), {hi}::DOUBLE) AS {c}" for c, o, s, lo, hi in zip(("alpha", "beta", "gamma"), "abc", size, winters.LOW, winters.HIGH, strict=True)]
        near = f"SELECT input_key, k, {', '.join(moved)} FROM hw{turn - 1} CROSS JOIN {values(search.offsets(size))} o(k, a, b, c)"
        out.append(f"hw{turn} AS MATERIALIZED (WITH g AS ({near}) {best.replace('CROSS JOIN g', 'JOIN g USING (input_key)')})")
        size = tuple(s / 2 for s in size)
    moved = f"(f.alpha + f.alpha * f.beta * j + CASE WHEN j % {m} = 0 THEN f.gamma * (1 - f.alpha) ELSE 0 END)"
    spread = f"SELECT input_key, h, f, coalesce(sum({moved} * {moved}), 0) AS v FROM hw{search.ROUNDS} CROSS JOIN hs LEFT JOIN (SELECT unnest(range(1, {p['horizon']})) AS j) ON j < h GROUP BY ALL"
    return panel_sql(freq, f"SELECT '{freq}' AS freq, input_key, h, f.l + h * f.b + f.s[((h - 1) % {m}) + 1] AS mean, sqrt(f.sse / {n - m} * (1 + v)) AS se FROM ({spread})").replace("\nwide AS", "\n" + ",\n".join(out) + ",\nwide AS")


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT * FROM ({winters_sql(f)})" for f in PANELS) + ") SELECT freq, input_key, 'winters' AS model, h, round(mean, 2) AS mean, round(se, 2) AS se FROM u")
def fc_winters(spark, d):
    """Additive seasonal smoothing of the monthly and the hourly windows."""
    parts = [winters.fc_winters(panel_windows(spark, d, f), p["horizon"], p["period"]).select(F.lit(f).alias("freq"), "input_key", "model", "h", r("mean", 2).alias("mean"), r("se", 2).alias("se")) for f, p in PANELS.items()]
    return parts[0].unionByName(parts[1])


@query()
def fc_chosen(spark, d):
    """The method that an information criterion chooses for each window of the three panels."""
    parts = [winters.fc_chosen(panel_windows(spark, d, f), p["horizon"], p["period"]).withColumn("freq", F.lit(f)) for f, p in PANELS.items()]
    parts.append(winters.fc_chosen(official(spark, d), H).withColumn("freq", F.lit("D")))
    return reduce(lambda a, b: a.unionByName(b), parts).select("freq", "input_key", "model", "h", r("mean", 2).alias("mean"), r("se", 2).alias("se"))


def panel_scores(spark, d, freq):
    """(input_key, model, smape, mase, correct): with the direction of the last step."""
    right = ((F.col("mean") > F.col("origin")) == (F.col("actual") > F.col("origin"))).cast("int")
    return evaluate.series_scores(panel_forecasts(spark, d, freq), correct=F.max(F.when(F.col("h") == PANELS[freq]["horizon"], right)))


@query(of_panels("SELECT '{freq}' AS freq, a.model, a.smape, a.mase, 0.5 * (a.smape / b.smape + a.mase / b.mase) AS owa FROM ow a CROSS JOIN (SELECT * FROM ow WHERE model = 'naive2') b") + "SELECT freq, model, round(smape, 4) AS smape, round(mase, 5) AS mase, round(owa, 5) AS owa FROM u")
def frequency_scores(spark, d):
    parts = [evaluate.metric_owa(panel_scores(spark, d, f)).select(F.lit(f).alias("freq"), "model", r("smape").alias("smape"), r("mase", 5).alias("mase"), r("owa", 5).alias("owa")) for f in PANELS]
    return parts[0].unionByName(parts[1])


@query(of_panels("SELECT '{freq}' AS freq, model, smape, mase, da, n FROM ow") + ", t AS (SELECT model, sum(smape * n) / sum(n) AS smape, sum(mase * n) / sum(n) AS mase, sum(da * n) / sum(n) AS da, sum(n)::BIGINT AS evaluation_count FROM u GROUP BY 1) SELECT a.model, round(a.smape, 4) AS smape, round(a.mase, 5) AS mase, round(a.da, 5) AS da, a.evaluation_count, round(0.5 * (a.smape / b.smape + a.mase / b.mase), 5) AS owa, NULL::VARCHAR AS violation FROM t a CROSS JOIN (SELECT * FROM t WHERE model = 'naive2') b")
def frequency_totals(spark, d):
    """Both panels in one table, weighted by their numbers of series."""
    each = [panel_scores(spark, d, f).groupBy("model").agg(F.avg("smape").alias("smape"), F.avg("mase").alias("mase"), F.avg("correct").alias("da"), F.count(F.lit(1)).alias("evaluation_count")).withColumn("frequency", F.lit(f)) for f in PANELS]
    out = reports.aggregate_all(each[0].unionByName(each[1]), "naive2", 2)
    return out.select("model", r("smape").alias("smape"), r("mase", 5).alias("mase"), r("da", 5).alias("da"), "evaluation_count", r("owa", 5).alias("owa"), "violation")


# ---- restart ----


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')")
def pending_keys(spark, d):
    done = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.pending_keys(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def missing_keys(spark, d):
    return store.missing_keys(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("WITH a AS (SELECT c_custkey FROM customer WHERE c_nationkey < 20), b AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_custkey, 'left' AS side FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT c_custkey, 'right' FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)")
def identity_match(spark, d):
    """Customers of some nations against those with a large order: either side has keys of its own."""
    other = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return store.identity_match(table(spark, d, "customer").where("c_nationkey < 20"), other, "c_custkey")


@query("SELECT o_orderpriority AS stage, count(*) AS planned, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def stage_counts(spark, d):
    plan = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("input_key"), "o_orderstatus")
    return store.stage_counts(plan.drop("o_orderstatus"), plan.where("o_orderstatus = 'F'"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def merge_results(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return store.merge_results(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3"), keys=["l_orderkey", "l_linenumber"])[1]
