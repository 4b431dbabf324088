"""Directional models: time-warping and Euclidean nearest neighbours, resizing, and forests by horizon.

Neighbour joins (a stated query set against all references) are exact and partitioned: references belong to the cell of their nearest pivot, a cell knows the
range of its values and its ring around the pivot, and a query goes only to the cells whose bound is no farther than the best distance in its first one. Within a cell queries and
references are dealt into blocks of bounded size, and a pair of blocks keeps the best neighbour of each of its queries; a grouped minimum picks the best of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.files import written

BLOCK, CELLS = 2048, 256
DTW_STEP = 64  # references that are warped at once, nearest bounds first
AT_ONCE = 14  # fits of horizons side by side
FIT_ROWS = 20_000  # rows in a partition of a fit


def dtw_width(n: Column, m: Column, proportion: float = 0.10) -> Column:
    """max(1, half-even round of the share of the longer one), and no more than n - 1 and m - 1, 1 at least."""
    w = F.greatest(F.lit(1), F.bround(F.lit(proportion).cast("double") * F.greatest(n, m), 0).cast("int"))
    return F.greatest(F.lit(1), F.least(w, n - 1, m - 1))


def banded_dtw(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Distances of row pairs (equal shapes a side): |x - y| costs, diagonal steps count twice, ends tied, a band of ``width``."""
    n, m = a.shape[1], b.shape[1]
    inf = np.full(len(a), np.inf)
    before = [inf] * (m + 1)
    for i in range(n):
        now = [inf] * (m + 1)
        for j in range(max(0, i - width), min(m, i + width + 1)):
            cost = np.abs(a[:, i] - b[:, j])
            if i == 0 and j == 0:
                now[1] = cost
                continue
            now[j + 1] = np.minimum(np.minimum(before[j + 1], now[j]) + cost, before[j] + 2 * cost)
        before = now
    return before[m]


def _width(n: int, m: int, proportion: float) -> int:
    return max(1, min(max(1, round(proportion * max(n, m))), n - 1, m - 1))


def pair_distances(a: list, b: list, proportion: float) -> np.ndarray:
    """Banded distances of many pairs, in groups of equal lengths; unusable pairs are infinitely far."""
    out = np.full(len(a), np.inf)
    shapes: dict[tuple[int, int], list[int]] = {}
    rows = [(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)]
    for k, (x, y) in enumerate(rows):
        if len(x) > 1 and len(y) > 1 and np.isfinite(x).all() and np.isfinite(y).all():
            shapes.setdefault((len(x), len(y)), []).append(k)
    for (n, m), at in shapes.items():
        out[at] = banded_dtw(np.stack([rows[k][0] for k in at]), np.stack([rows[k][1] for k in at]), _width(n, m, proportion))
    return out


def dtw_distance(pairs: DataFrame, proportion: float = 0.10, a_col: str = "a", b_col: str = "b") -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf.assign(distance=pair_distances(list(pdf[a_col]), list(pdf[b_col]), proportion))

    return pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, T.StructField("distance", T.DoubleType())]))


def warping_bound(x: np.ndarray, refs: np.ndarray, width: int) -> np.ndarray:
    """A lower bound of the banded distance of x to each row of refs.

    A path enters each position of either side at least once, and a diagonal step counts for both: so the distances of each value
    from the range of what it may be paired with add up, those of the first values but once.
    """
    def outside(a, b):
        n, m = a.shape[-1], b.shape[-1]
        out = np.empty(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]) + (n,))
        for i in range(n):
            part = b[..., max(0, i - width) : min(m, i + width + 1)]
            out[..., i] = np.maximum(np.maximum(a[..., i] - part.max(-1), part.min(-1) - a[..., i]), 0) if part.shape[-1] else 0
        return out

    p, q = outside(x[None, :], refs), outside(refs, x[None, :])
    return p[:, 1:].sum(1) + q[:, 1:].sum(1) + np.maximum(p[:, 0], q[:, 0])


def nearest_by_warping(queries: list, refs: list, order: np.ndarray, proportion: float) -> list[tuple[float, int] | None]:
    """(distance, place in refs) of each query's nearest reference, of equal ones the first by ``order``. Bounds spare most warping."""
    arrays = [np.asarray(r, float) for r in refs]
    lengths: dict[int, list[int]] = {}
    for k, r in enumerate(arrays):
        if len(r) > 1 and np.isfinite(r).all():
            lengths.setdefault(len(r), []).append(k)
    stacks = {m: (np.array(at), np.stack([arrays[k] for k in at])) for m, at in lengths.items()}
    out: list[tuple[float, int] | None] = []
    for q in queries:
        x, best = np.asarray(q, float), None
        if len(x) > 1 and np.isfinite(x).all():
            for m, (at, rows) in stacks.items():
                width = _width(len(x), m, proportion)
                bound = warping_bound(x, rows, width)
                by = np.argsort(bound, kind="stable")
                for k in range(0, len(by), DTW_STEP):
                    part = by[k : k + DTW_STEP]
                    if best is not None and bound[part[0]] > best[0] + 1e-9:
                        break
                    d = banded_dtw(np.repeat(x[None, :], len(part), 0), rows[part], width)
                    for i in np.flatnonzero(d == d.min()) if np.isfinite(d.min()) else ():
                        found = (float(d[i]), int(order[at[part[i]]]), int(at[part[i]]))
                        best = found if best is None else min(best, found)
        out.append(None if best is None else (best[0], best[2]))
    return out


def nearest_by_distance(queries: list, refs: list, order: np.ndarray, own: list | None = None) -> list[tuple[float, int] | None]:
    """The same by Euclidean distance: one matrix product finds what may be nearest, exact distances decide. own: for each query a reference to skip."""
    arrays = [np.asarray(r, float) for r in refs]
    out: list[tuple[float, int] | None] = [None] * len(queries)
    rows = [np.asarray(q, float) for q in queries]
    for m in {len(x) for x in rows}:
        q, at = [k for k, x in enumerate(rows) if len(x) == m], np.array([k for k, r in enumerate(arrays) if len(r) == m and np.isfinite(r).all()], int)
        if not m or not len(at):
            continue
        y = np.stack([arrays[k] for k in at])
        sizes = (y * y).sum(1)
        for begin in range(0, len(q), 256):
            part = q[begin : begin + 256]
            x = np.stack([rows[k] for k in part])
            rough = (x * x).sum(1)[:, None] + sizes[None, :] - 2 * x @ y.T
            for i, k in enumerate(part):
                skip = np.isin(at, list(own[k]) if own is not None else [])
                if skip.all() or not np.isfinite(x[i]).all():
                    continue
                near = np.where(skip, np.inf, rough[i])
                may = np.flatnonzero(near <= near.min() + 1e-9 * (sizes.max() + (x[i] * x[i]).sum() + 1))
                d = np.sqrt(((y[may] - x[i]) ** 2).sum(1))
                out[k] = min((float(a), int(order[at[j]]), int(at[j])) for a, j in zip(d, may, strict=True))[::2]
    return out


class Cells:
    """What is known of the cells of references: of each its length, pivot, least and greatest distances from it, and the range of its values at each place. At most ``CELLS``."""

    def __init__(self, pivots: list[np.ndarray]):
        self.pivots = pivots
        self.lengths = np.array([len(p) for p in pivots], int)
        self.low = [np.full(len(p), np.inf) for p in pivots]
        self.high = [np.full(len(p), -np.inf) for p in pivots]
        self.near, self.far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    @classmethod
    def of(cls, refs: DataFrame, most: int, block: int) -> Cells:
        """Pivots are some ``most`` references, fewer for few references, first by a hash of their key (the bound of what the driver holds, with ``most`` ranges); all references then count for the ranges."""
        usable = refs.where(_usable("v"))
        n = usable.count()
        picked = usable.select("v", F.xxhash64("ref_key").alias("h"), "ref_order").orderBy("h", "ref_order").limit(max(1, min(most, n // max(1, block // 8)))).collect()
        cells = cls([np.asarray(r["v"], float) for r in picked] if n else [])
        spare = usable.select(F.size("v").alias("n")).distinct().orderBy("n").collect()  # a length without a pivot gets an empty one; lengths are few
        cells = cls([*cells.pivots, *(np.zeros(r["n"]) for r in spare if r["n"] not in cells.lengths)])

        def ranges(batches):
            own = cls(cells.pivots)
            for pdf in batches:
                own.add(list(pdf["v"]))
            rows = [(c, k, a, b, own.near[c], own.far[c]) for c in np.flatnonzero(own.far >= 0) for k, (a, b) in enumerate(zip(own.low[c], own.high[c], strict=True))]
            yield pd.DataFrame(rows, columns=["cell", "k", "low", "high", "near", "far"])

        part = usable.select("v").mapInPandas(ranges, "cell int, k int, low double, high double, near double, far double")
        for r in part.groupBy("cell", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("near").alias("near"), F.max("far").alias("far")).collect():
            cells.low[r["cell"]][r["k"]], cells.high[r["cell"]][r["k"]] = r["low"], r["high"]
            cells.near[r["cell"]], cells.far[r["cell"]] = r["near"], r["far"]
        return cells

    def place(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot) of arrays: the nearest pivot of their length; -1 without one."""
        cell, distance = np.full(len(rows), -1), np.full(len(rows), np.inf)
        lengths = np.array([len(r) for r in rows], int)
        for n in np.unique(lengths):
            at, own = np.flatnonzero(lengths == n), np.flatnonzero(self.lengths == n)
            if n and len(own):
                x, p = np.stack([np.asarray(rows[k], float) for k in at]), np.stack([self.pivots[k] for k in own])
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))
                cell[at], distance[at] = own[d.argmin(1)], d.min(1)
        return cell, distance

    def add(self, rows: list) -> None:
        cell, distance = self.place(rows)
        for c in np.unique(cell[cell >= 0]):
            x = np.stack([np.asarray(rows[k], float) for k in np.flatnonzero(cell == c)])
            self.low[c], self.high[c] = np.minimum(self.low[c], x.min(0)), np.maximum(self.high[c], x.max(0))
            self.near[c], self.far[c] = min(self.near[c], distance[cell == c].min()), max(self.far[c], distance[cell == c].max())

    def by_distance(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of the Euclidean distances from x to the references of each cell: from its box, and from its ring around the pivot."""
        out = np.full(len(self.pivots), np.inf)
        for c in np.flatnonzero((self.lengths == len(x)) & (self.far >= 0)):
            box = np.maximum(np.maximum(self.low[c] - x, x - self.high[c]), 0)
            d = np.sqrt(((x - self.pivots[c]) ** 2).sum())
            out[c] = max(np.sqrt((box * box).sum()), d - self.far[c], self.near[c] - d) - 1e-6 * (1 + d)
        return out

    def by_warping(self, x: np.ndarray, proportion: float) -> np.ndarray:
        """The same for banded warping: each value of either side lies outside the range of what it may be paired with."""
        out = np.full(len(self.pivots), np.inf)
        for c in np.flatnonzero(self.far >= 0):
            n, m = len(x), int(self.lengths[c])
            if n < 2 or m < 2:
                continue
            width = _width(n, m, proportion)
            low = lambda a, k, top: a[max(0, k - width) : min(top, k + width + 1)]
            p = [max(low(self.low[c], k, m).min() - x[k], x[k] - low(self.high[c], k, m).max(), 0.0) if len(low(self.low[c], k, m)) else 0.0 for k in range(n)]
            q = [max(self.low[c][k] - low(x, k, n).max(), low(x, k, n).min() - self.high[c][k], 0.0) if len(low(x, k, n)) else 0.0 for k in range(m)]
            total = sum(p[1:]) + sum(q[1:]) + max(p[0], q[0])
            out[c] = total - 1e-9 * (1 + total)
        return out


def _usable(v: str) -> Column:
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _visits(queries: DataFrame, cells: Cells, bounds, home: bool) -> DataFrame:
    """(cell, input_key, v): the queries at the cell with the least bound, or at all other cells that may hold a reference no farther than ``best``.

    Python gives, and the shared folder holds, one row a query with the numbers of its cells; vectors without structure visit all of them.
    """
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def visited(v: pd.Series, best: pd.Series) -> pd.Series:
        out = []
        for x, d in zip(v, best.astype(float).fillna(np.inf), strict=True):
            bound = bounds(sent.value, np.asarray(x, float))
            if not len(bound) or not np.isfinite(bound).any():
                out.append([])
                continue
            first = int(bound.argmin())
            out.append([first] if home else [c for c in np.flatnonzero(bound <= d).tolist() if c != first and np.isfinite(bound[c])])
        return pd.Series(out, dtype=object)

    rows = written(queries.select("input_key", "v", visited("v", F.col("best").cast("double")).alias("cells")), "visits")
    return rows.select(F.explode("cells").alias("cell"), "input_key", "v")


def _tiles(queries: DataFrame, refs: DataFrame, best, block: int) -> DataFrame:
    """(input_key, distance, ref_order, ref_key): the best reference of each query in each tile, a pair of blocks of at most about ``block`` rows of one cell."""
    size = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = F.broadcast(size(queries, "nq").join(size(refs, "nr"), "cell"))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("input_key"), F.col("nq")).cast("int").alias("x"), every("nr").alias("y"), F.col("input_key").alias("key"), F.lit(None).cast("long").alias("ref_order"), "v")
    right = refs.join(sizes, "cell").select("cell", every("nq").alias("x"), F.pmod(F.col("ref_order"), F.col("nr")).cast("int").alias("y"), F.col("ref_key").alias("key"), F.col("ref_order").cast("long"), "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["ref_order"].notna()
        q, r = pdf[~side], pdf[side]
        keys, order = r["key"].tolist(), r["ref_order"].to_numpy(np.int64)
        found = best(q, r, order)
        rows = [(k, *((f[0], int(order[f[1]]), keys[f[1]]) if f is not None else (None, None, None))) for k, f in zip(q["key"], found, strict=True)]
        return pd.DataFrame(rows, columns=["input_key", "distance", "ref_order", "ref_key"]).astype({"distance": "Float64", "ref_order": "Int64"})

    return left.unionByName(right).groupBy("cell", "x", "y").applyInPandas(compare, "input_key string, distance double, ref_order long, ref_key string")


def _nearest(queries: DataFrame, refs: DataFrame, best, bounds, block: int, most: int) -> DataFrame:
    """(input_key, ref_key, ref_order, distance), exact; ties go to the first in ref_order.

    Each query is compared within the cell that may hold the nearest reference, and then, with the distance found there, within the other cells that may hold one as near.
    """
    queries = written(queries.select(F.col("input_key").cast("string").alias("input_key"), F.col("v").cast("array<double>").alias("v")), "queries")
    refs = written(refs.select("ref_key", "ref_order", F.col("v").cast("array<double>").alias("v")), "references")
    cells = Cells.of(refs, most, block)
    sent = refs.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(sent.value.place(list(v))[0])

    placed = written(refs.where(_usable("v")).withColumn("cell", cell_of("v")).where("cell >= 0"), "placed")
    able = queries.where(_usable("v"))
    least = lambda found: found.groupBy("input_key").agg(F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "ref_order", "ref_key"))).alias("b"))
    home = _visits(able.withColumn("best", F.lit(None).cast("double")), cells, bounds, True)
    first = written(least(_tiles(home, placed, best, block)), "first")
    known = able.join(first.select("input_key", F.col("b.distance").alias("best")), "input_key", "left")
    rest = _tiles(_visits(known, cells, bounds, False), placed, best, block)
    both = least(rest.unionByName(first.select("input_key", "b.distance", "b.ref_order", "b.ref_key")))
    out = queries.select("input_key").distinct().join(both, "input_key", "left")
    return out.select("input_key", F.col("b.ref_key").alias("ref_key"), F.col("b.ref_order").alias("ref_order"), F.col("b.distance").alias("distance"))


def dtw_1nn(queries: DataFrame, refs: DataFrame, proportion: float = 0.10, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """The nearest reference of each query by banded time warping, null without a usable one. queries: input_key, v; refs: ref_key, ref_order, v."""
    return _nearest(queries, refs, lambda q, r, order: nearest_by_warping(list(q["v"]), list(r["v"]), order, proportion), lambda known, x: known.by_warping(x, proportion), block, cells)


def knn_join_l2(queries: DataFrame, refs: DataFrame, block: int = BLOCK, skip_own: bool = False, cells: int = CELLS) -> DataFrame:
    """The same by Euclidean distance; ``skip_own``: a reference with a query's key is not its neighbour."""
    def best(q, r, order):
        own = None
        if skip_own:
            at: dict[str, set[int]] = {}
            for k, key in enumerate(r["key"]):
                at.setdefault(key, set()).add(k)
            own = [at.get(key, set()) for key in q["key"]]
        return nearest_by_distance(list(q["v"]), list(r["v"]), order, own)

    return _nearest(queries, refs, best, lambda known, x: known.by_distance(x), block, cells)


def linear_resize(windows: DataFrame, n: int, array_col: str = "window", name: str = "resized") -> DataFrame:
    """Linear interpolation to n values with half-sample centres."""
    size = F.size(array_col)
    at = lambda i: F.greatest((i + F.lit(0.5)) * size / n - F.lit(0.5), F.lit(0.0))

    def value(i):
        lo = F.least(F.floor(at(i)).cast("int"), size - 1)
        hi = F.least(lo + 1, size - 1)
        part = at(i) - lo
        return F.element_at(array_col, lo + 1) * (1 - part) + F.element_at(array_col, hi + 1) * part

    return windows.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))


def training_matrix(vectors: DataFrame, labels: DataFrame, cohort: DataFrame, h: int) -> DataFrame:
    """(input_key, ref_order, features, label) of the cohort for one horizon; rows without a label stay out."""
    rows = cohort.select("input_key", "ref_order").join(vectors.select("input_key", F.col("v").alias("features")), "input_key").join(labels.select("input_key", F.col("labels")[h - 1].alias("label")), "input_key")
    return rows.where("label is not null")


def training_rows(labels: DataFrame, cohort: DataFrame, horizons: int) -> DataFrame:
    """(h, n_rows): the labelled rows of a cohort for each horizon."""
    steps = labels.join(cohort.select("input_key"), "input_key").select(F.posexplode(F.slice("labels", 1, horizons)).alias("h", "label"))
    return steps.where("label is not null").groupBy((F.col("h") + 1).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"))


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in ranges of ``order``, about ``FIT_ROWS`` a partition, however they came: every task of a fit makes and sends the histograms of all open nodes, so many small partitions multiply a fit's work."""
    parts = -(-rows.count() // FIT_ROWS)
    return (rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*order)


def rf_fit_horizons(vectors: DataFrame, labels: DataFrame, cohort: DataFrame, horizons: int, trees: int = 200, depth: int = 30, seed: int = 42) -> dict:
    """One independent forest a horizon, fitted side by side; a horizon with one class only is that class. ref_order decides the forests, not how the rows are dealt out."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    class Forest(RandomForestClassificationModel):
        trees = property(lambda self: RandomForestClassificationModel.trees.func(self))  # as a cached property every look at the parameters would wrap each tree of the forest, in seconds

    class ForestClassifier(RandomForestClassifier):
        def _create_model(self, java_model):
            return Forest(java_model)

    rows = cohort.select("input_key", "ref_order").join(vectors.select("input_key", F.col("v").cast("array<double>").alias("v")), "input_key").join(labels.select("input_key", "labels"), "input_key")
    rows = _dealt(written(rows.select("ref_order", "input_key", "v", "labels"), "training"), "ref_order", "input_key").select(array_to_vector("v").alias("features"), "labels").persist()  # read by every fit
    label = lambda h: F.get("labels", F.lit(h - 1)).cast("double")
    ends = rows.agg(*[f(label(h)).alias(f"{f.__name__}{h}") for h in range(1, horizons + 1) for f in (F.min, F.max)]).first()

    def fit(h):
        least, most = ends[f"min{h}"], ends[f"max{h}"]
        if least is None or least == most:
            return None if least is None else int(least)
        return ForestClassifier(numTrees=trees, maxDepth=depth, impurity="gini", featureSubsetStrategy="sqrt", seed=seed, minInstancesPerNode=1).fit(rows.select("features", label(h).alias("label")).where("label is not null"))

    with ThreadPool(AT_ONCE) as pool:
        fitted = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(1, horizons + 1), 1)
    rows.unpersist()
    return {h: m for h, m in enumerate(fitted, 1) if m is not None}


def rf_predict_horizons(vectors: DataFrame, models: dict, model: str = "forest") -> DataFrame:
    """(input_key, model, h, label): the forests of all horizons in one pass, so that a task gets each of them once."""
    from pyspark.ml.functions import array_to_vector

    rows = _dealt(vectors.select("input_key", F.col("v").cast("array<double>").alias("v")), "input_key").select("input_key", array_to_vector("v").alias("features"))
    steps = []
    for h, fitted in sorted(models.items()):
        constant = isinstance(fitted, int)
        rows = (rows if constant else fitted.transform(rows)).withColumn(f"label_{h}", F.lit(fitted) if constant else F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction")
        steps.append(F.struct(F.lit(h).alias("h"), F.col(f"label_{h}").alias("label")))
    if not steps:
        return rows.select("input_key", F.lit(model).alias("model"), F.lit(0).alias("h"), F.lit(0).alias("label")).limit(0)
    return rows.select("input_key", F.explode(F.array(*steps)).alias("s")).select("input_key", F.lit(model).alias("model"), "s.h", "s.label")
