"""Centroid clustering (operator 13): Lloyd's rounds in whole numbers, with bounds loosened by the geometry of the drift.

Vectors become integers, ``floor(scale * x)`` for each component. A pass over the stored vectors gives each one its nearest centroid; each vector keeps a lower bound
of its distance to all other centroids. When centroids move, the bound of a vector need not fall by the largest drift: all vectors of a
cluster lie in a sphere around its old centroid, and in the plane of that sphere's middle and a moving centroid's old and new place the loss in distance
is largest along the asymptote of a hyperbola with those places as foci, ``drift * cos(angle)`` of the sphere's nearest direction (``loosening``). A vector
whose own distance, computed exactly, stays below the bound keeps its centroid; all others are scanned exactly. Bounds have a margin far above rounding, and equal distances
are always scanned, so the result equals that of full scans: integers throughout, ties to the smaller number.

Only sums of the vectors that changed their centroid are added up, by task and then by cluster and component; no cluster is ever gathered. The driver gets
k x dimensions sums, k radii and no vectors. Each pass writes its states to the shared folder.

Vectors that are null, of another length, or hold null or non-finite components are left out. Null ids hash last, in the order of their vectors, so they start a centroid only if others are
too few; repeated rows are vectors each, and if copies start centroids the later ones stay empty. With fewer than k vectors there are as many centroids as vectors; an empty
table gives an empty result. Components beyond 2 ** 27 after scaling are refused with an error, as squared distances would not fit a long. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

K, ROUNDS, SCALE, WIDTH = 16, 3, 64, 64
#: Components up to this make all sums of a distance exact in doubles; beyond ``MOST`` a squared distance doesn't fit a long.
EXACT, MOST = 1 << 22, 1 << 27
#: Relative margin of the bounds.
MARGIN = 1e-9


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v): kept vectors as arrays of longs."""
    v = F.col(vec_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("x")).where((F.size("x") == width) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    limit = F.raise_error(F.lit(f"a component is beyond {MOST} after scaling"))
    return kept.select("id", F.transform("x", lambda c: F.when(F.abs(c * scale) <= MOST, F.floor(c * scale)).otherwise(limit.cast("long"))).alias("v"))


def first_centroids(whole: DataFrame, k: int = K) -> np.ndarray:
    """The vectors with the smallest sha256 of ``1:<id>``."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = whole.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of v x rows of c)."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        v, c = v.astype(np.float64), c.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer each centroid j can have come to a vector of the sphere around the old centroid i: at most ``out[i, j]``.

    |x - old| - |x - new| = 2a on a hyperbola around the two places, which lies inside its asymptotes: x is within the angle arccos(2a / drift)
    of the drift's direction, seen from their middle. A sphere's smallest angle is its middle's less arcsin(radius / distance).
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    half = (old + new) / 2
    away = old[:, None, :] - half[None, :, :]
    distance = np.sqrt((away**2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((away * move[None]).sum(2) / (distance * drift), -1, 1)) - np.arcsin(np.clip(radius[:, None] / distance, 0, 1))
        out = drift * np.cos(np.clip(angle, 0, np.pi / 2))
    out = np.where(distance > radius[:, None], out, drift)  # the middle of the two places lies in the sphere
    return np.where(drift > 0, np.nan_to_num(out, nan=0.0) * (1 + MARGIN), 0.0)


STATE = "id {kind}, v array<bigint>, cluster int, before int, distance long, bound double, scanned boolean"


def _assigned(rows: DataFrame, old: np.ndarray | None, new: np.ndarray, radius: np.ndarray | None) -> DataFrame:
    """``rows`` with the nearest of the centroids ``new``; ``old`` and ``radius``: those of the pass before, null in the first."""
    kind = rows.schema["id"].dataType.simpleString()
    slack = None
    if old is not None:
        loose = loosening(old, new, radius)
        np.fill_diagonal(loose, 0.0)
        slack = loose.max(1)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            near, bound, own = np.full(n, -1, np.int32), np.full(n, -np.inf), np.zeros(n, np.int64)
            scan = np.ones(n, bool)
            if slack is not None:
                near = batch.column(2).to_numpy().astype(np.int32)
                bound = batch.column(3).to_numpy() - slack[near]
                own = ((v - new[near]) ** 2).sum(1)
                scan = np.sqrt(own.astype(np.float64)) * (1 + MARGIN) >= bound * (1 - MARGIN)
            before = near.copy()
            at = np.flatnonzero(scan)
            for some in np.array_split(at, max(1, len(at) // 16384)):
                if len(some):
                    far = squares(v[some], new)
                    near[some] = far.argmin(1)
                    own[some] = far[np.arange(len(some)), near[some]]
                    far[np.arange(len(some)), near[some]] = np.iinfo(np.int64).max
                    bound[some] = np.sqrt(far.min(1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(before), pa.array(own), pa.array(bound), pa.array(scan)], ["id", "v", "cluster", "before", "distance", "bound", "scanned"])

    columns = ["id", "v"] if slack is None else ["id", "v", "cluster", "bound"]
    return rows.select(*columns).mapInArrow(run, STATE.format(kind=kind))


def _change(states: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed add to the sums and counts of the clusters; exact, by component."""

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for name, sign in ((1, 1), (2, -1)):
                c = batch.column(name).to_numpy()
                for j in np.unique(c[c >= 0]):
                    sums[j] += sign * v[c == j].sum(0)
                    counts[j] += sign * (c == j).sum()
        table = np.c_[sums, counts]
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table.ravel()[at])], ["at", "s"])

    moved = states.where("cluster <> before").select("v", "cluster", "before").mapInArrow(run, "at long, s long")
    table = [0] * (k * (width + 1))
    for r in moved.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        table[r["at"]] = int(r["s"])
    table = np.array(table, object).reshape(k, width + 1)
    return table[:, :-1], table[:, -1]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned): the nearest centroid of each vector after ``rounds`` rounds.

    ``distance`` is squared; ``scanned`` tells whether the last pass compared the vector with all centroids.
    """
    rows = whole_vectors(vectors, id_col, vec_col, width, scale)
    rows = stored(rows, "whole")
    new = first_centroids(rows, k)
    if not len(new):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(True).alias("scanned"))
    k, old, radius = len(new), None, None
    sums, counts = np.zeros((k, width), object), np.zeros(k, object)
    for turn in range(rounds + 1):
        rows = stored(_assigned(rows, old, new, radius), "assigned")
        if turn == rounds:
            break
        more, n = _change(rows, k, width)
        sums, counts = sums + more, counts + n
        radius = np.zeros(k)
        for r in rows.groupBy("cluster").agg(F.max("distance").alias("far")).collect():
            radius[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + MARGIN)
        old, new = new, np.array([[int(s) // int(counts[j]) for s in sums[j]] if counts[j] else new[j] for j in range(k)], np.int64)
    spark = rows.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(new.tolist())]
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = per.agg(F.sum("cluster_inertia").alias("inertia"))
    few = per.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").crossJoin(whole)  # k rows, one row
    return rows.select(F.col("id").alias(id_col), "cluster", "distance", "scanned").join(F.broadcast(few), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
