"""Embedding near-dedup (operator 10): PCA-ordered tiled comparison with early stopping.

Equal vectors are one class, and only classes are compared. A rotation to principal axes, fitted on a
bounded sample (any rotation gives the same cosines), puts most of the variance first. On the leading axes a tree of median
cuts, of the same sample, deals the classes into at most ``MOST_LEAVES`` leaves of about a block of rows; the exact box of each leaf is known from
all its rows. Unit vectors with cosine c are sqrt(2 - 2c) apart, so a row is copied only to the leaves whose boxes are no farther
from it, and pairs of leaves without such rows never meet. A leaf with more rows is split into blocks by row number, and pairs of blocks are
compared as tiles: sub-tiles whose boxes are too far apart are skipped, those that lie so close that all their pairs must link
are taken whole, for the others the products of the leading dimensions are summed first, and a pair is
given up as soon as the partial product and the product of the suffix norms stay below the threshold. The cosines of
what is left are computed in double precision on the vectors as given. Copies travel as 32-bit floats where that loses nothing.
Blocks grow with the table up to ``BLOCK_BYTES``, so up to 8 such blocks the shuffle is in proportion to the rows. Beyond that, vectors without any
structure on their leading axes (where exact comparison is quadratic) are copied to all blocks, others to near ones.

A tile sends on, for each of its vectors with links, their number and the smallest class it is connected to within
the tile, never the pairs themselves. Vectors that are null, zero or hold nulls or non-finite numbers, and vectors
of different lengths, link with nothing. Repeated rows are copies. A null id is no candidate for the smallest id of a
component; alone it has a null component and is not kept. An empty table gives an empty result. Other columns, whatever their names, are left out.
Lengths of vectors are compared one after another, those that only one class has not at all. The driver holds ``SAMPLE_BYTES`` of vectors and a box a leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored, uniform
from .components import components

COSINE, SUB, SAMPLE_ROWS, SAMPLE_BYTES, LEADING = 0.95, 768, 8_000, 16_000_000, (8, 16, 32)
#: A block is an eighth of the rows, and no more than BLOCK_BYTES of doubles.
BLOCKS, BLOCK_BYTES, BOX_AXES, MOST_LEAVES = 8, 16_000_000, 16, 1024


def _usable(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.asarray(v, dtype=object if any(e is None for e in v) else np.float64)
    if x.dtype == object or not np.isfinite(x).all():
        return None
    most = np.abs(x).max()
    return x if most > 0 else None


def _prepared(batches):
    """(id, raw): the vector as bytes in double precision, null if it can't link."""
    for pdf in batches:
        raw = [None if (x := _usable(v)) is None else (x + 0.0).tobytes() for v in pdf["v"]]
        yield pd.DataFrame({"id": pdf["id"], "raw": raw})


def _short(raw: bytes) -> bytes:
    """A vector as 32-bit floats if they hold it exactly, else as it is."""
    x = np.frombuffer(raw, np.float64)
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y.tobytes() if (y == x).all() else raw


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(sample: list[bytes], width: int) -> np.ndarray:
    """The principal axes of a sample of unit vectors, by falling variance; the identity without a sample."""
    if not sample:
        return np.eye(width)
    x = unit(np.frombuffer(b"".join(sample), np.float64).reshape(-1, width))
    values, axes = np.linalg.eigh(np.cov(x, rowvar=False).reshape(width, width) if len(x) > 1 else np.eye(width))
    return axes[:, np.argsort(-values, kind="stable")]


@dataclass
class Tree:
    """Median cuts on the leading axes: a complete binary tree of ``depth`` levels, its nodes in one row after another."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaves: int) -> Tree:
        depth = max(0, math.ceil(math.log2(max(1, min(leaves, MOST_LEAVES, len(points) // 8)))))
        axis, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        parts = {0: points}
        for k in range(2**depth - 1):
            own = parts.pop(k)
            if len(own) > 1 and own.var(0).max() > 0:
                axis[k] = int(own.var(0).argmax())
                cut[k] = np.median(own[:, axis[k]])
            right = own[:, axis[k]] > cut[k]
            parts[2 * k + 1], parts[2 * k + 2] = own[~right], own[right]
        return cls(depth, axis, cut)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - (2**self.depth - 1)


def near_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
    """points x boxes: whether a point is no farther than ``reach`` from a box."""
    far = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        x = points[:, k, None]
        gap = np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0)
        far += gap * gap
    return far <= reach * reach


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float, axes: np.ndarray):
    """Yield arrays (i, j) of linked pairs, a sub-tile at a time. ``right`` None: pairs i < j within ``left``."""
    def ordered(x):
        y = unit(x) @ axes
        order = np.argsort(y[:, 0], kind="stable")
        y = np.ascontiguousarray(y[order])
        tails = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], 0))
        return order, y, np.concatenate([tails, np.zeros((len(y), 1))], axis=1)

    slack, apart = 1e-9, 2 - 2 * threshold + 1e-9
    surely = math.sqrt(max(0.0, 2 - 2 * threshold - 1e-9))
    a = ordered(left)
    b = a if right is None else ordered(right)
    width = left.shape[1]
    steps = [k for k in LEADING if k < width] + [width]
    box = lambda y, s: (y[s : s + SUB, : steps[0]].min(0), y[s : s + SUB, : steps[0]].max(0))
    boxes = [[(s, *box(p[1], s)) for s in range(0, len(p[1]), SUB)] for p in (a, b)]
    norm = lambda x: np.sqrt((x * x).sum(1))
    other = left if right is None else right
    for s, lo, hi in boxes[0]:
        for t, low, high in boxes[1]:
            if right is None and t < s:
                continue
            gap = np.maximum(0, np.maximum(low - hi, lo - high))
            if gap @ gap > apart:
                continue
            ya, yb, ta, tb = a[1][s : s + SUB], b[1][t : t + SUB], a[2][s : s + SUB], b[2][t : t + SUB]
            ca, cb = ya.mean(0), yb.mean(0)
            if norm(ya - ca).max() + norm(yb - cb).max() + np.sqrt(((ca - cb) ** 2).sum()) <= surely:
                i, j = np.nonzero(np.tri(len(ya), len(yb), -1, bool).T if right is None and s == t else np.ones((len(ya), len(yb)), np.bool_))
                yield a[0][s + i], b[0][t + j]
                continue
            part = ya[:, : steps[0]] @ yb[:, : steps[0]].T
            reach = part + ta[:, steps[0], None] * tb[None, :, steps[0]] >= threshold - slack
            i, j = np.nonzero(reach)
            for k, m in zip(steps, steps[1:], strict=False):
                if not len(i):
                    break
                if len(i) * 6 > len(ya) * len(yb):  # still dense: the whole block of dimensions at once
                    part += ya[:, k:m] @ yb[:, k:m].T
                    got = part[i, j]
                else:
                    got = part[i, j] + np.einsum("ij,ij->i", ya[i, k:m], yb[j, k:m])
                    part[i, j] = got
                keep = got + ta[i, m] * tb[j, m] >= threshold - slack
                i, j = i[keep], j[keep]
            i, j = a[0][s + i], b[0][t + j]
            if right is None:
                keep = i != j if s != t else i < j  # of a sub-tile with itself each pair stands twice
                i, j = i[keep], j[keep]
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                x, y = left[p], other[q]
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                keep = np.einsum("ij,ij->i", x, y) / (norm(x) * norm(y)) >= threshold
                if keep.any():
                    yield p[keep], q[keep]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the components of the pairs into ``label`` (for each node the smallest node it is known to be connected with)."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label[:] = label[label]


def similar_vectors(vectors: DataFrame, threshold: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(_prepared, f"id {kind}, raw binary").withColumn("width", (F.length("raw") / 8).cast("int")).withColumn("name", F.md5("raw"))
    named = stored(named, "vectors")
    classes = named.where("raw is not null").groupBy("name", "width").agg(F.min(F.col("id").cast("long")).alias("low"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"))
    classes = stored(numbered(classes, ["name"], "node"), "classes")
    links = []
    spark = vectors.sparkSession
    for width, total in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("width").collect():
        own = classes.where(F.col("width") == width)
        most = max(16, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
        sample = [r["raw"] for r in own.where(uniform(F.lit("axes"), F.col("name")) < most / total).orderBy("name").limit(2 * most).select("raw").collect()]
        axes = rotation(sample, width)
        points = (unit(np.frombuffer(b"".join(sample), np.float64).reshape(-1, width)) @ axes)[:, :BOX_AXES] if sample else np.zeros((0, min(width, BOX_AXES)))
        size = block or max(1, min(BLOCK_BYTES // (8 * width), -(-total // BLOCKS)))
        links.append(_tiles(own, spark.sparkContext.broadcast((axes, Tree.of(points, -(-total // size)))), width, threshold, size))
    if links:
        found = links[0]
        for x in links[1:]:
            found = found.unionByName(x)
    else:
        found = classes.select("node", F.col("n").alias("links"), F.col("node").alias("root")).limit(0)
    found = stored(found, "links")
    groups = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = classes.select("name", "node", "low", "n").join(per_node, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = facts.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = facts.join(least, "component").select("name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = named.select("id", F.col("name").alias("own")).join(facts, F.col("own") == F.col("name"), "left")
    component = F.when(F.col("name").isNull(), F.col("id").cast("long")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id").cast("long") == component, F.lit(False)).alias("kept"))


def _tiles(classes: DataFrame, shared, width: int, threshold: float, block: int) -> DataFrame:
    """(node, links, root) from every tile: how many vectors it is linked with there, and a node it is connected to. shared: broadcast (axes, tree)."""
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    vectors = lambda raw: np.frombuffer(b"".join(raw), np.float64).reshape(-1, width)
    leading = lambda x: (unit(x) @ shared.value[0])[:, :BOX_AXES]

    @F.pandas_udf("int")
    def leaf(raw: pd.Series) -> pd.Series:
        return pd.Series(shared.value[1].leaf(leading(vectors(raw))).astype(np.int32))

    def ends(batches):
        k = 2**shared.value[1].depth
        low, high, rows = np.full((k, min(width, BOX_AXES)), np.inf), np.full((k, min(width, BOX_AXES)), -np.inf), np.zeros(k, np.int64)
        for pdf in batches:
            if len(pdf):
                at, y = pdf["leaf"].to_numpy(), leading(vectors(pdf["raw"]))
                np.minimum.at(low, at, y)
                np.maximum.at(high, at, y)
                rows += np.bincount(at, minlength=k)
        leaf, axis = np.nonzero(rows[:, None] * np.ones(low.shape[1]))
        yield pd.DataFrame({"leaf": leaf, "axis": axis, "low": low[leaf, axis], "high": high[leaf, axis], "n": rows[leaf]})

    rows = stored(classes.select("node", "n", "raw", leaf("raw").alias("leaf")), "leaves")
    facts = rows.mapInPandas(ends, "leaf int, axis int, low double, high double, n long").groupBy("leaf", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()  # MOST_LEAVES x BOX_AXES rows
    leaves = np.sort(facts["leaf"].unique())
    wide = {c: facts.pivot(index="leaf", columns="axis", values=c).loc[leaves].to_numpy() for c in ("low", "high", "n")}
    plan = classes.sparkSession.sparkContext.broadcast((leaves, wide["low"], wide["high"], np.maximum(1, (2 * wide["n"][:, 0].astype(np.int64) + block) // (2 * block))))

    def send(batches):
        leaves, low, high, blocks = plan.value
        for batch in batches:
            at, node = np.searchsorted(leaves, batch.column("leaf").to_numpy()), batch.column("node").to_numpy()
            for k in range(0, len(at), 1024):
                part = slice(k, k + 1024)
                row, to = np.nonzero(near_boxes(leading(vectors(batch.column("raw")[part].to_pylist())), low, high, reach))
                row, to = np.repeat(row + k, blocks[to]), np.repeat(to, blocks[to])
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])])
                other = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
                here, own = at[row], node[row] % blocks[at[row]]
                right = (here > to) | ((here == to) & (own > other))
                pick = lambda x, y, right=right: pa.array(np.where(right, y, x), pa.int32())
                rows = batch.select(["node", "n"]).take(pa.array(row))
                short = pa.array([_short(x) for x in batch.column("raw")[part].to_pylist()], pa.binary()).take(pa.array(row - k))
                yield pa.RecordBatch.from_arrays([pick(here, to), pick(own, other), pick(to, here), pick(other, own), pa.array(right), rows.column("node"), rows.column("n"), short], names=["s", "x", "t", "y", "right", "node", "n", "raw"])

    sent = rows.mapInArrow(send, "s int, x int, t int, y int, right boolean, node long, n long, raw binary")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["s"].iloc[0] == pdf["t"].iloc[0] and pdf["x"].iloc[0] == pdf["y"].iloc[0]
        side = pdf["right"].to_numpy(bool)
        order = np.argsort(side, kind="stable")
        node, n = pdf["node"].to_numpy()[order], pdf["n"].to_numpy()[order]
        raw = np.stack([np.frombuffer(x, np.float32 if len(x) < 8 * width else np.float64) for x in pdf["raw"].iloc[order]]).astype(np.float64)
        cut = len(raw) if same else int((~side).sum())
        count, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
        if same or 0 < cut < len(raw):
            for i, j in tile_links(raw[:cut], None if same else raw[cut:], threshold, shared.value[0]):
                j = j if same else j + cut
                count += np.bincount(i, n[j], len(raw)).astype(np.int64) + np.bincount(j, n[i], len(raw)).astype(np.int64)
                _joined(label, i, j)
        keep = count > 0
        return pd.DataFrame({"node": node[keep], "links": count[keep], "root": node[label[keep]]})

    return sent.groupBy("s", "x", "t", "y").applyInPandas(compare, "node long, links long, root long")
