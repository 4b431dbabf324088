"""Neighbour joins over cells: the same rows as all pairs, few cells visited, copies counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import direction


def grouped(n, groups, seed, length=24):
    draw = np.random.default_rng(seed)
    middle = np.cumsum(np.random.default_rng(0).normal(size=(groups, length)), 1) * 6
    return middle[draw.integers(groups, size=n)] + 0.2 * draw.normal(size=(n, length))


@pytest.fixture(scope="module")
def tables(spark):
    q, r = grouped(60, 40, 1), grouped(3000, 40, 2)
    r[100:140] = r[7]  # copies: ties go to the first in order
    queries = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(q)] + [("bad", [float("nan")] * 24), ("null", None), ("odd", [1.0] * 5)], "input_key string, v array<double>")
    refs = spark.createDataFrame([(f"r{k}", k, v.tolist()) for k, v in enumerate(r)] + [("short", 9000, [2.0, 3.0, 4.0]), ("broken", 9001, [float("inf")] * 24), ("none", 9002, None)], "ref_key string, ref_order long, v array<double>")
    return q, r, queries.cache(), refs.cache()


def test_euclidean(spark, tables):
    q, r, queries, refs = tables
    got = {x["input_key"]: x for x in direction.knn_join_l2(queries, refs, block=128).collect()}
    d = np.sqrt(((q[:, None, :] - r[None]) ** 2).sum(2))
    assert len(got) == 63 and all(got[f"q{k}"]["ref_order"] == int(d[k].argmin()) and got[f"q{k}"]["distance"] == pytest.approx(d[k].min()) for k in range(60))
    assert all(got[k]["ref_key"] is None for k in ("bad", "null", "odd"))


def test_warping(spark, tables):
    q, r, queries, refs = tables
    got = {x["input_key"]: x for x in direction.dtw_1nn(queries.where("input_key in ('q1', 'q2', 'q3', 'q4', 'bad', 'odd')"), refs, block=128).collect()}
    for k in (1, 2, 3, 4):
        d = direction.banded_dtw(np.repeat(q[k][None], len(r), 0), r, 2)
        assert got[f"q{k}"]["ref_order"] == int(d.argmin()) and got[f"q{k}"]["distance"] == pytest.approx(d.min())
    assert got["bad"]["ref_key"] is None and got["odd"]["ref_key"] is None  # no path of the band ends lengths that differ so much


def test_few_cells_are_visited(spark, tables):
    q, r, queries, refs = tables
    cells = direction.Cells.of(refs, 256, 128)
    assert 60 <= len(cells.pivots) <= 260
    for bounds, distance in ((lambda c, x: c.by_distance(x), lambda x: np.sqrt(((r - x) ** 2).sum(1))), (lambda c, x: c.by_warping(x, 0.1), lambda x: direction.banded_dtw(np.repeat(x[None], len(r), 0), r, 2))):
        best = [float(distance(x).min()) for x in q[:20]]
        asked = spark.createDataFrame([(f"q{k}", q[k].tolist(), b) for k, b in enumerate(best)], "input_key string, v array<double>, best double")
        others = direction._visits(asked, cells, bounds, False).groupBy("input_key").count().agg(F.sum("count")).first()[0] or 0
        assert (20 + others) / (20 * len(cells.pivots)) < 0.1  # with the first cell of each
        place = cells.place(list(r))[0]
        for x in q[:20]:
            bound, d = bounds(cells, x), distance(x)
            assert all(bound[place[k]] <= d[k] + 1e-9 for k in range(0, len(r), 7))


def test_own_keys_are_skipped(spark):
    rows = spark.createDataFrame([(f"k{k}", k, [float(k // 2), 0.0]) for k in range(40)], "ref_key string, ref_order long, v array<double>")
    got = {x["input_key"]: (x["ref_key"], x["distance"]) for x in direction.knn_join_l2(rows.select(F.col("ref_key").alias("input_key"), "v"), rows, block=8, skip_own=True).collect()}
    assert got == {f"k{k}": (f"k{k ^ 1}", 0.0) for k in range(40)}
    assert direction.knn_join_l2(rows.select(F.col("ref_key").alias("input_key"), "v"), rows.limit(0)).where("ref_key is null").count() == 40


def test_visits_are_a_row_a_query(spark, monkeypatch):
    """Vectors without structure visit nearly all cells; Python gives one row a query for that, not one a visit."""
    draw, stored, keep = np.random.default_rng(5), {}, direction.written

    def written(rows, name):
        out = keep(rows, name)
        stored.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(direction, "written", written)
    x = draw.normal(size=(400, 32))
    refs = spark.createDataFrame([(f"r{k}", k, v.tolist()) for k, v in enumerate(x)], "ref_key string, ref_order long, v array<double>")
    queries = refs.where("ref_order % 20 = 0").select(F.col("ref_key").alias("input_key"), "v")
    got = {r["input_key"]: (r["ref_order"], r["distance"]) for r in direction.knn_join_l2(queries, refs, block=64, skip_own=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {k: v[0] for k, v in got.items()} == {f"r{k}": int(d[k].argmin()) for k in range(0, 400, 20)}
    assert all(abs(v[1] - d[int(k[1:])].min()) < 1e-9 for k, v in got.items())
    assert stored["visits"] == [20, 20]


def test_customers_stay_off_the_driver(spark, capsys):
    """The join of every daily panel, and so of the warping queries, sends no table that grows through the driver."""
    from tsengine.plans import registry

    registry.facts(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
