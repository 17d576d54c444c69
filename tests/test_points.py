"""Stations on regular and irregular axes against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from gridfold.operators.points import (first_not_below, nearest_on_axis, sample_nearest,
                                       sample_nearest_irregular)

POINTS = "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE"


def test_binary_search_equals_bisect(spark):
    rng = random.Random(4)
    axes = [sorted({rng.randrange(400) / 4 for _ in range(n)}) for n in (0, 1, 2, 3, 17, 300)]
    rows = [(k, a, rng.randrange(-40, 440) / 4) for k in range(60) for a in axes] + [(0, axes[3], None)]
    d = spark.createDataFrame(rows, "k INT, a ARRAY<DOUBLE>, v DOUBLE")
    got = d.select("a", "v", first_not_below(F.col("a"), F.col("v")).alias("at"),
                   nearest_on_axis(F.col("a"), F.col("v")).alias("up"),
                   nearest_on_axis(F.col("a"), F.col("v"), tie_up=False).alias("down")).collect()
    for r in got:
        if r["v"] is None or not r["a"]:
            assert r["up"] is None and r["down"] is None
            continue
        assert r["at"] == bisect.bisect_left(r["a"], r["v"])
        assert r["up"] == min(r["a"], key=lambda z: (abs(z - r["v"]), -z))
        assert r["down"] == min(r["a"], key=lambda z: (abs(z - r["v"]), z))


def stack(spark, ys, xs, dates=("2020-01-01", "2020-01-09")):
    rows = [(d, y, x, 100 * i + 10 * y + x, float(i)) for i, d in enumerate(dates) for y in ys for x in xs]
    return spark.createDataFrame(rows, "date STRING, y DOUBLE, x DOUBLE, value DOUBLE, qflag DOUBLE").withColumn(
        "date", F.col("date").cast("date"))


def test_irregular_axes_with_gaps_and_ties(spark):
    cells = stack(spark, [0.0, 1.0, 7.0], [0.0, 4.0, 5.0]).where("not (y = 7 and x = 5)")
    pts = spark.createDataFrame([(1, "tie", 2.0, 4.0), (2, "far", 99.0, -99.0), (3, "hole", 5.0, 6.9),
                                 (4, "none", None, 1.0), (None, "id", 0.0, 0.0)], POINTS)
    got = {(r["station"], str(r["date"])): r["value"] for r in sample_nearest_irregular(cells, pts).collect()}
    assert len(got) == 10
    assert got["tie", "2020-01-01"] == 74.0 and got["tie", "2020-01-09"] == 174.0      # larger coordinate on both axes
    assert got["far", "2020-01-01"] == 5.0 and got["id", "2020-01-01"] == 0.0
    assert got["hole", "2020-01-01"] is None and got["none", "2020-01-09"] is None
    down = {r["station"]: r["value"] for r in sample_nearest_irregular(cells, pts, tie="index").where(
        "date = date'2020-01-01'").collect()}
    assert down["tie"] == 14.0                                                             # smaller y, larger x
    near = {r["station"]: r["value"] for r in sample_nearest_irregular(cells, pts, max_distance=1.5).where(
        "date = date'2020-01-01'").collect()}
    assert near == {"tie": None, "far": None, "hole": None, "none": None, "id": 0.0}
    with pytest.raises(ValueError):
        sample_nearest_irregular(cells, pts, tie="other")


def test_regular_axes_agree_with_the_search(spark, grid_small):
    rng = random.Random(9)
    spec = grid_small
    cells = spec.with_coords(spark.range(spec.n_cells).select(
        F.lit("2020-01-01").cast("date").alias("date"), (F.col("id") / spec.nx).cast("int").alias("iy"),
        (F.col("id") % spec.nx).cast("int").alias("ix"), F.col("id").cast("double").alias("value")))
    pts = spark.createDataFrame([(i, f"s{i}", rng.randrange(-20, 60) / 16, rng.randrange(-20, 60) / 16)
                                 for i in range(60)], POINTS)
    for tie in ("coord", "index"):
        for far in (None, 0.25):
            one = sorted(map(tuple, sample_nearest(cells, pts, spec, tie, far).collect()))
            assert one == sorted(map(tuple, sample_nearest_irregular(cells, pts, tie, far).collect()))


def test_empty_inputs(spark, grid_small):
    cells = stack(spark, [0.0, 1.0], [0.0])
    pts = spark.createDataFrame([(1, "a", 0.0, 0.0)], POINTS)
    assert sample_nearest_irregular(cells.limit(0), pts).count() == 0
    assert sample_nearest_irregular(cells, pts.limit(0)).count() == 0
    grid = cells.withColumns({"iy": F.lit(0), "ix": F.lit(0)}).limit(0)
    assert sample_nearest(grid, pts, grid_small).count() == 0


@pytest.mark.parametrize("listed", [1000, 3])
def test_series_are_made_once_for_each_cell(spark, grid_small, monkeypatch, listed):
    """Many points in few cells: what is joined to the cells and averaged is
    keyed by cell, not by point, and every point still has its own rows."""
    from gridfold.operators import points as module
    from tests.test_plans import plan
    monkeypatch.setattr(module, "MAX_LISTED_CELLS", listed)
    monkeypatch.setattr(module, "MAX_BROADCAST_POINTS", 100)
    spec, rng = grid_small, random.Random(2)
    cells = spec.with_coords(spark.range(2 * spec.n_cells).where("id % 5 <> 3").select(
        F.when(F.col("id") < spec.n_cells, "2020-01-01").otherwise("2020-01-09").cast("date").alias("date"),
        (F.col("id") % spec.n_cells / spec.nx).cast("int").alias("iy"), (F.col("id") % spec.nx).cast("int").alias("ix"),
        F.when(F.col("id") % 7 != 2, F.col("id").cast("double")).alias("value")))
    data = {(str(r["date"]), r["iy"], r["ix"]): r["value"] for r in cells.collect()}
    rows = [(i, f"s{i}", rng.randrange(0, 48) / 16, rng.randrange(0, 32) / 16) for i in range(200)]
    pts = spark.createDataFrame(rows + rows[:20], POINTS)              # a point given twice is one

    def cell(x, y):                                                    # ties to the larger coordinate
        return -(-(2 - y) // 0.5) - 1 if (2 - y) % 0.5 == 0 else (2 - y) // 0.5, x // 0.5

    def near(x, y, far):
        iy, ix = (int(v) for v in cell(x, y))
        iy, ix = min(max(iy, 0), 3), min(ix, 5)
        inside = far is None or (abs(x - (ix + 0.5) * 0.5) <= far and abs(y - (2 - (iy + 0.5) * 0.5)) <= far)
        return (iy, ix) if inside else None
    for far in (None, 0.125):                                          # near and far points share cells
        want = sorted((i, s, d, data.get((d, *near(x, y, far))) if near(x, y, far) else None)
                      for i, s, x, y in rows for d in ("2020-01-01", "2020-01-09"))
        out = sample_nearest(cells, pts, spec, max_distance=far)
        got = [(r["point_id"], r["station"], str(r["date"]), r["value"]) for r in out.collect()]
        assert sorted(got, key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    for out in (sample_nearest(cells, pts, spec), module.sample_window(cells, pts, spec, 1)):
        averages = [line for line in plan(out).splitlines() if "partial_avg" in line]
        assert averages and all("point_id" not in line and "piy" in line for line in averages)
        assert "SortMergeJoin" in plan(out)                                # many points are not broadcast
    averages = [line for line in plan(sample_nearest_irregular(cells, pts)).splitlines() if "partial_avg" in line]
    assert averages and all("point_id" not in line for line in averages)


def test_the_search_runs_once(spark):
    d = spark.createDataFrame([([0.0, 1.0], 0.4)], "a ARRAY<DOUBLE>, v DOUBLE")
    text = d.select(nearest_on_axis(F.col("a"), F.col("v")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert text.count("aggregate(sequence(") == 1
