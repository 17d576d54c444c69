"""Plan shape: pruning and pushdown reach the scan, small sides are
broadcast only when checked, coordinates are not shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from gridfold.operators.points import sample_nearest
from gridfold.operators.temporal import temporal_reduce
from gridfold.plans.broadcast import broadcast_if_small, row_count_at_most
from gridfold.plans.jobs import Crop, grid_summary
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import write_cells
from gridfold.sources.store import read_cells
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark):
    return write_cells(fx.cells(spark, SF_SMALL), scratch_path(spark, "plan-store"))


def test_date_range_prunes_partitions(spark, store):
    df = read_cells(spark, store, start="2020-01-09", end="2020-01-17")
    p = plan(df)
    assert "PartitionFilters: [isnotnull(date" in p
    assert "2020-01-09" in p or "18270" in p
    assert df.select("date").distinct().count() == 2


def test_projection_prunes_columns(spark, store):
    g = temporal_reduce(read_cells(spark, store), "mean", fx.CELLS_SPEC)
    p = plan(g)
    assert "ReadSchema: struct<iy:int,ix:int,value:float>" in p


def test_crop_reaches_scan(spark, store):
    s = grid_summary(read_cells(spark, store), fx.CELLS_SPEC, "mean", "banded", 2,
                     Crop(12.0, 20.0, 52.0, 58.0), persist=False)
    p = plan(s.stats)
    assert "PushedFilters" in p and "GreaterThanOrEqual(iy,6)" in p and "LessThanOrEqual(iy,17)" in p


def test_points_broadcast_after_check(spark):
    cells = fx.cells(spark, SF_SMALL)
    pts = fx.points(spark, SF_SMALL)
    assert "BroadcastHashJoin" in plan(sample_nearest(cells, pts, fx.CELLS_SPEC))
    assert row_count_at_most(pts, 10) is None
    assert "ResolvedHint" not in broadcast_if_small(pts, max_rows=10)._jdf.queryExecution().analyzed().toString()


def test_reduce_does_not_shuffle_coordinates(spark, store):
    g = temporal_reduce(read_cells(spark, store), "sum", fx.CELLS_SPEC)
    p = plan(g)
    exchanges = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1
    assert not re.search(r"[(, ][xy]#", exchanges[0])


def test_bucketed_store_reduces_without_shuffle(spark):
    from gridfold.catalog import q_store
    table = q_store.bucketed_store(spark, SF_SMALL)
    df = q_store.bucketed_summarise_on(spark, table)
    p = plan(df)
    assert "Exchange" not in p
    assert "Bucketed: true" in p and "PartitionFilters: [isnotnull(date" in p
    assert df.count() > 0


def test_scale_conf_sizes_partitions():
    from gridfold.session import scale_conf
    c = scale_conf(100 * 2**40, 4000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20) + 1
    assert int(scale_conf(1e6, 8)["spark.sql.shuffle.partitions"]) == 16


def test_window_width_does_not_multiply_the_points(spark):
    """A point is at most four join rows, and one partial row per task, point
    and date is shuffled, whatever the window's size."""
    from gridfold.operators.points import join_windows, nearest_index, sample_window
    cells = fx.cells(spark, SF_SMALL).select("date", "iy", "ix", "value")
    pts = nearest_index(fx.points(spark, SF_SMALL), fx.CELLS_SPEC, "index").select("point_id", "iy", "ix")
    for b in (0, 1, 3, 15):
        near = join_windows(cells, pts, b)
        p = pts.withColumnsRenamed({"iy": "piy", "ix": "pix"})
        want = cells.join(p, (F.abs(F.col("iy") - F.col("piy")) <= b) & (F.abs(F.col("ix") - F.col("pix")) <= b))
        assert near.count() == want.count()
    text = plan(sample_window(cells, fx.points(spark, SF_SMALL), fx.CELLS_SPEC, 15))
    assert text.count("Exchange hashpartitioning(point_id") == 1 and "partial_avg" in text


def test_series_are_complete_without_a_join(spark, store):
    """Every station has every date; the rows come with the aggregate."""
    from gridfold.operators.points import sample_nearest
    cells, pts = read_cells(spark, store), fx.points(spark, SF_SMALL)
    out = sample_nearest(cells, pts, fx.CELLS_SPEC)
    assert out.count() == pts.count() * cells.select("date").distinct().count()
    assert plan(out).count("Join") == 1
    some = sample_nearest(cells, pts, fx.CELLS_SPEC, dates=["2020-01-09", "1999-01-01"])
    assert some.count() == 2 * pts.count() and some.where("date = date'1999-01-01' and value is not null").count() == 0


def test_summarise_one_exchange_for_both_reductions(spark, store):
    """Time mean then 4 x 4 blocks over a date-partitioned store: the raw
    rows are shuffled once (by block); both aggregates ride on it."""
    from gridfold.operators.coarsen import summarise
    df = summarise(read_cells(spark, store), "mean", 4, fx.CELLS_SPEC)
    ex = [l for l in plan(df).splitlines() if "Exchange" in l]
    assert len(ex) == 1 and "blk" in ex[0]
    two = summarise(read_cells(spark, store), "mean", 4, fx.CELLS_SPEC, colocate=False)
    assert len([l for l in plan(two).splitlines() if "Exchange" in l]) == 2


def test_station_rows_reach_the_scan(spark, store):
    """Sampling a few stations reads only their grid rows: the needed rows
    become iy ranges in the Parquet scan's pushed filters."""
    from gridfold.operators.points import row_runs, sample_nearest
    pts = spark.createDataFrame([(1, "a", 12.3, 59.1), (2, "b", 20.1, 52.2)],
                                "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE")
    df = sample_nearest(read_cells(spark, store), pts, fx.CELLS_SPEC)
    p = plan(df)
    assert "PushedFilters" in p and "GreaterThanOrEqual(iy" in p
    assert df.count() > 0
    assert row_runs([5, 1, 2, 3, 9, 10]) == [(1, 3), (5, 5), (9, 10)]
    assert row_runs([1, 3, 10, 11], max_runs=2) == [(1, 3), (10, 11)]
    assert row_runs([]) == [] and row_runs([4]) == [(4, 4)]
    assert len(row_runs(list(range(0, 200_000, 2)))) == 32       # no quadratic walk over the gaps


def test_huge_blocks_keep_partial_aggregation(spark, store):
    """For a very coarse k one block would hold most of the grid: the plan
    keeps two Exchanges with map-side combining instead."""
    from gridfold.model import GridSpec
    from gridfold.operators.coarsen import summarise
    spec = GridSpec(x0=10.0, y0=61.0, dx=0.5 / 100, dy=0.5 / 100, nx=4300, ny=2200)
    df = summarise(read_cells(spark, store), "mean", 100, spec)
    assert len([l for l in plan(df).splitlines() if "Exchange" in l]) == 2


def test_bilinear_shuffles_once(spark):
    """Four values meet by their base cell; targets are listed in place."""
    from gridfold.catalog.q_reproject import DST, SIN_SPEC
    from gridfold.operators.reproject import reproject_bilinear
    path = scratch_path(spark, "bilinear-source")
    fx.cells(spark, SF_SMALL).where("date = date'2020-01-09'").select("iy", "ix", "value").write.parquet(path)
    text = plan(reproject_bilinear(spark.read.parquet(path), SIN_SPEC, DST))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_dense_reductions_build_no_frame_of_dates(spark, store):
    """The frame is one more composite: as many rows as the (cropped) grid, no join."""
    from gridfold.operators.temporal import yearly_sum_mean
    cells = read_cells(spark, store)
    s = grid_summary(cells, fx.CELLS_SPEC, "sum", "banded", 2, Crop(12.0, 20.0, 52.0, 58.0), persist=False, dense=True)
    text = plan(s.product)
    assert "Join" not in text and "Range (0, 192" in text          # 12 x 16 cells
    assert sum("Exchange" in line for line in text.splitlines()) == 1
    text = plan(yearly_sum_mean(cells, fx.CELLS_SPEC, dense=True))
    assert "Join" not in text and "Range (0, 946" in text
    assert len({line.split("Exchange")[1] for line in text.splitlines() if "Exchange hashpartitioning(iy" in line}) == 1


def test_composite_report_reads_the_store_once(spark, store):
    from gridfold.plans.jobs import composite_report
    r = composite_report(read_cells(spark, store), fx.CELLS_SPEC, ["2020-01-09", "2020-01-17"], 2,
                         lc=fx.lc_fine(spark, SF_SMALL), lc_spec=fx.LC_SPEC)
    for df in (r.stats, r.display, *r.profiles.values()):
        text = plan(df)
        assert "composite-report" in text and "plan-store" not in text
    assert "plan-store" not in plan(r.zonal)
