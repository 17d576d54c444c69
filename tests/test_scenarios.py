"""The reference's documented workflows, end to end on the fixture tables."""

import pytest
from pyspark.sql import functions as F

from gridfold.operators.align import time_stack
from gridfold.operators.coarsen import summarise
from gridfold.operators.select import select_range
from gridfold.operators.stats import grid_stats, profile
from gridfold.operators.temporal import temporal_reduce
from gridfold.plans.jobs import Crop, composite_summary, grid_summary, point_series, range_summary
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import (write_cells, write_profile_csv, write_series_csv,
                                    write_stats_text, write_zonal_csv)
from gridfold.sources.store import read_cells
from tests.conftest import SF_SMALL

SPEC = fx.CELLS_SPEC


def test_single_composite(spark):
    """One composite at 2x coarser cells: products, stats, both profiles
    (recorded), land-cover shares, statistics text."""
    cells = fx.cells(spark, SF_SMALL)
    product, stats = composite_summary(cells, SPEC, ["2020-01-01"], k=2)
    assert stats.count() == 1
    base = scratch_path(spark, "scenario-composite")
    for m in ("sum", "mean"):
        p = write_profile_csv(profile(product, m, keys=("date",)).drop("date"), f"{base}/lon_{m}")
        assert spark.read.option("header", True).csv(p).count() == product.select("y").distinct().count()
    lines = [r[0] for r in spark.read.text(write_stats_text(stats.drop("ord", "date"), f"{base}/stats")).collect()]
    assert [line.split(":")[0] for line in lines] == ["mean", "min", "max", "sum", "std", "var"]


def test_range_low_mem_with_land_cover(spark):
    """Accumulated range (sum) on the per-tile path, value factor 8, display
    range at 75 % of the maximum, recorded land-cover shares."""
    cells = fx.cells(spark, SF_SMALL)
    s = range_summary(cells, SPEC, [("2020-01-01", "2020-02-18")], "sum", 2, low_mem=True,
                      value_factor=8.0, max_factor=0.75, lc=fx.lc_fine(spark, SF_SMALL),
                      lc_spec=fx.LC_SPEC, exclude_lc=("Snow and Ice",))
    total = s.zonal.agg(F.sum("percentage")).first()[0]
    assert abs(total - 100.0) < 0.05 * s.zonal.count() + 1e-9
    st = s.stats.first()
    assert st["max"] <= s.display.first()["vmax"] / 0.75 + 1
    path = write_zonal_csv(s.zonal, scratch_path(spark, "scenario-zonal"))
    assert spark.read.option("header", True).csv(path).count() == s.zonal.count()


def test_mean_across_years(spark):
    """Yearly sums saved one year at a time, read back, stacked with
    1 January as date, mean over years at coarser cells."""
    from gridfold.catalog.q_reduce import years_cells
    cy = years_cells(spark, SF_SMALL)
    paths = []
    for year in (2020, 2021, 2022, 2023):
        ysum = (temporal_reduce(select_range(cy, f"{year}-01-01", f"{year}-12-31"), "sum", SPEC)
                .withColumn("date", F.make_date(F.lit(year), F.lit(1), F.lit(1))))
        paths.append(write_cells(ysum, scratch_path(spark, f"year-{year}"), float32=False))
    stack = time_stack(*[read_cells(spark, p) for p in paths])
    flat = summarise(stack, "mean", 2, SPEC, "flat")
    s = grid_summary(stack, SPEC, "mean", "flat", 2, exclude_lc=())
    assert s.stats.first()["max"] == flat.agg(F.max("value")).first()[0]


def test_extract_timeseries(spark):
    """Station series over a range, 3 x 3 window mean, values and quality,
    one CSV folder per station."""
    cells = fx.cells(spark, SF_SMALL)
    pts = fx.points(spark, SF_SMALL)
    s = point_series(cells, SPEC, pts, "2020-01-01", "2020-12-31", buffer=1, flag_quality=True)
    assert set(s.columns) == {"point_id", "station", "time", "data_value", "quality_flag"}
    path = write_series_csv(s, scratch_path(spark, "scenario-series"))
    back = spark.read.option("header", True).csv(path)
    assert back.count() == s.count()
    with pytest.raises(ValueError):
        point_series(cells, SPEC, pts, flag_value=False, flag_quality=False)


def test_cropped_summary_stats_after_scale(spark):
    """Statistics are taken after crop and scale (reference order)."""
    cells = fx.cells(spark, SF_SMALL)
    box = Crop(12.0, 20.0, 52.0, 58.0)
    a = grid_summary(cells, SPEC, "mean", "banded", 2, box, value_factor=2.0).stats.first()
    b = grid_summary(cells, SPEC, "mean", "banded", 2, box).stats.first()
    assert a["sum"] == pytest.approx(2 * b["sum"])
    g = grid_stats(summarise(cells, "mean", 2, SPEC)).first()
    assert g["sum"] >= b["sum"]


def test_save_before_reduce(spark):
    """Saving stores the selected, un-reduced stack; stop_after_save ends
    the job there."""
    cells = fx.cells(spark, SF_SMALL)
    p1 = scratch_path(spark, "save-composite")
    assert composite_summary(cells, SPEC, ["2020-01-09", "2020-01-09"], k=2, save_path=p1,
                             stop_after_save=True) is None
    assert read_cells(spark, p1).count() == cells.where("date = '2020-01-09'").count()
    p2 = scratch_path(spark, "save-grid")
    s = grid_summary(cells, SPEC, "sum", "banded", 2, save_path=p2, persist=False)
    assert read_cells(spark, p2).count() == cells.count() and s.stats.count() == 1


def test_cropped_reprojection_prunes_source_exactly(spark):
    """Pruning the sinusoidal stack to the crop's source window gives the
    same reprojected cells as reprojecting everything and cropping after."""
    from gridfold.catalog.q_reproject import SIN_SPEC
    from gridfold.operators.reproject import reproject_bilinear
    from gridfold.operators.select import crop
    from gridfold.plans.jobs import product_spec
    cells = fx.cells(spark, SF_SMALL)
    box = Crop(20.0, 40.0, 52.0, 58.0)
    pruned = grid_summary(cells, SIN_SPEC, "mean", "banded", 1, box, persist=False).product
    dst = product_spec(SIN_SPEC, 1, box)
    full = crop(reproject_bilinear(summarise(cells, "mean", 1, SIN_SPEC), SIN_SPEC, dst), **box.kw())
    a = sorted((r["x"], r["y"], round(r["value"], 9)) for r in pruned.collect())
    b = sorted((r["x"], r["y"], round(r["value"], 9)) for r in full.collect())
    assert a == b and len(a) > 0
