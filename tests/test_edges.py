"""Edge cases of the reference behaviour, one per rule, on tiny grids."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridfold.model import GridSpec
from gridfold.operators.coarsen import coarsen, summarise
from gridfold.operators.landcover import lc_to_grid, zonal_share, zonal_sum
from gridfold.operators.points import nearest_index, sample_window, series
from gridfold.operators.select import (crop, mask_display, select_dates, select_range,
                                       select_ranges)
from gridfold.operators.stats import display_range, grid_stats, profile, quick_stats
from gridfold.operators.temporal import temporal_reduce
from gridfold.plans.jobs import range_summary
from gridfold.sources.store import date_dirs

D1, D2, D3 = dt.date(2020, 1, 1), dt.date(2020, 1, 9), dt.date(2020, 1, 17)
SCHEMA = "date DATE, tile STRING, iy INT, ix INT, y DOUBLE, x DOUBLE, value DOUBLE, qflag DOUBLE"


def cells_df(spark, spec, rows):
    """rows: (date, iy, ix, value)"""
    data = [(d, "h00v00", iy, ix, spec.y0 - (iy + 0.5) * spec.dy, spec.x0 + (ix + 0.5) * spec.dx,
             v, 1.0) for d, iy, ix, v in rows]
    return spark.createDataFrame(data, SCHEMA)


def full_grid(spark, spec, dates=(D1,), f=lambda d, iy, ix: float(iy * 10 + ix)):
    return cells_df(spark, spec, [(d, iy, ix, f(d, iy, ix)) for d in dates
                                  for iy in range(spec.ny) for ix in range(spec.nx)])


def as_map(df, key=("iy", "ix"), col="value"):
    return {tuple(r[k] for k in key): r[col] for r in df.collect()}


# All-missing cell: sum -> 0, mean -> NULL
def test_all_missing_cell(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, None), (D2, 0, 0, None), (D1, 0, 1, 3.0)])
    assert as_map(temporal_reduce(c, "mean", grid_small)) == {(0, 0): None, (0, 1): 3.0}
    assert as_map(temporal_reduce(c, "sum", grid_small)) == {(0, 0): 0.0, (0, 1): 3.0}


# NaN at the source is missing, not a number
def test_nan_is_missing(spark, grid_small):
    from gridfold.model import nan_to_null
    c = cells_df(spark, grid_small, [(D1, 0, 0, float("nan")), (D2, 0, 0, 4.0)])
    c = c.withColumn("value", nan_to_null(F.col("value")))
    assert as_map(temporal_reduce(c, "mean", grid_small)) == {(0, 0): 4.0}


# D3: mean of means, not weighted by valid counts
def test_mean_of_means(spark):
    spec = GridSpec(0.0, 1.0, 0.5, 0.5, nx=2, ny=2)
    c = cells_df(spark, spec, [(D1, 0, 0, 1.0), (D2, 0, 0, 3.0), (D1, 0, 1, 10.0)])
    out = summarise(c, "mean", 2, spec, "banded").collect()
    assert out[0]["value"] == pytest.approx((2.0 + 10.0) / 2)


# Flat preset blocks by max; low-mem path differs from whole-load
def test_presets_and_low_mem(spark):
    spec = GridSpec(0.0, 1.0, 0.5, 0.5, nx=2, ny=2)
    c = cells_df(spark, spec, [(D1, 0, 0, 1.0), (D1, 0, 1, 5.0)])
    assert summarise(c, "sum", 2, spec, "banded").first()["value"] == 6.0
    assert summarise(c, "sum", 2, spec, "flat").first()["value"] == 5.0
    assert summarise(c, "mean", 2, spec, "flat").first()["value"] == 5.0
    whole = range_summary(c, spec, [("2020-01-01", "2020-01-01")], "sum", 2, persist=False)
    low = range_summary(c, spec, [("2020-01-01", "2020-01-01")], "sum", 2, low_mem=True,
                        persist=False)
    assert whole.stats.first()["sum"] == 6.0
    assert low.stats.first()["sum"] == 5.0
    with pytest.raises(ValueError):
        summarise(c, "median", 2, spec)


# Trim incomplete blocks at the east and south ends; block centre
def test_trim(spark):
    spec = GridSpec(0.0, 11.0, 1.0, 1.0, nx=43, ny=22)
    c = full_grid(spark, spec, f=lambda d, iy, ix: 1.0)
    out = coarsen(c, 4, "sum", spec)
    assert out.count() == 10 * 5
    assert out.agg(F.max("iy"), F.max("ix")).first() == (4, 9)
    assert set(r["value"] for r in out.collect()) == {16.0}
    first = out.where("iy = 0 AND ix = 0").first()
    assert (first["x"], first["y"]) == (2.0, 9.0)


def test_coarsen_one_passes_through(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, None), (D1, 0, 1, 2.0)])
    assert as_map(coarsen(c, 1, "sum", grid_small)) == {(0, 0): 0.0, (0, 1): 2.0}
    assert as_map(coarsen(c, 1, "max", grid_small)) == {(0, 0): None, (0, 1): 2.0}


# Overlapping ranges are a bag; open bounds
def test_ranges_bag(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, 1.0), (D2, 0, 0, 2.0), (D3, 0, 0, 4.0)])
    bag = select_ranges(c, [("2020-01-01", "2020-01-09"), ("2020-01-09", "2020-01-17")])
    assert sorted(r["value"] for r in bag.collect()) == [1.0, 2.0, 2.0, 4.0]
    dis = select_ranges(c, [("2020-01-01", "2020-01-09"), ("2020-01-09", "2020-01-17")], True)
    assert dis.count() == 3
    assert select_range(c, "", "2020-01-09").count() == 2
    assert select_range(c, "2020-01-09", None).count() == 2
    s = temporal_reduce(bag, "sum", grid_small).first()["value"]
    assert s == 9.0  # 2020-01-09 counts twice


# Date list: missing dropped, empty = all, repeats and order kept
def test_select_dates(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, 1.0), (D2, 0, 0, 2.0)])
    out = select_dates(c, ["2020-01-09", "2021-01-01", "2020-01-09"]).collect()
    assert sorted((r["ord"], r["value"]) for r in out) == [(0, 2.0), (2, 2.0)]
    assert select_dates(c, []).count() == 2


# Date directories in both forms; bad calendar dates
def test_date_dirs(spark):
    names = spark.createDataFrame([("2020-01-01",), ("20200109",), ("2020-13-40",),
                                   ("2020-1-01",), ("tmp",)], "name STRING")
    got = {r["name"]: r["date"] for r in date_dirs(names).collect()}
    assert got == {"2020-01-01": D1, "20200109": D2}
    with pytest.raises(Exception):
        date_dirs(names, strict=True).collect()


# Crop is inclusive on cell centres; open sides keep the extent
def test_crop_inclusive(spark, grid_small):
    c = full_grid(spark, grid_small)
    out = crop(c, lon_min=0.75, lon_max=1.75, lat_min=1.25)
    assert sorted(set(r["x"] for r in out.collect())) == [0.75, 1.25, 1.75]
    assert sorted(set(r["y"] for r in out.collect())) == [1.25, 1.75]


# Statistics: population std/var
def test_stats_population(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, 1.0), (D1, 0, 1, 3.0), (D1, 0, 2, None)])
    s = grid_stats(c).first()
    assert (s["mean"], s["min"], s["max"], s["sum"]) == (2.0, 1.0, 3.0, 4.0)
    assert s["std"] == pytest.approx(1.0) and s["var"] == pytest.approx(1.0)


# Display mask keeps rows, nulls small values
def test_mask_display(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, 0.00005), (D1, 0, 1, 3.0)])
    assert as_map(mask_display(c)) == {(0, 0): None, (0, 1): 3.0}


# Profile: empty row gives 0 for mean and sum
def test_profile_empty_row(spark, grid_small):
    c = cells_df(spark, grid_small, [(D1, 0, 0, None), (D1, 0, 1, None), (D1, 1, 0, 2.0)])
    m = as_map(profile(c, "mean"), key=("y",))
    assert m == {(1.75,): 0.0, (1.25,): 2.0}
    with pytest.raises(ValueError):
        profile(c, "median")


# Exclusion by label renormalises; half-even rounding; unknown codes
def test_zonal_share_rules(spark):
    z = spark.createDataFrame([(10, 12.25), (20, 87.75), (80, 50.0)], "lc_code INT, gpp_sum DOUBLE")
    out = {r["lc_code"]: r["percentage"] for r in
           zonal_share(z, ["Permanent Water Bodies"]).collect()}
    assert out == {10: 12.2, 20: 87.8}
    bad = spark.createDataFrame([(11, 1.0)], "lc_code INT, gpp_sum DOUBLE")
    assert zonal_share(bad).first()["lc_label"] is None
    with pytest.raises(Exception):
        zonal_share(bad, strict=True).collect()


# Mode ties -> smallest code; classes present with no value -> 0
def test_mode_tie_and_zero_class(spark):
    fine = GridSpec(0.0, 1.0, 0.5, 0.5, nx=2, ny=2)
    coarse = GridSpec(0.0, 1.0, 1.0, 1.0, nx=1, ny=1)
    lc = spark.createDataFrame([(0, 0, 0.0, 0.0, 30), (0, 1, 0.0, 0.0, 20),
                                (1, 0, 0.0, 0.0, 30), (1, 1, 0.0, 0.0, 20)],
                               "iy INT, ix INT, y DOUBLE, x DOUBLE, lc_code INT")
    g = lc_to_grid(lc, fine, coarse)
    assert g.first()["lc_code"] == 20
    empty = spark.createDataFrame([], "iy INT, ix INT, value DOUBLE")
    assert zonal_sum(empty, g).first()["gpp_sum"] == 0.0


# Nearest without tolerance; ties
def test_nearest_ties_and_outside(spark, grid_small):
    pts = spark.createDataFrame([(1, "mid", 1.0, 1.0), (2, "far", -50.0, 99.0)],
                                "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE")
    by_coord = {r["station"]: (r["iy"], r["ix"]) for r in nearest_index(pts, grid_small).collect()}
    by_index = {r["station"]: (r["iy"], r["ix"])
                for r in nearest_index(pts, grid_small, "index").collect()}
    # x=1.0 between centres 0.75 (ix 1) and 1.25 (ix 2); y=1.0 between 1.25 (iy 1) and 0.75 (iy 2)
    assert by_coord["mid"] == (1, 2)
    assert by_index["mid"] == (2, 2)
    assert by_coord["far"] == (0, 0)


# Window at the top-left edge: truncated, or empty with reference slices
def test_window_edges(spark, grid_small):
    c = full_grid(spark, grid_small)
    pts = spark.createDataFrame([(1, "corner", 0.1, 1.9)],
                                "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE")
    t = sample_window(c, pts, grid_small, 1).first()
    assert t["value"] == pytest.approx((0 + 1 + 10 + 11) / 4)
    empty = sample_window(c, pts, grid_small, 1, edge="reference").collect()
    assert len(empty) == c.select("date").distinct().count() and all(r["value"] is None for r in empty)


# Scale factor on values only; both flags off is an error
def test_series_flags(spark):
    s = spark.createDataFrame([(1, "a", D1, 2.0, 7.0)],
                              "point_id BIGINT, station STRING, date DATE, value DOUBLE, qflag DOUBLE")
    r = series(s, scale_factor=0.5, flag_quality=True).first()
    assert (r["data_value"], r["quality_flag"]) == (1.0, 7.0)
    with pytest.raises(ValueError):
        series(s, flag_value=False, flag_quality=False)


# Display range rules
def test_display_range(spark):
    q = spark.createDataFrame([(-3.0, 5.5, 10.2)], "min DOUBLE, mean DOUBLE, max DOUBLE")
    assert display_range(q, "standard").first() == (0.0001, 11.0)
    assert display_range(q, "standard", max_factor=0.5).first()["vmax"] == 6.0
    assert display_range(q, "standard", vmax=5.0).first()["vmax"] == 20.0
    assert display_range(q, "difference").first() == (-11.0, 11.0)
    with pytest.raises(NotImplementedError):
        display_range(q, "other")
    assert quick_stats(spark.createDataFrame([(1.0,)], "value DOUBLE")).first() == (1.0, 1.0, 1.0)


def test_rows_are_kept_whole(spark, grid_small):
    """Duplicate station names keep both their rows."""
    c = full_grid(spark, grid_small)
    pts = spark.createDataFrame([(1, "same", 0.3, 1.8), (2, "same", 2.8, 0.2)],
                                "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE")
    from gridfold.operators.points import sample_nearest
    assert sample_nearest(c, pts, grid_small).count() == 2 * c.select("date").distinct().count()


def test_unknown_projection(spark):
    from gridfold.functions.projection import transform
    with pytest.raises(ValueError):
        transform("EPSG:32633", "EPSG:4326", F.col("x"), F.col("y"))


def test_summary_checkpointed(spark, grid_small):
    """A summary whose product is cut from its lineage gives the same stats."""
    from gridfold.plans.jobs import grid_summary
    c = full_grid(spark, grid_small, dates=(D1, D2))
    a = grid_summary(c, grid_small, "mean", "banded", 2, persist="checkpoint").stats.first()
    b = grid_summary(c, grid_small, "mean", "banded", 2, persist=False).stats.first()
    assert a == b


# Strict tile completeness raises; the per-tile path rejects only_plot
def test_strict_tiles_and_low_mem_operator(spark):
    from gridfold.operators.align import check_complete, tile_gaps
    tiles = spark.createDataFrame([(D1, "h00v00"), (D1, "h01v00"), (D2, "h00v00")],
                                  "date DATE, tile_key STRING")
    gaps = tile_gaps(tiles).collect()
    assert [(r["tile_key"], r["date"]) for r in gaps] == [("h01v00", D2)]
    with pytest.raises(ValueError):
        check_complete(tiles)
    spec = GridSpec(0.0, 1.0, 0.5, 0.5, nx=2, ny=2)
    c = cells_df(spark, spec, [(D1, 0, 0, 1.0)])
    with pytest.raises(ValueError):
        range_summary(c, spec, [("", "")], "only_plot", 2, low_mem=True, persist=False)


# Products are keyed by operator and dates, not by tile alone
def test_skip_existing_key(spark):
    from gridfold.operators.align import skip_existing
    wanted = spark.createDataFrame([("h00v00", "mean"), ("h00v00", "sum")], "tile STRING, operator STRING")
    existing = spark.createDataFrame([("h00v00", "sum")], "tile STRING, operator STRING")
    assert [tuple(r) for r in skip_existing(wanted, existing, ["tile", "operator"]).collect()] == \
        [("h00v00", "mean")]


def test_projections_round_trip(spark):
    import math
    from gridfold.functions.projection import R_WEB_MERCATOR, transform
    from gridfold.model import SINUSOIDAL, WEB_MERCATOR, WGS84
    df = spark.createDataFrame([(180.0, 0.0), (-45.0, 60.0), (10.5, -33.25)], "x DOUBLE, y DOUBLE")
    mx, my = transform(WGS84, WEB_MERCATOR, F.col("x"), F.col("y"))
    m = df.select(mx.alias("x"), my.alias("y")).collect()
    assert m[0]["x"] == pytest.approx(math.pi * R_WEB_MERCATOR)
    assert m[0]["y"] == pytest.approx(0.0, abs=1e-6)
    assert m[1]["y"] == pytest.approx(R_WEB_MERCATOR * math.log(math.tan(math.pi / 4 + math.radians(30))))
    for crs in (WEB_MERCATOR, SINUSOIDAL):
        fx_, fy_ = transform(WGS84, crs, F.col("x"), F.col("y"))
        there = df.select(fx_.alias("x"), fy_.alias("y"))
        bx, by = transform(crs, WGS84, F.col("x"), F.col("y"))
        back = there.select(bx.alias("x"), by.alias("y")).collect()
        for a, b in zip(df.collect(), back):
            assert b["x"] == pytest.approx(a["x"], abs=1e-9)
            assert b["y"] == pytest.approx(a["y"], abs=1e-9)


def test_target_grid_of_sinusoidal_fixture():
    import math
    from gridfold.catalog.q_reproject import SIN_SPEC
    from gridfold.operators.reproject import target_grid, target_resolution
    r, (w, s, e, n) = target_resolution(SIN_SPEC)
    assert (s, n) == (pytest.approx(50.0), pytest.approx(61.0))
    assert w == pytest.approx(10.0 / math.cos(math.radians(50.0)))
    assert e == pytest.approx(31.5 / math.cos(math.radians(61.0)))
    assert r == pytest.approx(0.5)
    g = target_grid(SIN_SPEC)
    assert (g.nx, g.ny, g.dx) == (round((e - w) / 0.5), 22, pytest.approx(0.5))
    r2, _ = target_resolution(SIN_SPEC, lon_min=20.0, lon_max=21.0)
    assert r2 == pytest.approx(max(min(1.0 / 43, 11.0 / 22), 11.0 / 1600))


def test_points_from_wkb(spark):
    """WKB points (either byte order, EWKB with SRID) are read; empty
    points are skipped; any other geometry type fails the job."""
    import struct
    from gridfold.sources.store import read_points
    le = struct.pack("<BIdd", 1, 1, 10.5, 50.25)
    be = struct.pack(">BIdd", 0, 1, -3.0, 7.5)
    ewkb = struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 1.0, 2.0)
    empty = struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))
    df = spark.createDataFrame([(1, le), (2, be), (3, ewkb), (4, empty)],
                               "point_id BIGINT, geometry BINARY")
    got = {r["point_id"]: (r["x"], r["y"]) for r in
           read_points(df, geometry_col="geometry", crs="EPSG:4326").collect()}
    assert got == {1: (10.5, 50.25), 2: (-3.0, 7.5), 3: (1.0, 2.0)}
    line = struct.pack("<BII", 1, 2, 0)
    bad = spark.createDataFrame([(5, line)], "point_id BIGINT, geometry BINARY")
    with pytest.raises(Exception):
        read_points(bad, geometry_col="geometry", crs="EPSG:4326").collect()


def test_land_cover_window_is_exact(spark):
    """Restricting the land cover to a product window changes nothing inside
    the window."""
    from gridfold.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    lc = fx.lc_fine(spark, SF_SMALL)
    spec = fx.CELLS_SPEC.coarsened(2)
    window = spec.index_window(lon_min=13.0, lon_max=25.0, lat_min=52.0, lat_max=58.0)
    iy_lo, iy_hi, ix_lo, ix_hi = window
    inside = (F.col("iy").between(iy_lo, iy_hi) & F.col("ix").between(ix_lo, ix_hi))
    full = lc_to_grid(lc, fx.LC_SPEC, spec).where(inside)
    part = lc_to_grid(lc, fx.LC_SPEC, spec, window).where(inside)
    assert sorted(full.collect()) == sorted(part.collect()) and full.count() > 0
