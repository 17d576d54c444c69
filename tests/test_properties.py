"""Properties that must hold on any input (hypothesis-generated grids)."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridfold.model import WGS84, GridSpec
from gridfold.operators.coarsen import coarsen
from gridfold.operators.landcover import zonal_share
from gridfold.operators.points import sample_nearest, sample_window
from gridfold.operators.reproject import reproject_bilinear
from gridfold.operators.select import select_ranges
from gridfold.operators.stats import grid_stats, profile
from gridfold.operators.temporal import temporal_reduce

SPEC = GridSpec(x0=0.0, y0=5.0, dx=0.5, dy=0.5, nx=9, ny=7)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
cell_values = st.lists(st.one_of(st.none(), st.integers(0, 50).map(float)),
                       min_size=SPEC.n_cells, max_size=SPEC.n_cells)


def grid_df(spark, values):
    rows = [(i // SPEC.nx, i % SPEC.nx, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "iy INT, ix INT, value DOUBLE")
    return SPEC.with_coords(df)


@SETTINGS
@given(values=cell_values, k=st.integers(1, 4))
def test_block_sum_equals_trimmed_sum(spark, values, k):
    g = grid_df(spark, values)
    total = coarsen(g, k, "sum", SPEC).agg(F.sum("value")).first()[0] or 0.0
    ny, nx = (SPEC.ny // k) * k, (SPEC.nx // k) * k
    expect = sum(v or 0.0 for i, v in enumerate(values) if i // SPEC.nx < ny and i % SPEC.nx < nx)
    assert total == pytest.approx(expect)


@SETTINGS
@given(values=cell_values)
def test_profile_total_is_grid_sum(spark, values):
    g = grid_df(spark, values)
    prof = profile(g, "sum").agg(F.sum("value")).first()[0]
    assert prof == pytest.approx(grid_stats(g).first()["sum"])


@SETTINGS
@given(sums=st.lists(st.integers(1, 10_000).map(float), min_size=1, max_size=11, unique=True))
def test_shares_add_to_100(spark, sums):
    codes = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
    z = spark.createDataFrame(list(zip(codes, sums)), "lc_code INT, gpp_sum DOUBLE")
    total = zonal_share(z).agg(F.sum("percentage")).first()[0]
    assert abs(total - 100.0) <= 0.05 * len(sums) + 1e-9


def test_window_buffer_zero_is_nearest(spark):
    g = grid_df(spark, [float(i) for i in range(SPEC.n_cells)]).withColumn("date", F.lit(dt.date(2020, 1, 1)))
    pts = spark.createDataFrame([(1, "a", 1.3, 3.1), (2, "b", 4.4, 0.2)],
                                "point_id BIGINT, station STRING, x DOUBLE, y DOUBLE")
    a = sorted(sample_window(g, pts, SPEC, 0).collect())
    b = sorted(sample_nearest(g, pts, SPEC).collect())
    assert a == b


def test_bilinear_constant_field(spark):
    g = grid_df(spark, [7.0] * SPEC.n_cells)
    dst = GridSpec(x0=0.1, y0=4.9, dx=0.37, dy=0.41, nx=11, ny=8, crs=WGS84)
    vals = [r["value"] for r in reproject_bilinear(g, SPEC, dst).collect()]
    assert vals and all(v == pytest.approx(7.0) for v in vals)


def test_bilinear_identity_on_same_grid(spark):
    values = [float(i % 13) for i in range(SPEC.n_cells)]
    g = grid_df(spark, values)
    out = {(r["iy"], r["ix"]): r["value"] for r in reproject_bilinear(g, SPEC, SPEC).collect()}
    assert all(out[(i // SPEC.nx, i % SPEC.nx)] == pytest.approx(v) for i, v in enumerate(values))


def test_range_union_is_sum_of_disjoint_ranges(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=8 * i) for i in range(6)]
    rows = [(d, "t", 0, 0, 0.0, 0.0, float(i + 1), 0.0) for i, d in enumerate(days)]
    c = spark.createDataFrame(rows, "date DATE, tile STRING, iy INT, ix INT, y DOUBLE, x DOUBLE, "
                                    "value DOUBLE, qflag DOUBLE")
    r1, r2 = ("2020-01-01", "2020-01-17"), ("2020-01-25", "2020-02-10")
    both = temporal_reduce(select_ranges(c, [r1, r2]), "sum").first()["value"]
    one = temporal_reduce(select_ranges(c, [r1]), "sum").first()["value"]
    two = temporal_reduce(select_ranges(c, [r2]), "sum").first()["value"]
    assert both == one + two
