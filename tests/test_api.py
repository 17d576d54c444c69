"""The reference-shaped entry points on a GeoTIFF tree written from the
fixture: same numbers as the library jobs, files where expected."""

import os

import pytest
from pyspark.sql import functions as F

from gridfold import api
from gridfold.operators.stats import STAT_ORDER
from gridfold.plans import jobs
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.raster import write_tiles
from tests.conftest import SF_SMALL

SPEC = fx.CELLS_SPEC


@pytest.fixture(scope="module")
def tree(spark):
    return write_tiles(fx.cells(spark, SF_SMALL), scratch_path(spark, "api-tree"), SPEC, 8, 16)


def test_load_infers_grid(spark, tree):
    cells, spec = api.load_stack(spark, tree)
    assert (spec.x0, spec.y0, spec.dx, spec.nx, spec.ny, spec.crs) == (10.0, 61.0, 0.5, 43, 22, "EPSG:4326")
    assert cells.count() == fx.cells(spark, SF_SMALL).count()


def test_plot_range_outputs(spark, tree):
    out_dir = scratch_path(spark, "api-range")
    out = api.plot_range(spark, tree, ["2020-01-01", "2020-01-25"], out_dir, coarsen=2,
                         operator="sum", value_factor=8.0, extra_actions="record+plot+mean",
                         lc=fx.lc_fine(spark, SF_SMALL), lc_spec=fx.LC_SPEC,
                         exclude_lc_class=["Snow and Ice"], export_stats=True, output_data=True)
    ref = jobs.range_summary(fx.cells(spark, SF_SMALL).withColumn("value", F.col("value").cast("float").cast("double")),
                             SPEC, [("2020-01-01", "2020-01-25")], "sum", 2, value_factor=8.0,
                             persist=False, dense=True)
    a, b = out["stats"].first(), ref.stats.first()
    assert all(a[k] == pytest.approx(b[k]) for k in STAT_ORDER)
    for sub in ("stats", "data_save/longitude_data_mean", "data_save/lc_percentages", "data_save/stack"):
        assert os.path.isdir(f"{out_dir}/{sub}"), sub
    assert "profile_sum" not in out


def test_plot_composite_and_stop_after_save(spark, tree):
    out_dir = scratch_path(spark, "api-composite")
    out = api.plot_composite(spark, tree, ["2020-01-09"], out_dir, coarsen=2,
                             extra_actions="record+sum", export_stats=True)
    assert out["stats"].count() == 1 and os.path.isdir(f"{out_dir}/stats/date=2020-01-09")
    assert api.plot_composite(spark, tree, [], scratch_path(spark, "api-save"),
                              save_composite=True, stop_after_save=True) is None


def test_extract_timeseries_writes_per_station(spark, tree):
    dir_out = scratch_path(spark, "api-series")
    pts = fx.points(spark, SF_SMALL).drop("station").withColumn("name", F.concat(F.lit("st"), "point_id"))
    s = api.extract_timeseries(spark, tree, dir_out, pts, name_column="name", time_start="2020-01-09",
                               flag_quality=True, cellbuffer_extend=1, extract_area=True)
    assert s.count() > 0
    assert os.path.isdir(f"{dir_out}/time_series") and os.path.isdir(f"{dir_out}/time_series_area")


def test_actions_parse():
    a = api.Actions.parse("record+plot+sum")
    assert a.record and a.plot and a.methods() == ("sum",)
    with pytest.raises(ValueError):
        api.Actions.parse("plot+png")


def test_date_selection_opens_only_chosen_folders(spark, tree):
    from gridfold.operators.select import in_range
    from gridfold.sources.raster import read_tile_files
    files = read_tile_files(spark, tree, in_range("2020-01-09", "2020-01-17"))
    p = files._jdf.queryExecution().executedPlan().toString()
    assert "2020-01-09" in p and "2020-01-17" in p and "2020-01-25" not in p
    assert sorted({str(r["date"]) for r in files.select("date").collect()}) == ["2020-01-09", "2020-01-17"]


def test_sinusoidal_tree_is_reprojected(spark):
    """Tiles in the sinusoidal projection (no EPSG code): the CRS is given,
    the grid inferred, and the summary is reprojected to lon/lat."""
    from gridfold.catalog.q_reproject import SIN_SPEC
    from gridfold.model import SINUSOIDAL
    cells = fx.cells(spark, SF_SMALL)
    root = write_tiles(cells, scratch_path(spark, "api-sin"), SIN_SPEC, 8, 16)
    _, spec = api.load_stack(spark, root, crs=SINUSOIDAL)
    assert spec == SIN_SPEC
    out = api.plot_range(spark, root, ["", ""], scratch_path(spark, "api-sin-out"), crs=SINUSOIDAL)
    f32 = cells.withColumn("value", F.col("value").cast("float").cast("double"))
    ref = jobs.grid_summary(f32, SIN_SPEC, "mean", "banded", 1, persist=False).stats.first()
    got = out["stats"].first()
    assert all(got[k] == pytest.approx(ref[k]) for k in STAT_ORDER)


def test_continue_plot_reuses_tile_products(spark, tree):
    """Low-memory resume: the first run writes every per-tile product, a
    second run finds them all and computes nothing new; both agree with the
    per-tile summary."""
    out_dir = scratch_path(spark, "api-resume")
    kw = dict(coarsen=2, operator="sum", low_mem=True, continue_plot=True)
    dates = ["2020-01-01", "2020-01-25"]
    a = api.plot_range(spark, tree, dates, out_dir, **kw)["stats"].first()
    n = spark.read.parquet(f"{out_dir}/data_save/tile_products/done").count()
    b = api.plot_range(spark, tree, dates, out_dir, **kw)["stats"].first()
    c = api.plot_range(spark, tree, dates, out_dir + "-other", coarsen=2, operator="sum", low_mem=True)["stats"].first()
    assert all(a[k] == pytest.approx(c[k]) and b[k] == a[k] for k in STAT_ORDER)
    done = spark.read.parquet(f"{out_dir}/data_save/tile_products/done")
    assert done.count() == n == done.select("tile").distinct().count()
    # another operator, another selection and repeated ranges are other products
    m = api.plot_range(spark, tree, dates, out_dir, coarsen=2, low_mem=True, continue_plot=True)["stats"].first()
    twice = api.plot_range(spark, tree, [dates, dates], out_dir, **kw)["stats"].first()
    assert m["sum"] != a["sum"] and twice["sum"] == pytest.approx(2 * a["sum"])


def test_resume_sees_dates_added_under_an_open_end(spark):
    cells = fx.cells(spark, SF_SMALL)
    root, out_dir = scratch_path(spark, "api-open"), scratch_path(spark, "api-open-out")
    kw = dict(operator="sum", low_mem=True, continue_plot=True, spec=SPEC)
    write_tiles(cells.where("date <= date'2020-01-09'"), root, SPEC, 8, 16)
    one = api.plot_range(spark, root, ["2020-01-01", ""], out_dir, **kw)["stats"].first()["sum"]
    # a later date of two tiles only: their products are made anew, the others read again
    write_tiles(cells.where("date = date'2020-01-17' and tile in ('h00v00', 'h01v01')"), root, SPEC, 8, 16)
    two = api.plot_range(spark, root, ["2020-01-01", ""], out_dir, **kw)["stats"].first()["sum"]
    added = cells.where("date = date'2020-01-17' and tile in ('h00v00', 'h01v01')").agg(F.sum("value")).first()[0]
    assert added > 0 and two == pytest.approx(one + added)
    done = spark.read.parquet(f"{out_dir}/data_save/tile_products/done").groupBy("tile").count().collect()
    assert {r["tile"] for r in done if r["count"] == 2} == {"h00v00", "h01v01"}


def test_resumed_products_are_reprojected(spark):
    from gridfold.model import SINUSOIDAL, GridSpec
    spec = GridSpec(x0=0.0, y0=4000000.0, dx=50000.0, dy=50000.0, nx=8, ny=8, crs=SINUSOIDAL)
    cells = spec.with_coords(spark.range(64).select(
        F.lit("2020-01-01").cast("date").alias("date"), F.lit("h00v00").alias("tile"),
        (F.col("id") / 8).cast("int").alias("iy"), (F.col("id") % 8).cast("int").alias("ix"),
        F.lit(5.0).alias("value"), F.lit(1.0).alias("qflag")))
    root = write_tiles(cells, scratch_path(spark, "api-sin-resume"), spec, 8, 8)
    got = [api.plot_range(spark, root, ["", ""], scratch_path(spark, "sin"), crs=SINUSOIDAL, low_mem=True,
                          lon_min=0.5, lat_max=35.0, continue_plot=c)["stats"].first() for c in (False, True)]
    assert got[0]["mean"] == pytest.approx(5.0) and got[0]["sum"] > 0
    assert all(got[0][k] == pytest.approx(got[1][k]) for k in STAT_ORDER)


@pytest.mark.parametrize("given", [True, False])
def test_overlapping_tiles_are_never_added_up(spark, given):
    """Two tiles that hold the same 4 x 4 cells (and one its own column)."""
    from gridfold.model import GridSpec
    spec = GridSpec(x0=0.0, y0=4.0, dx=1.0, dy=1.0, nx=5, ny=4)
    cells = spec.with_coords(spark.range(20).select(
        F.lit("2020-01-01").cast("date").alias("date"), (F.col("id") / 5).cast("int").alias("iy"),
        (F.col("id") % 5).cast("int").alias("ix"), F.lit("h00v00").alias("tile"), F.lit(5.0).alias("value")))
    root = scratch_path(spark, "api-overlap")
    write_tiles(cells.where("ix < 4"), root, spec, 4, 4, prefix="A_x")
    write_tiles(cells.withColumn("value", F.lit(7.0)), root, spec, 4, 5, prefix="B_x", suffix="v03")
    kw = dict(operator="sum", spec=spec if given else None)
    with pytest.raises(ValueError, match="overlap"):
        api.plot_range(spark, root, ["", ""], scratch_path(spark, "o"), **kw)
    first = api.plot_range(spark, root, ["", ""], scratch_path(spark, "o"), overlap="first", **kw)["stats"].first()
    last = api.plot_range(spark, root, ["", ""], scratch_path(spark, "o"), overlap="last", **kw)["stats"].first()
    assert {first["sum"], last["sum"]} <= {5.0 * 16 + 7.0 * 4, 7.0 * 20} and last["sum"] >= first["sum"]


def test_strict_alignment_and_dense_sums(spark):
    cells = fx.cells(spark, SF_SMALL).where("date <= date'2020-01-09'")
    root = scratch_path(spark, "api-strict")
    write_tiles(cells.where("not (tile = 'h01v01' and date = date'2020-01-09')"), root, SPEC, 8, 16)
    with pytest.raises(ValueError, match="missing"):
        api.plot_range(spark, root, ["", ""], scratch_path(spark, "s"), alignment="strict")
    for low_mem in (False, True):
        full = api.plot_range(spark, root, ["", ""], scratch_path(spark, "s"), operator="sum", low_mem=low_mem)
        thin = api.plot_range(spark, root, ["", ""], scratch_path(spark, "s"), operator="sum", low_mem=low_mem, dense=False)
        assert full["product"].count() == SPEC.n_cells >= thin["product"].count()
        assert full["product"].where("value is null").count() == 0
        full["release"](), thin["release"]()


def test_points_are_numbered_in_order(spark):
    from gridfold.sources.store import numbered
    got = numbered(spark.range(0, 1000, 1, 7), "n").where("n <> id").count()
    assert got == 0 and numbered(spark.range(0), "n").count() == 0
    some = numbered(spark.range(0, 1000, 1, 7).where("id > 400 and id % 3 = 0"), "n").collect()
    assert sorted(r["n"] for r in some) == list(range(len(some)))


def test_formats(spark, tree):
    from gridfold.sources.sinks import write_cells
    store = write_cells(fx.cells(spark, SF_SMALL), scratch_path(spark, "api-parquet"))
    assert api._is_tiff_tree(spark, tree) and api._is_tiff_tree(spark, "file:" + tree)
    assert not api._is_tiff_tree(spark, store) and api._is_tiff_tree(spark, store, "geotiff")
    with pytest.raises(ValueError):
        api.load_stack(spark, store)
    with pytest.raises(ValueError):
        api.load_stack(spark, store, SPEC, format="other")


def test_plot_composite_land_cover_per_date(spark, tree):
    out = api.plot_composite(spark, tree, ["2020-01-01", "2020-01-09"], scratch_path(spark, "api-lc"),
                             coarsen=2, extra_actions="record+plot", lc=fx.lc_fine(spark, SF_SMALL),
                             lc_spec=fx.LC_SPEC, exclude_lc_class=["Built-up"])
    shares = out["lc_percentages"]
    per_date = shares.groupBy("date").agg(F.sum("percentage").alias("p"), F.count("*").alias("n")).collect()
    assert len(per_date) == 2
    assert all(abs(r["p"] - 100.0) <= 0.05 * r["n"] + 1e-9 for r in per_date)
    assert shares.where("lc_label = 'Built-up'").count() == 0


def test_big_files_decode_block_by_block(spark, tree):
    """Files above the split size are decoded per strip across tasks; the
    cells equal the whole-file decode."""
    from gridfold.sources.raster import decode_store, decode_tiles, read_tile_files
    whole = decode_tiles(read_tile_files(spark, tree), SPEC)
    split = decode_store(spark, tree, SPEC, split_bytes=0)           # every file split
    mixed = decode_store(spark, tree, SPEC, split_bytes=1200)        # some of each
    cols = ["date", "tile", "iy", "ix", "value", "qflag"]
    a = sorted(tuple(r) for r in whole.select(*cols).collect())
    assert a == sorted(tuple(r) for r in split.select(*cols).collect())
    assert a == sorted(tuple(r) for r in mixed.select(*cols).collect())
