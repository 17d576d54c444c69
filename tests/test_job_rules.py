"""Rules of the user-level jobs: grids from all dates, overlaps, open date
lists, one tail for both range paths."""

import pytest
from pyspark.sql import functions as F

from gridfold import api
from gridfold.model import SINUSOIDAL, GridSpec
from gridfold.operators.landcover import zonal_sum
from gridfold.plans import jobs
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.raster import tile_overlaps, write_tiles
from tests.conftest import SF_SMALL


def test_grid_holds_the_tiles_of_every_date(spark):
    cells = fx.cells(spark, SF_SMALL)
    days = sorted(r[0] for r in cells.select("date").distinct().collect())[:2]
    part = cells.where((F.col("date") == F.lit(days[1])) | ((F.col("date") == F.lit(days[0])) & (F.col("ix") < 16)))
    tree = write_tiles(part, scratch_path(spark, "grow-tree"), fx.CELLS_SPEC, 8, 16)
    got, spec = api.load_stack(spark, tree)
    whole = part.where("value is not null or qflag is not null").groupBy("date").count()
    assert spec.nx > 16
    assert dict(map(tuple, got.groupBy("date").count().collect())) == dict(map(tuple, whole.collect()))


def test_overlapping_tiles_are_found(spark):
    rows = [("/s/2020-01-01/a.tif", 0.0, 4.0, 1.0, 1.0, 4, 4), ("/s/2020-01-01/b.tif", 4.0, 4.0, 1.0, 1.0, 4, 4),
            ("/s/2020-01-01/c.tif", 7.0, 4.0, 1.0, 1.0, 2, 2), ("/s/2020-01-09/d.tif", 0.0, 4.0, 1.0, 1.0, 4, 4)]
    h = spark.createDataFrame(rows, "path string, x0 double, y0 double, dx double, dy double, width int, height int")
    assert [tuple(r) for r in tile_overlaps(h).collect()] == [("/s/2020-01-01/b.tif", "/s/2020-01-01/c.tif")]
    assert tile_overlaps(h.limit(0)).count() == 0


def test_zonal_sum_with_null_keys(spark):
    grid = spark.createDataFrame([(None, 0, 0, 2.0), (None, 0, 1, 3.0)], "ord int, iy int, ix int, value double")
    lc = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (1, 1, 30)], "iy int, ix int, lc_code int")
    got = {r["lc_code"]: r["gpp_sum"] for r in zonal_sum(grid, lc, ("ord",)).collect()}
    assert got == {10: 2.0, 20: 3.0, 30: 0.0}


@pytest.mark.parametrize("low_mem", [False, True])
def test_both_range_paths_reproject(spark, low_mem):
    spec = GridSpec(x0=0.0, y0=4000000.0, dx=50000.0, dy=50000.0, nx=8, ny=8,
                    crs=SINUSOIDAL)
    cells = (spark.range(64).select(F.lit("2020-01-01").cast("date").alias("date"), F.lit("h00v00").alias("tile"),
                                    (F.col("id") / 8).cast("int").alias("iy"), (F.col("id") % 8).cast("int").alias("ix"),
                                    F.lit(5.0).alias("value")))
    cells = spec.with_coords(cells)
    s = jobs.range_summary(cells, spec, [("2020-01-01", "2020-01-31")], low_mem=low_mem)
    assert s.spec.crs != spec.crs
    row = s.stats.first()
    assert abs(row["mean"] - 5.0) < 1e-9


def test_land_cover_in_another_crs(spark):
    """Finer classes by their mode, coarser ones by the cell under the centre;
    a window reads a part only and changes nothing inside it."""
    from gridfold.operators.landcover import lc_to_grid
    from gridfold.catalog.q_reproject import SIN_SPEC
    lc = fx.lc_fine(spark, SF_SMALL)
    window = (4, 12, 6, 20)
    inside = "iy between 4 and 12 and ix between 6 and 20"
    whole = sorted(map(tuple, lc_to_grid(lc, fx.LC_SPEC, SIN_SPEC).where(inside).collect()), key=str)
    part = sorted(map(tuple, lc_to_grid(lc, fx.LC_SPEC, SIN_SPEC, window).where(inside).collect()), key=str)
    assert whole == part and len(whole) > 50
    coarse = GridSpec(x0=0.0, y0=70.0, dx=10.0, dy=10.0, nx=5, ny=4)
    big = coarse.with_coords(spark.range(20).select((F.col("id") / 5).cast("int").alias("iy"), (F.col("id") % 5).cast("int").alias("ix"),
                                                    F.when(F.col("id") % 2 == 0, 10).otherwise(20).alias("lc_code")))
    got = lc_to_grid(big, coarse, SIN_SPEC)
    assert got.count() > 500
    from gridfold.functions.projection import transform
    lon, lat = transform(SINUSOIDAL, "EPSG:4326", F.col("x"), F.col("y"))
    want = F.when((coarse.iy_of(lat) * 5 + coarse.ix_of(lon)) % 2 == 0, 10).otherwise(20)
    assert got.where(F.col("lc_code") != want).count() == 0


def test_partial_statistics_merge(spark):
    from gridfold.operators.stats import STAT_ORDER, grid_stats, merge_moments, moments
    cells = fx.cells(spark, SF_SMALL)
    big = cells.withColumn("value", F.col("value") + 1e6)         # far from zero: no cancellation
    for some in (cells, big, cells.where("value is null"), cells.limit(0), cells.limit(1)):
        for rows in (1, 5, 512):
            a, b = merge_moments(moments(some, rows)).first(), grid_stats(some).first()
            assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-6) for k in STAT_ORDER if b[k] is not None)
            assert all((a[k] is None) == (b[k] is None) for k in STAT_ORDER)


def test_entry_lists_the_text_queries_only_with_their_folder(tmp_path):
    """Without the subpackage the rest still imports; an error inside it is
    not taken for its absence."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("gridfold", "__spark_entry__.py", "corpus_pipeline.py"):
        src, dst = os.path.join(root, name), tmp_path / name
        if os.path.exists(src):
            shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, dst)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    out = run()
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr
    (tmp_path / "gridfold/llm").mkdir()
    (tmp_path / "gridfold/llm/__init__.py").write_text("")
    (tmp_path / "gridfold/llm/catalog.py").write_text("import no_such_module_here")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert run().returncode != 0
