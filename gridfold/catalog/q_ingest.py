"""Queries: raster ingest (tile store written from the fixture, then listed
and decoded by Spark)."""

from __future__ import annotations

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_reduce import STATS_SQL
from gridfold.catalog.q_reproject import DST, SIN_SPEC, bilinear_sql
from gridfold.catalog.registry import register
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.raster import decode_tiles, read_tile_files, write_tiles
from gridfold.sources.store import scan_tiles

SPEC = fx.CELLS_SPEC
TILE_H, TILE_W = 8, 16


def tile_store(spark, sf, compression="deflate", predictor=2):
    root = scratch_path(spark, "tiles")
    return write_tiles(fx.cells(spark, sf), root, SPEC, TILE_H, TILE_W,
                       compression=compression, predictor=predictor)


@register("scan_tiles", with_fixtures("""
SELECT strftime(date, '%Y-%m-%d') AS dir,
       'PRD_GPP_' || strftime(date, '%Y%m%d') || '_' || tile || '_v02.tif' AS file,
       date, 'PRD_GPP' AS prefix, date AS name_date, tile || '_v02' AS tile_key
FROM (SELECT DISTINCT date, tile FROM cells) d"""))
def q_scan_tiles(spark, sf):
    return scan_tiles(spark, tile_store(spark, sf)).drop("path")


@register("decode_tiles", with_fixtures("""
SELECT date, tile, iy, ix, y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
       CAST(CAST(qflag AS FLOAT) AS DOUBLE) AS qflag FROM cells"""))
def q_decode_tiles(spark, sf):
    return decode_tiles(read_tile_files(spark, tile_store(spark, sf)), SPEC)


@register("decode_tiles_zstd", with_fixtures("""
SELECT date, tile, iy, ix, y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
       CAST(CAST(qflag AS FLOAT) AS DOUBLE) AS qflag FROM cells"""))
def q_decode_tiles_zstd(spark, sf):
    root = tile_store(spark, sf, compression="zstd", predictor=3)
    return decode_tiles(read_tile_files(spark, root), SPEC)


# -- whole workflows through the reference-shaped entry points -----------------
F32_CELLS = """SELECT date, iy, ix, y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
                      CAST(CAST(qflag AS FLOAT) AS DOUBLE) AS qflag FROM cells"""


@register("workflow_plot_range", with_fixtures("""
SELECT round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min,
       round(max(value) + 3.725290298461914e-09, 6) AS max,
       round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std,
       round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM (SELECT CAST(CAST(61.0 AS DOUBLE) - (floor(iy/2) + 0.5) * 1.0 AS DOUBLE) AS y,
             CAST(CAST(10.0 AS DOUBLE) + (floor(ix/2) + 0.5) * 1.0 AS DOUBLE) AS x,
             sum(value) * 8.0 AS value
      FROM (SELECT f.iy, f.ix, coalesce(s.value, 0.0) AS value
            FROM (SELECT CAST(i // 43 AS INT) AS iy, CAST(i % 43 AS INT) AS ix FROM range(0, 946) r(i)) f
            LEFT JOIN (SELECT iy, ix, sum(value) AS value FROM f32
                       WHERE date BETWEEN DATE '2020-01-01' AND DATE '2020-01-25' GROUP BY iy, ix) s USING (iy, ix)) t
      WHERE iy < 22 AND ix < 42 GROUP BY floor(iy/2), floor(ix/2)) p
WHERE x BETWEEN 12.0 AND 30.0 AND y BETWEEN 50.0 AND 60.0""", {"f32": F32_CELLS}))
def q_workflow_plot_range(spark, sf):
    """A yearly-sum style run over a GeoTIFF tree: range, sum, 2x coarser,
    crop, value factor 8, statistics (grid inferred from the tiles)."""
    from gridfold.api import plot_range
    from gridfold.catalog.registry import r6
    from gridfold.operators.stats import STAT_ORDER
    out = plot_range(spark, tile_store(spark, sf), ["2020-01-01", "2020-01-25"],
                     scratch_path(spark, "workflow-range"), coarsen=2, operator="sum",
                     value_factor=8.0, lon_min=12.0, lon_max=30.0, lat_min=50.0, lat_max=60.0)
    return r6(out["stats"], *STAT_ORDER)


@register("workflow_extract_timeseries", with_fixtures("""
SELECT p.point_id, p.station, d.date AS time, c.value * 0.5 AS data_value, c.qflag AS quality_flag
FROM (
  SELECT point_id, printf('point_%05d', point_id) AS station,
         CAST(least(greatest(ceil(((CAST(61.0 AS DOUBLE) - y) / 0.5 - 0.5) - 0.5), 0), 21) AS INT) AS iy,
         CAST(least(greatest(floor(((x - CAST(10.0 AS DOUBLE)) / 0.5 - 0.5) + 0.5), 0), 42) AS INT) AS ix
  FROM points) p CROSS JOIN (SELECT DISTINCT date FROM f32) d
LEFT JOIN f32 c ON c.iy = p.iy AND c.ix = p.ix AND c.date = d.date
WHERE d.date >= DATE '2020-01-17'""", {"f32": F32_CELLS}))
def q_workflow_extract_timeseries(spark, sf):
    """Station series from a GeoTIFF tree, nearest cell, scale 0.5, values
    and quality flags, written per station (and returned)."""
    from gridfold.api import extract_timeseries
    return extract_timeseries(spark, tile_store(spark, sf), scratch_path(spark, "workflow-series"),
                              fx.points(spark, sf).drop("station"), time_start="2020-01-17",
                              scale_factor=0.5, flag_quality=True)


@register("workflow_resume_projected", with_fixtures(STATS_SQL, {
    "f32": F32_CELLS, "src": "SELECT iy, ix, avg(value) AS value FROM f32 GROUP BY iy, ix",
    "t": bilinear_sql(SIN_SPEC, DST)}))
def q_workflow_resume_projected(spark, sf):
    """A low-memory run over a sinusoidal tile tree, then a second one that goes
    on from its per-tile products; both end on the lon/lat grid."""
    from gridfold.api import plot_range
    from gridfold.catalog.registry import r6
    from gridfold.operators.stats import STAT_ORDER
    root = write_tiles(fx.cells(spark, sf), scratch_path(spark, "tiles-sin"), SIN_SPEC, TILE_H, TILE_W)
    out_dir = scratch_path(spark, "workflow-resume")
    kw = dict(crs=SIN_SPEC.crs, spec=SIN_SPEC, low_mem=True, continue_plot=True)
    plot_range(spark, root, ["2020-01-01", "2020-01-25"], out_dir, **kw)["release"]()
    plot_range(spark, root, ["", ""], out_dir, **kw)["release"]()
    return r6(plot_range(spark, root, ["", ""], out_dir, **kw)["stats"], *STAT_ORDER)


@register("decode_tiles_split", with_fixtures("""
SELECT date, tile, iy, ix, y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
       CAST(CAST(qflag AS FLOAT) AS DOUBLE) AS qflag FROM cells"""))
def q_decode_tiles_split(spark, sf):
    """Every file taken as 'big': decoded strip by strip across tasks, each
    reading only its byte ranges."""
    from gridfold.sources.raster import decode_store
    return decode_store(spark, tile_store(spark, sf), SPEC, split_bytes=0)
