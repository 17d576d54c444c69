"""Queries: date selections, directory and file names, bands, crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_reduce import TEMPORAL_MEAN_SQL
from gridfold.catalog.registry import r6, register
from gridfold.operators.select import (crop, date_bounds, scale_value, select_dates,
                                       select_range, select_ranges)
from gridfold.operators.temporal import temporal_reduce
from gridfold.sources import fixtures as fx
from gridfold.sources.store import band_select, date_dirs, parse_tile_name

SPEC = fx.CELLS_SPEC
CELL_COLS = "date, tile, iy, ix, y, x, value, qflag"


@register("select_range", with_fixtures(f"""
SELECT {CELL_COLS} FROM cells WHERE date BETWEEN DATE '2020-01-09' AND DATE '2020-01-25'"""))
def q_select_range(spark, sf):
    return select_range(fx.cells(spark, sf), "2020-01-09", "2020-01-25")


@register("select_range_open", with_fixtures(f"""
SELECT {CELL_COLS} FROM cells WHERE date >= DATE '2020-01-25'"""))
def q_select_range_open(spark, sf):
    return select_range(fx.cells(spark, sf), "2020-01-25", "")


def ranges_values_sql() -> str:
    return ", ".join(f"({i}, DATE '{s}', DATE '{e}')" for i, (s, e) in enumerate(fx.DATE_RANGES))


@register("select_ranges", with_fixtures(f"""
SELECT c.date, c.tile, c.iy, c.ix, c.y, c.x, c.value, c.qflag, r.k
FROM cells c JOIN (VALUES {ranges_values_sql()}) r(k, s, e) ON c.date BETWEEN r.s AND r.e"""))
def q_select_ranges(spark, sf):
    return select_ranges(fx.cells(spark, sf), fx.DATE_RANGES)


@register("select_ranges_distinct", with_fixtures(f"""
SELECT {CELL_COLS} FROM cells c
WHERE EXISTS (SELECT 1 FROM (VALUES {ranges_values_sql()}) r(k, s, e) WHERE c.date BETWEEN r.s AND r.e)"""))
def q_select_ranges_distinct(spark, sf):
    return select_ranges(fx.cells(spark, sf), fx.DATE_RANGES, distinct=True)


# Fixed request: out of order, one date twice, one date that does not exist.
DATE_REQUEST = ["2020-01-25", "2020-01-01", "2020-03-01", "2020-01-25"]


@register("select_dates", with_fixtures(f"""
SELECT c.date, c.tile, c.iy, c.ix, c.y, c.x, c.value, c.qflag, r.ord
FROM cells c JOIN (VALUES {", ".join(f"({i}, DATE '{d}')" for i, d in enumerate(DATE_REQUEST))}) r(ord, d)
  ON c.date = r.d"""))
def q_select_dates(spark, sf):
    return select_dates(fx.cells(spark, sf), DATE_REQUEST)


@register("date_bounds", with_fixtures(
    "SELECT min(date) AS first_date, max(date) AS last_date FROM cells"))
def q_date_bounds(spark, sf):
    return date_bounds(fx.cells(spark, sf))


@register("band_select", with_fixtures(
    "SELECT date, tile, iy, ix, y, x, value FROM cells_long WHERE band = 2"))
def q_band_select(spark, sf):
    return band_select(fx.cells_long(spark, sf), 2)


CROP = dict(lon_min=12.0, lon_max=20.0, lat_min=52.5, lat_max=58.25)


@register("crop_bbox", with_fixtures("""
SELECT iy, ix, y, x, round(value + 3.725290298461914e-09, 6) AS value FROM t
WHERE x BETWEEN 12.0 AND 20.0 AND y BETWEEN 52.5 AND 58.25""", {"t": TEMPORAL_MEAN_SQL}))
def q_crop_bbox(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    return r6(crop(g, **CROP), "value")


@register("crop_open_side", with_fixtures("""
SELECT iy, ix, y, x, round(value + 3.725290298461914e-09, 6) AS value FROM t WHERE y >= 55.0""", {"t": TEMPORAL_MEAN_SQL}))
def q_crop_open_side(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    return r6(crop(g, lat_min=55.0), "value")


@register("scale_value", with_fixtures(
    "SELECT iy, ix, y, x, round(value * 8.0 + 3.725290298461914e-09, 6) AS value FROM t", {"t": TEMPORAL_MEAN_SQL}))
def q_scale_value(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    return r6(scale_value(g, 8.0), "value")


# -- directory names (F1, C1) ---------------------------------------------------
def dir_names(spark, sf):
    """Candidate directory names made from the stack's dates: the dashed and
    compact forms (valid), day and month swapped (valid or not a calendar
    date), and a suffixed name (not a date directory)."""
    d = fx.cells(spark, sf).select("date").distinct()
    return d.select(F.explode(F.array(
        F.date_format("date", "yyyy-MM-dd"), F.date_format("date", "yyyyMMdd"),
        F.date_format("date", "yyyy-dd-MM"),
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("_old")))).alias("name"))


DIR_NAMES_SQL = """
SELECT unnest([strftime(date, '%Y-%m-%d'), strftime(date, '%Y%m%d'),
               strftime(date, '%Y-%d-%m'), strftime(date, '%Y-%m-%d') || '_old']) AS name
FROM (SELECT DISTINCT date FROM cells) d"""


@register("date_dirs", with_fixtures("""
SELECT name, CAST(CASE
  WHEN regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(name, '%Y-%m-%d')
  WHEN regexp_matches(name, '^\\d{8}$') THEN try_strptime(name, '%Y%m%d') END AS DATE) AS date
FROM names
WHERE CASE
  WHEN regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(name, '%Y-%m-%d')
  WHEN regexp_matches(name, '^\\d{8}$') THEN try_strptime(name, '%Y%m%d') END IS NOT NULL""",
    {"names": DIR_NAMES_SQL}))
def q_date_dirs(spark, sf):
    return date_dirs(dir_names(spark, sf), "name")


# -- tile file names (C2) -------------------------------------------------------
def tile_files(spark, sf):
    """File names of the stack's (date, tile) pairs."""
    return (fx.cells(spark, sf).select("date", "tile").distinct()
            .select(F.concat(F.lit("PRD_GPP_"), F.date_format("date", "yyyyMMdd"), F.lit("_"),
                             F.col("tile"), F.lit("_v02.tif")).alias("file")))


TILE_FILES_SQL = """
SELECT 'PRD_GPP_' || strftime(date, '%Y%m%d') || '_' || tile || '_v02.tif' AS file
FROM (SELECT DISTINCT date, tile FROM cells) d"""


@register("tile_name_parse", with_fixtures("""
SELECT file,
       regexp_extract(file, '^([^_]*_[^_]*)_([^_]*)_(.*)\\.tif$', 1) AS prefix,
       CAST(try_strptime(regexp_extract(file, '^([^_]*_[^_]*)_([^_]*)_(.*)\\.tif$', 2), '%Y%m%d') AS DATE)
         AS name_date,
       regexp_extract(file, '^([^_]*_[^_]*)_([^_]*)_(.*)\\.tif$', 3) AS tile_key
FROM files""", {"files": TILE_FILES_SQL}))
def q_tile_name_parse(spark, sf):
    return parse_tile_name(tile_files(spark, sf), "file")
