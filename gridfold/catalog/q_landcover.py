"""Queries: land cover on the grid, zonal sums and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_reduce import TEMPORAL_SUM_SQL
from gridfold.catalog.q_reproject import SIN_SPEC, dbl
from gridfold.catalog.registry import r6, register
from gridfold.functions.labels import LC_LABELS
from gridfold.functions.projection import R_SINUSOIDAL
from gridfold.operators.landcover import (lc_classes, lc_to_grid, with_labels, zonal_share,
                                          zonal_sum)
from gridfold.operators.temporal import temporal_reduce
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.raster import read_landcover, write_tiles

SPEC = fx.CELLS_SPEC
EXCLUDED = ["Permanent Water Bodies", "Built-up", "Snow and Ice"]


def label_case(col: str = "lc_code") -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in LC_LABELS.items())
    return f"CASE {col} {whens} END"


LC_MODE_SQL = """
SELECT a.iy, a.ix, CAST(60.75 - 0.5*a.iy AS DOUBLE) AS y, CAST(10.25 + 0.5*a.ix AS DOUBLE) AS x,
       b.lc_code
FROM (SELECT DISTINCT iy, ix FROM m) a
LEFT JOIN (SELECT iy, ix, lc_code,
                  row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, lc_code) AS rn
           FROM (SELECT iy, ix, lc_code, count(*) AS n FROM m
                 WHERE lc_code IS NOT NULL GROUP BY iy, ix, lc_code) c) b
  ON a.iy = b.iy AND a.ix = b.ix AND b.rn = 1"""
LC_MAP_SQL = """
SELECT CAST(floor((CAST(61.0 AS DOUBLE) - y) / 0.5) AS INT) AS iy,
       CAST(floor((x - CAST(10.0 AS DOUBLE)) / 0.5) AS INT) AS ix, lc_code
FROM lc_fine"""
LC_CTES = {"m": LC_MAP_SQL, "lcg": LC_MODE_SQL}


def lc_grid(spark, sf):
    return lc_to_grid(fx.lc_fine(spark, sf), fx.LC_SPEC, SPEC)


@register("lc_cells", with_fixtures("SELECT iy, ix, y, x, lc_code FROM lc_fine"))
def q_lc_cells(spark, sf):
    return fx.lc_fine(spark, sf)


@register("lc_mode", with_fixtures("SELECT * FROM lcg", LC_CTES))
def q_lc_mode(spark, sf):
    return lc_grid(spark, sf)


@register("lc_read", with_fixtures("SELECT iy, ix, y, x, lc_code FROM lc_fine WHERE lc_code IS NOT NULL"))
def q_lc_read(spark, sf):
    """The class raster written as GeoTIFF tiles and read again."""
    tiles = fx.lc_fine(spark, sf).select(
        F.lit("2020-01-01").cast("date").alias("date"), "iy", "ix", F.col("lc_code").cast("double").alias("value"),
        F.format_string("h%02dv%02d", F.floor(F.col("ix") / 32).cast("int"), F.floor(F.col("iy") / 16).cast("int")).alias("tile"))
    root = write_tiles(tiles, scratch_path(spark, "lc-tiles"), fx.LC_SPEC, 16, 32, prefix="LC_map")
    return read_landcover(spark, root, fx.LC_SPEC)


@register("lc_mode_projected", with_fixtures(f"""
SELECT a.iy, a.ix, {dbl(SIN_SPEC.y0)} - (a.iy + 0.5) * {dbl(SIN_SPEC.dy)} AS y,
       {dbl(SIN_SPEC.x0)} + (a.ix + 0.5) * {dbl(SIN_SPEC.dx)} AS x, b.lc_code
FROM (SELECT DISTINCT iy, ix FROM m) a
LEFT JOIN (SELECT iy, ix, lc_code, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, lc_code) AS rn
           FROM (SELECT iy, ix, lc_code, count(*) AS n FROM m WHERE lc_code IS NOT NULL GROUP BY iy, ix, lc_code) c) b
  ON a.iy = b.iy AND a.ix = b.ix AND b.rn = 1""", {"m": f"""
SELECT * FROM (
  SELECT CAST(floor(({dbl(SIN_SPEC.y0)} - {dbl(R_SINUSOIDAL)} * radians(y)) / {dbl(SIN_SPEC.dy)}) AS INT) AS iy,
         CAST(floor(({dbl(R_SINUSOIDAL)} * radians(x) * cos(radians(y)) - {dbl(SIN_SPEC.x0)}) / {dbl(SIN_SPEC.dx)}) AS INT) AS ix,
         lc_code FROM lc_fine) q
WHERE iy BETWEEN 0 AND {SIN_SPEC.ny - 1} AND ix BETWEEN 0 AND {SIN_SPEC.nx - 1}"""}))
def q_lc_mode_projected(spark, sf):
    """A lon/lat class raster onto a sinusoidal grid by the mode."""
    return lc_to_grid(fx.lc_fine(spark, sf), fx.LC_SPEC, SIN_SPEC)


@register("lc_labels", with_fixtures(
    f"SELECT iy, ix, lc_code, {label_case()} AS lc_label FROM lcg", LC_CTES))
def q_lc_labels(spark, sf):
    return with_labels(lc_grid(spark, sf)).select("iy", "ix", "lc_code", "lc_label")


@register("lc_classes", with_fixtures(
    "SELECT DISTINCT lc_code FROM lcg WHERE lc_code IS NOT NULL", LC_CTES))
def q_lc_classes(spark, sf):
    return lc_classes(lc_grid(spark, sf))


ZONAL_SQL = """
SELECT l.lc_code, coalesce(sum(t.value), 0.0) AS gpp_sum
FROM lcg l LEFT JOIN t ON l.iy = t.iy AND l.ix = t.ix
WHERE l.lc_code IS NOT NULL GROUP BY l.lc_code"""


def _zonal_ctes():
    return {**LC_CTES, "t": TEMPORAL_SUM_SQL, "z": ZONAL_SQL}


@register("zonal_sum", with_fixtures("SELECT * FROM z", _zonal_ctes()))
def q_zonal_sum(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    return zonal_sum(g, lc_grid(spark, sf))


def share_sql(excluded: list[str]) -> str:
    where = ("WHERE " + label_case() + " NOT IN (" + ", ".join(f"'{e}'" for e in excluded) + ")"
             if excluded else "")
    return f"""
SELECT lc_code, lc_label, gpp_sum,
       round_even(gpp_sum / sum(gpp_sum) OVER () * 100.0, 1) AS percentage
FROM (SELECT lc_code, {label_case()} AS lc_label, gpp_sum FROM z {where}) s"""


@register("zonal_share", with_fixtures(share_sql([]), _zonal_ctes()))
def q_zonal_share(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    return zonal_share(zonal_sum(g, lc_grid(spark, sf)))


@register("zonal_exclude", with_fixtures(share_sql(EXCLUDED), _zonal_ctes()))
def q_zonal_exclude(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    return zonal_share(zonal_sum(g, lc_grid(spark, sf)), EXCLUDED)


@register("zonal_share_mean", with_fixtures(
    "SELECT lc_code, lc_label, round(gpp_sum + 3.725290298461914e-09, 6) AS gpp_sum, percentage FROM zs", {
        **LC_CTES, "t": TEMPORAL_SUM_SQL.replace("coalesce(sum(value), 0.0)", "avg(value)"),
        "z": ZONAL_SQL, "zs": share_sql([])}))
def q_zonal_share_mean(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    return r6(zonal_share(zonal_sum(g, lc_grid(spark, sf))), "gpp_sum")


@register("zonal_share_by_date", with_fixtures("""
SELECT p.date, p.lc_code, """ + label_case("p.lc_code") + """ AS lc_label,
       coalesce(s.gpp_sum, 0.0) AS gpp_sum,
       round_even(coalesce(s.gpp_sum, 0.0) / sum(coalesce(s.gpp_sum, 0.0)) OVER (PARTITION BY p.date) * 100.0, 1)
         AS percentage
FROM (SELECT d.date, c.lc_code FROM (SELECT DISTINCT date FROM cells) d,
                                    (SELECT DISTINCT lc_code FROM lcg WHERE lc_code IS NOT NULL) c) p
LEFT JOIN (SELECT c.date, l.lc_code, sum(c.value) AS gpp_sum
           FROM cells c JOIN lcg l ON c.iy = l.iy AND c.ix = l.ix
           WHERE l.lc_code IS NOT NULL GROUP BY c.date, l.lc_code) s
  ON s.date = p.date AND s.lc_code = p.lc_code""", LC_CTES))
def q_zonal_share_by_date(spark, sf):
    """Shares per composite date; a class with no value on a date has 0."""
    g = fx.cells(spark, sf).select("date", "iy", "ix", "value")
    keys = ("date",)
    return zonal_share(zonal_sum(g, lc_grid(spark, sf), keys), keys=keys)
