"""Queries: target resolution and bilinear reprojection.

The fixture grid is read as a sinusoidal grid (the tiles' projection): its
0.5 degree cells become 0.5 x (pi R / 180) metre cells, so reprojecting it
to longitude/latitude widens it towards the north-east."""

from __future__ import annotations

import math

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.registry import r6, register
from gridfold.functions.projection import R_SINUSOIDAL
from gridfold.model import SINUSOIDAL, GridSpec
from gridfold.operators.reproject import reproject_bilinear, target_grid, target_resolution_df
from gridfold.operators.stats import grid_extent
from gridfold.operators.temporal import temporal_reduce
from gridfold.sources import fixtures as fx

SPEC = fx.CELLS_SPEC
_M = R_SINUSOIDAL * math.pi / 180.0
SIN_SPEC = GridSpec(x0=10.0 * _M, y0=61.0 * _M, dx=0.5 * _M, dy=0.5 * _M,
                    nx=SPEC.nx, ny=SPEC.ny, crs=SINUSOIDAL)


def dbl(v: float) -> str:
    """A double literal that parses to exactly ``v``."""
    return f"CAST('{v!r}' AS DOUBLE)"


def bilinear_sql(src: GridSpec, dst: GridSpec, source_cte: str = "src",
                 keys: tuple[str, ...] = ()) -> str:
    """Bilinear resampling of ``source_cte`` (iy, ix, value) from a
    sinusoidal ``src`` to the lon/lat grid ``dst``, as SQL."""
    R = dbl(R_SINUSOIDAL)
    kc = "".join(f"s.{k}, " for k in keys)
    return f"""
SELECT {kc}tiy AS iy, tix AS ix,
       {dbl(dst.y0)} - (tiy + 0.5) * {dbl(dst.dy)} AS y,
       {dbl(dst.x0)} + (tix + 0.5) * {dbl(dst.dx)} AS x,
       sum(w * s.value) / sum(w) AS value
FROM (SELECT tiy, tix, j0 + dj AS iy, i0 + di AS ix,
             (CASE WHEN di = 1 THEN fu ELSE 1 - fu END) *
             (CASE WHEN dj = 1 THEN fv ELSE 1 - fv END) AS w
      FROM (SELECT tiy, tix, CAST(floor(u) AS INT) AS i0, CAST(floor(v) AS INT) AS j0,
                   u - floor(u) AS fu, v - floor(v) AS fv
            FROM (SELECT tiy, tix, (sx - {dbl(src.x0)}) / {dbl(src.dx)} - 0.5 AS u,
                         ({dbl(src.y0)} - sy) / {dbl(src.dy)} - 0.5 AS v
                  FROM (SELECT tiy, tix, {R} * radians(lon) * cos(radians(lat)) AS sx,
                               {R} * radians(lat) AS sy
                        FROM (SELECT CAST(i // {dst.nx} AS INT) AS tiy, CAST(i % {dst.nx} AS INT) AS tix,
                                     {dbl(dst.x0)} + (CAST(i % {dst.nx} AS INT) + 0.5) * {dbl(dst.dx)} AS lon,
                                     {dbl(dst.y0)} - (CAST(i // {dst.nx} AS INT) + 0.5) * {dbl(dst.dy)} AS lat
                              FROM range(0, {dst.nx * dst.ny}) r(i)) f) p) q
            WHERE u BETWEEN -0.5 AND {src.nx - 0.5} AND v BETWEEN -0.5 AND {src.ny - 0.5}) d,
           (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(di, dj)) e
JOIN {source_cte} s ON s.iy = e.iy AND s.ix = e.ix
WHERE w > 0 AND e.iy BETWEEN 0 AND {src.ny - 1} AND e.ix BETWEEN 0 AND {src.nx - 1}
  AND s.value IS NOT NULL
GROUP BY {kc}tiy, tix"""


SRC_MEAN_SQL = "SELECT iy, ix, avg(value) AS value FROM cells GROUP BY iy, ix"
DST = target_grid(SIN_SPEC)


def reprojected_mean(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SIN_SPEC)
    return reproject_bilinear(g, SIN_SPEC, DST)


@register("reproject_bilinear", with_fixtures(
    "SELECT iy, ix, y, x, round(value + 3.725290298461914e-09, 6) AS value FROM b",
    {"src": SRC_MEAN_SQL, "b": bilinear_sql(SIN_SPEC, DST)}))
def q_reproject_bilinear(spark, sf):
    return r6(reprojected_mean(spark, sf), "value")


EXTENT_SQL = """
SELECT min(x) - 0.25 AS west, max(x) + 0.25 AS east, min(y) - 0.25 AS south, max(y) + 0.25 AS north
FROM cells"""


@register("target_resolution", with_fixtures(f"""
SELECT CAST(abs(30.0 - 12.0) AS DOUBLE) AS extent_lon, abs(north - south) AS extent_lat,
       greatest(least(CAST(abs(30.0 - 12.0) AS DOUBLE) / {SPEC.nx}, abs(north - south) / {SPEC.ny}),
                greatest(CAST(abs(30.0 - 12.0) AS DOUBLE), abs(north - south)) / 1600.0) AS resolution
FROM e""", {"e": EXTENT_SQL}))
def q_target_resolution(spark, sf):
    e = grid_extent(fx.cells(spark, sf), SPEC)
    return target_resolution_df(e, SPEC.nx, SPEC.ny, lon_min=12.0, lon_max=30.0)


@register("target_resolution_full", with_fixtures(f"""
SELECT abs(east - west) AS extent_lon, abs(north - south) AS extent_lat,
       least(abs(east - west) / {SPEC.nx}, abs(north - south) / {SPEC.ny}) AS resolution
FROM e""", {"e": EXTENT_SQL}))
def q_target_resolution_full(spark, sf):
    e = grid_extent(fx.cells(spark, sf), SPEC)
    return target_resolution_df(e, SPEC.nx, SPEC.ny)
