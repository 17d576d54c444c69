"""Queries on the large fixture grid (523 x 1021 cells, sparse): the same
operators on a grid whose size grows with the scale factor.  These are the
headline queries of the benchmark."""

from __future__ import annotations

import math

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_reproject import bilinear_sql
from gridfold.catalog.registry import r6, register
from gridfold.functions.projection import R_SINUSOIDAL
from gridfold.model import SINUSOIDAL, GridSpec
from gridfold.operators.coarsen import summarise
from gridfold.operators.points import sample_nearest, sample_window
from gridfold.operators.reproject import reproject_bilinear, target_grid
from gridfold.operators.select import select_range
from gridfold.operators.stats import STAT_ORDER, grid_stats, profile
from gridfold.operators.temporal import temporal_reduce
from gridfold.plans.jobs import point_series
from gridfold.sources import fixtures as fx

BIG = fx.BIG_SPEC
_M = R_SINUSOIDAL * math.pi / 180.0
# The big grid read as a sinusoidal grid spanning most of the globe (its
# north-west and east corners fall outside the projection's valid region).
BIG_SIN = GridSpec(x0=-100.0 * _M, y0=65.0 * _M, dx=0.2 * _M, dy=0.25 * _M,
                   nx=BIG.nx, ny=BIG.ny, crs=SINUSOIDAL)
K = 8


def big_block_sql(k: int, src: str) -> str:
    ny, nx = (BIG.ny // k) * k, (BIG.nx // k) * k
    return f"""SELECT CAST(floor(iy/{k}) AS INT) AS biy, CAST(floor(ix/{k}) AS INT) AS bix, *
               FROM {src} WHERE iy < {ny} AND ix < {nx}"""


def big_coords_sql(k: int) -> str:
    d = 0.5 * k
    return (f"CAST(CAST(61.0 AS DOUBLE) - (biy + 0.5) * {d} AS DOUBLE) AS y, "
            f"CAST(CAST(10.0 AS DOUBLE) + (bix + 0.5) * {d} AS DOUBLE) AS x")


@register("big_temporal_mean", with_fixtures(
    "SELECT iy, ix, y, x, round(avg(value) + 3.725290298461914e-09, 6) AS value FROM cells_big GROUP BY iy, ix, y, x"))
def q_big_temporal_mean(spark, sf):
    return r6(temporal_reduce(fx.cells_big(spark, sf), "mean", BIG), "value")


@register("big_summarise_mean", with_fixtures(f"""
SELECT biy AS iy, bix AS ix, {big_coords_sql(K)}, round(avg(value) + 3.725290298461914e-09, 6) AS value
FROM ({big_block_sql(K, 't')}) b GROUP BY biy, bix""", {
    "t": "SELECT iy, ix, avg(value) AS value FROM cells_big GROUP BY iy, ix"}))
def q_big_summarise_mean(spark, sf):
    return r6(summarise(fx.cells_big(spark, sf), "mean", K, BIG, "banded"), "value")


@register("big_range_stats", with_fixtures(f"""
SELECT round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min, round(max(value) + 3.725290298461914e-09, 6) AS max,
       round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM (SELECT avg(value) AS value FROM ({big_block_sql(K, 't')}) b GROUP BY biy, bix) s""", {
    "t": "SELECT iy, ix, avg(value) AS value FROM cells_big "
         "WHERE date BETWEEN DATE '2020-01-09' AND DATE '2020-02-10' GROUP BY iy, ix"}))
def q_big_range_stats(spark, sf):
    sel = select_range(fx.cells_big(spark, sf), "2020-01-09", "2020-02-10")
    return r6(grid_stats(summarise(sel, "mean", K, BIG, "banded")), *STAT_ORDER)


@register("big_profile_sum", with_fixtures(
    "SELECT y, coalesce(sum(value), 0.0) AS value FROM "
    "(SELECT y, coalesce(sum(value), 0.0) AS value FROM cells_big GROUP BY iy, ix, y) t GROUP BY y"))
def q_big_profile_sum(spark, sf):
    return profile(temporal_reduce(fx.cells_big(spark, sf), "sum", BIG), "sum")


def big_point_index_sql(tie: str) -> str:
    v = "((CAST(61.0 AS DOUBLE) - y) / 0.5 - 0.5)"
    u = "((x - CAST(10.0 AS DOUBLE)) / 0.5 - 0.5)"
    iy = f"ceil({v} - 0.5)" if tie == "coord" else f"floor({v} + 0.5)"
    return f"""SELECT point_id, station,
       CAST(least(greatest({iy}, 0), {BIG.ny - 1}) AS INT) AS iy,
       CAST(least(greatest(floor({u} + 0.5), 0), {BIG.nx - 1}) AS INT) AS ix FROM points"""


@register("big_point_nearest", with_fixtures("""
SELECT p.point_id, p.station, d.date, c.value, c.qflag
FROM pn p CROSS JOIN (SELECT DISTINCT date FROM cells_big) d
LEFT JOIN cells_big c ON c.iy = p.iy AND c.ix = p.ix AND c.date = d.date""", {"pn": big_point_index_sql("coord")}))
def q_big_point_nearest(spark, sf):
    return sample_nearest(fx.cells_big(spark, sf), fx.points(spark, sf), BIG)


def big_window_sql(b: int, src: str = "cells_big", edge: str = "truncate") -> str:
    """Windows joined by ranges, then completed to every station and date."""
    cond = f"AND p.iy >= {b} AND p.ix >= {b}" if edge == "reference" else ""
    return f"""
SELECT p.point_id, p.station, d.date, m.value, m.qflag
FROM pi p CROSS JOIN (SELECT DISTINCT date FROM {src}) d
LEFT JOIN (SELECT p.point_id, c.date, round(avg(c.value) + 3.725290298461914e-09, 6) AS value,
                  round(avg(c.qflag) + 3.725290298461914e-09, 6) AS qflag
           FROM pi p JOIN {src} c ON c.iy BETWEEN p.iy - {b} AND p.iy + {b} AND c.ix BETWEEN p.ix - {b} AND p.ix + {b} {cond}
           GROUP BY p.point_id, c.date) m ON m.point_id = p.point_id AND m.date = d.date"""


@register("point_window_large", with_fixtures(big_window_sql(40, edge="reference"), {"pi": big_point_index_sql("index")}))
def q_point_window_large(spark, sf):
    """Windows of 81 x 81 cells: a point stays at most four join rows."""
    out = sample_window(fx.cells_big(spark, sf), fx.points(spark, sf), BIG, 40, edge="reference")
    return r6(out, "value", "qflag")


@register("point_series_all", with_fixtures(f"""
SELECT point_id, station, date AS time, value AS data_value, qflag AS quality_flag
FROM ({big_window_sql(1)}) s WHERE date BETWEEN DATE '2020-01-09' AND DATE '2020-02-02'""", {
    "pi": big_point_index_sql("index")}))
def q_point_series_all(spark, sf):
    """The series job: one row for each station and date of the range."""
    out = point_series(fx.cells_big(spark, sf), BIG, fx.points(spark, sf), "2020-01-09", "2020-02-02",
                       buffer=1, flag_quality=True)
    return r6(out, "data_value", "quality_flag")


@register("big_point_window", with_fixtures(big_window_sql(2), {"pi": big_point_index_sql("index")}))
def q_big_point_window(spark, sf):
    out = sample_window(fx.cells_big(spark, sf), fx.points(spark, sf), BIG, 2)
    return r6(out, "value", "qflag")


BIG_DST = target_grid(BIG_SIN.coarsened(4))


@register("big_reproject", with_fixtures(
    "SELECT iy, ix, y, x, round(value + 3.725290298461914e-09, 6) AS value FROM b", {
        "t": "SELECT iy, ix, avg(value) AS value FROM cells_big GROUP BY iy, ix",
        "src": f"SELECT biy AS iy, bix AS ix, avg(value) AS value FROM ({big_block_sql(4, 't')}) q "
               "GROUP BY biy, bix",
        "b": bilinear_sql(BIG_SIN.coarsened(4), BIG_DST)}))
def q_big_reproject(spark, sf):
    product = summarise(fx.cells_big(spark, sf), "mean", 4, BIG_SIN, "banded")
    return r6(reproject_bilinear(product, BIG_SIN.coarsened(4), BIG_DST), "value")
