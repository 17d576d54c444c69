"""Queries: points, nearest-cell and window sampling, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.registry import r6, register
from gridfold.functions.projection import R_SINUSOIDAL
from gridfold.model import SINUSOIDAL
from gridfold.operators.points import (sample_nearest, sample_nearest_irregular, sample_window,
                                       series, to_grid_crs)
from gridfold.plans.jobs import point_series
from gridfold.sources import fixtures as fx
from gridfold.sources.store import read_points

SPEC = fx.CELLS_SPEC


def point_index_sql(tie: str) -> str:
    v = "((CAST(61.0 AS DOUBLE) - y) / 0.5 - 0.5)"
    u = "((x - CAST(10.0 AS DOUBLE)) / 0.5 - 0.5)"
    iy = f"ceil({v} - 0.5)" if tie == "coord" else f"floor({v} + 0.5)"
    ix = f"floor({u} + 0.5)"
    return f"""
SELECT point_id, station,
       CAST(least(greatest({iy}, 0), {SPEC.ny - 1}) AS INT) AS iy,
       CAST(least(greatest({ix}, 0), {SPEC.nx - 1}) AS INT) AS ix
FROM points"""


# every station has a row for every date
NEAREST_SQL = """
SELECT p.point_id, p.station, d.date, c.value, c.qflag
FROM pn p CROSS JOIN (SELECT DISTINCT date FROM cells) d
LEFT JOIN cells c ON c.iy = p.iy AND c.ix = p.ix AND c.date = d.date"""


def window_sql(b: int, edge: str) -> str:
    offs = ", ".join(f"({i})" for i in range(-b, b + 1))
    cond = f"AND w.piy >= {b} AND w.pix >= {b}" if edge == "reference" else ""
    return f"""
SELECT w.point_id, w.station, d.date, round(avg(c.value) + 3.725290298461914e-09, 6) AS value,
       round(avg(c.qflag) + 3.725290298461914e-09, 6) AS qflag
FROM (SELECT p.point_id, p.station, p.iy AS piy, p.ix AS pix, p.iy + a.d AS iy, p.ix + b.d AS ix
      FROM pi p, (VALUES {offs}) a(d), (VALUES {offs}) b(d)) w
CROSS JOIN (SELECT DISTINCT date FROM cells) d
LEFT JOIN cells c ON c.iy = w.iy AND c.ix = w.ix AND c.date = d.date {cond}
GROUP BY w.point_id, w.station, d.date"""


def points_raw(spark, sf):
    """Stations as a user would give them: no name column, and customers
    with a negative balance have no location (empty geometry)."""
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    p = fx.points(spark, sf).join(c.withColumnRenamed("c_custkey", "point_id"), "point_id")
    return p.withColumn("x", F.when(F.col("c_acctbal") >= 0, F.col("x"))).drop("c_acctbal", "station")


@register("points_checked", with_fixtures("""
SELECT p.point_id, printf('point_%05d', p.point_id) AS station, p.x, p.y, p.crs
FROM points p JOIN customer c ON c.c_custkey = p.point_id WHERE c.c_acctbal >= 0"""))
def q_points_checked(spark, sf):
    return read_points(points_raw(spark, sf))


@register("points_reproject", with_fixtures(f"""
SELECT point_id, station,
       round({R_SINUSOIDAL!r} * radians(x) * cos(radians(y)), 4) AS x,
       round({R_SINUSOIDAL!r} * radians(y), 4) AS y, '{SINUSOIDAL}' AS crs
FROM points"""))
def q_points_reproject(spark, sf):
    p = to_grid_crs(fx.points(spark, sf), SINUSOIDAL)
    return p.withColumn("x", F.round("x", 4)).withColumn("y", F.round("y", 4))


@register("point_nearest", with_fixtures(NEAREST_SQL, {"pn": point_index_sql("coord")}))
def q_point_nearest(spark, sf):
    return sample_nearest(fx.cells(spark, sf), fx.points(spark, sf), SPEC)


@register("point_window", with_fixtures(window_sql(1, "truncate"), {"pi": point_index_sql("index")}))
def q_point_window(spark, sf):
    out = sample_window(fx.cells(spark, sf), fx.points(spark, sf), SPEC, 1)
    return r6(out, "value", "qflag")


@register("point_window_refedge", with_fixtures(window_sql(2, "reference"),
                                                {"pi": point_index_sql("index")}))
def q_point_window_refedge(spark, sf):
    out = sample_window(fx.cells(spark, sf), fx.points(spark, sf), SPEC, 2, edge="reference")
    return r6(out, "value", "qflag")


@register("series_pivot", with_fixtures("""
SELECT p.point_id, p.station, d.date AS time,
       max(CASE WHEN c.band = 1 THEN c.value END) AS data_value,
       max(CASE WHEN c.band = 2 THEN c.value END) AS quality_flag
FROM pn p CROSS JOIN (SELECT DISTINCT date FROM cells) d
LEFT JOIN cells_long c ON c.iy = p.iy AND c.ix = p.ix AND c.date = d.date
GROUP BY p.point_id, p.station, d.date""", {"pn": point_index_sql("coord")}))
def q_series_pivot(spark, sf):
    sampled = sample_nearest(fx.cells_long(spark, sf), fx.points(spark, sf), SPEC)
    return series(sampled, flag_value=True, flag_quality=True)


@register("point_series", with_fixtures("""
SELECT p.point_id, p.station, d.date AS time, round(c.value * 0.01 + 3.725290298461914e-09, 6) AS data_value,
       c.qflag AS quality_flag
FROM pn p CROSS JOIN (SELECT DISTINCT date FROM cells) d
LEFT JOIN cells c ON c.iy = p.iy AND c.ix = p.ix AND c.date = d.date
WHERE d.date BETWEEN DATE '2020-01-09' AND DATE '2020-02-02'""", {"pn": point_index_sql("coord")}))
def q_point_series(spark, sf):
    out = point_series(fx.cells(spark, sf), SPEC, fx.points(spark, sf), "2020-01-09",
                       "2020-02-02", scale_factor=0.01, flag_quality=True)
    return r6(out, "data_value")


@register("point_series_window", with_fixtures("""
SELECT point_id, station, date AS time, value AS data_value FROM w
WHERE date BETWEEN DATE '2020-01-09' AND DATE '2020-02-02'""",
    {"pi": point_index_sql("index"), "w": window_sql(1, "truncate")}))
def q_point_series_window(spark, sf):
    out = point_series(fx.cells(spark, sf), SPEC, fx.points(spark, sf), "2020-01-09",
                       "2020-02-02", buffer=1)
    return r6(out, "data_value")


# -- axes that are no regular grid -------------------------------------------
def gappy_cells(spark, sf):
    """The stack with whole rows and columns missing and uneven spacing."""
    c = fx.cells(spark, sf).where((F.col("ix") % 5 != 2) & (F.col("iy") % 7 != 3) & (F.col("ix") != 16))
    return c.withColumns({"y": F.col("y") + F.lit(0.125) * (F.col("iy") % 3),
                          "x": F.col("x") - F.lit(0.125) * (F.col("ix") % 2)})


GAPPY = {
    "g": """SELECT date, y + CAST(0.125 AS DOUBLE) * (iy % 3) AS y, x - CAST(0.125 AS DOUBLE) * (ix % 2) AS x, value, qflag
            FROM cells WHERE ix % 5 <> 2 AND iy % 7 <> 3 AND ix <> 16""",
    "ny": """SELECT p.point_id, a.v, row_number() OVER (PARTITION BY p.point_id ORDER BY abs(p.y - a.v), a.v DESC) AS r
             FROM points p CROSS JOIN (SELECT DISTINCT y AS v FROM g) a""",
    "nx": """SELECT p.point_id, a.v, row_number() OVER (PARTITION BY p.point_id ORDER BY abs(p.x - a.v), a.v DESC) AS r
             FROM points p CROSS JOIN (SELECT DISTINCT x AS v FROM g) a""",
}


def irregular_sql(far: float | None) -> str:
    close = f"AND abs(p.x - nx.v) <= {far} AND abs(p.y - ny.v) <= {far}" if far is not None else ""
    return with_fixtures(f"""
SELECT p.point_id, p.station, d.date, g.value, g.qflag
FROM points p JOIN ny ON ny.point_id = p.point_id AND ny.r = 1 JOIN nx ON nx.point_id = p.point_id AND nx.r = 1
CROSS JOIN (SELECT DISTINCT date FROM g) d
LEFT JOIN g ON g.y = ny.v AND g.x = nx.v AND g.date = d.date {close}""", GAPPY)


@register("point_nearest_irregular", irregular_sql(None))
def q_point_nearest_irregular(spark, sf):
    """Nearest cell on gappy, uneven axes (stations halfway between two go to
    the larger coordinate)."""
    return sample_nearest_irregular(gappy_cells(spark, sf), fx.points(spark, sf))


@register("point_nearest_max_distance", irregular_sql(0.25))
def q_point_nearest_max_distance(spark, sf):
    return sample_nearest_irregular(gappy_cells(spark, sf), fx.points(spark, sf), max_distance=0.25)


def _to_wkb(x, y):
    """(x, y) series -> little-endian WKB points (test-input construction)."""
    import struct
    import pandas as pd
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y)])


@register("points_wkb", with_fixtures("SELECT point_id, station, x, y, crs FROM points"))
def q_points_wkb(spark, sf):
    """Stations given as WKB point geometries (GeoParquet style) are decoded
    to coordinates; the result equals the coordinate table."""
    from pyspark.sql.functions import pandas_udf
    enc = pandas_udf(_to_wkb, "binary")
    geo = fx.points(spark, sf).select("point_id", "station", "crs",
                                      enc("x", "y").alias("geometry"))
    return read_points(geo, name_col="station", geometry_col="geometry")
