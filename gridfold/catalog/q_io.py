"""Queries: sinks written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_landcover import EXCLUDED, LC_CTES, ZONAL_SQL, share_sql, lc_grid
from gridfold.catalog.q_points import point_index_sql, window_sql
from gridfold.catalog.q_reduce import TEMPORAL_MEAN_SQL, TEMPORAL_SUM_SQL
from gridfold.catalog.registry import r6, register
from gridfold.operators.landcover import zonal_share, zonal_sum
from gridfold.operators.points import sample_window
from gridfold.operators.stats import grid_stats, profile
from gridfold.operators.temporal import temporal_reduce
from gridfold.catalog.q_select import ranges_values_sql
from gridfold.plans.jobs import point_series, range_summary
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import (read_series_csv, write_cells, write_profile_csv,
                                    write_series_csv, write_stats_text, write_zonal_csv)
from gridfold.sources.store import read_cells

SPEC = fx.CELLS_SPEC

ROUNDTRIP_SQL = """
SELECT date, tile, iy, ix, y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
       CAST(CAST(qflag AS FLOAT) AS DOUBLE) AS qflag FROM cells"""


def saved_cells(spark, sf):
    return write_cells(fx.cells(spark, sf), scratch_path(spark, "cells"))


@register("roundtrip_cells", with_fixtures(ROUNDTRIP_SQL))
def q_roundtrip_cells(spark, sf):
    return read_cells(spark, saved_cells(spark, sf))


@register("read_saved", with_fixtures(
    "SELECT * FROM rt WHERE date BETWEEN DATE '2020-01-09' AND DATE '2020-01-25'",
    {"rt": ROUNDTRIP_SQL}))
def q_read_saved(spark, sf):
    return read_cells(spark, saved_cells(spark, sf), start="2020-01-09", end="2020-01-25")


@register("series_csv", with_fixtures("""
SELECT p.point_id, p.station, d.date AS time, c.value AS data_value, c.qflag AS quality_flag
FROM pn p CROSS JOIN (SELECT DISTINCT date FROM cells) d
LEFT JOIN cells c ON c.iy = p.iy AND c.ix = p.ix AND c.date = d.date""", {"pn": point_index_sql("coord")}))
def q_series_csv(spark, sf):
    s = point_series(fx.cells(spark, sf), SPEC, fx.points(spark, sf), flag_quality=True)
    path = write_series_csv(s, scratch_path(spark, "series"))
    return read_series_csv(spark, path, "point_id BIGINT, time DATE, data_value DOUBLE, "
                                        "quality_flag DOUBLE, station STRING")


@register("profile_csv", with_fixtures(
    "SELECT y, round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS value FROM t GROUP BY y",
    {"t": TEMPORAL_MEAN_SQL}))
def q_profile_csv(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    path = write_profile_csv(profile(g, "sum"), scratch_path(spark, "profile"))
    df = spark.read.schema("y DOUBLE, value DOUBLE").option("header", True).csv(path)
    return r6(df, "value")


@register("zonal_csv", with_fixtures("SELECT * FROM zs", {
    **LC_CTES, "t": TEMPORAL_SUM_SQL, "z": ZONAL_SQL, "zs": share_sql(EXCLUDED)}))
def q_zonal_csv(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    shares = zonal_share(zonal_sum(g, lc_grid(spark, sf)), EXCLUDED)
    path = write_zonal_csv(shares, scratch_path(spark, "zonal"))
    return (spark.read.schema("lc_code INT, lc_label STRING, gpp_sum DOUBLE, percentage DOUBLE")
            .option("header", True).csv(path))


@register("stats_text")
def q_stats_text(spark, sf):
    """Six ``key: value`` lines (number formatting is engine-specific, so
    this one is checked by rows only)."""
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    path = write_stats_text(grid_stats(g), scratch_path(spark, "stats"))
    return spark.read.text(path)


@register("stats_text_parsed", with_fixtures("""
SELECT stat, round(value + 3.725290298461914e-09, 6) AS value FROM (
  SELECT unnest(['mean', 'min', 'max', 'sum', 'std', 'var']) AS stat,
         unnest([avg(value), min(value), max(value), sum(value), stddev_pop(value), var_pop(value)]) AS value
  FROM (SELECT coalesce(sum(value), 0.0) AS value FROM cells GROUP BY iy, ix) t) s"""))
def q_stats_text_parsed(spark, sf):
    """The statistics text read back as names and numbers."""
    line = F.split("value", ": ")
    return r6(q_stats_text(spark, sf).select(F.get(line, F.lit(0)).alias("stat"),
                                             F.get(line, F.lit(1)).cast("double").alias("value")), "value")


@register("window_cells", with_fixtures(
    "SELECT point_id, station, date, value, qflag FROM w",
    {"pi": point_index_sql("index"), "w": window_sql(1, "truncate")}))
def q_window_cells(spark, sf):
    w = sample_window(fx.cells(spark, sf), fx.points(spark, sf), SPEC, 1)
    path = write_cells(w, scratch_path(spark, "window"), float32=False)
    df = read_cells(spark, path).select("point_id", "station", "date", "value", "qflag")
    return r6(df, "value", "qflag")


@register("range_save_stack", with_fixtures(f"""
SELECT c.date, c.tile, c.iy, c.ix, c.y, c.x, CAST(CAST(c.value AS FLOAT) AS DOUBLE) AS value,
       CAST(CAST(c.qflag AS FLOAT) AS DOUBLE) AS qflag, r.k
FROM cells c JOIN (VALUES {ranges_values_sql()}) r(k, s, e) ON c.date BETWEEN r.s AND r.e"""))
def q_range_save_stack(spark, sf):
    """The stack of overlapping ranges saved before the reduction (a date in
    two ranges is saved twice, tagged by range) and read back."""
    path = scratch_path(spark, "range-stack")
    range_summary(fx.cells(spark, sf), SPEC, fx.DATE_RANGES, "sum", 4, save_path=path,
                  stop_after_save=True)
    return read_cells(spark, path)
