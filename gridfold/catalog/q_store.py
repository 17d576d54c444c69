"""Queries over a written cell store (Parquet, partitioned by date, float32
values): the way the library is used at scale.  Each registered query
writes the big fixture grid to the shared folder first; the benchmark
writes it once and times the reads."""

from __future__ import annotations

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_big import BIG, big_point_index_sql, big_block_sql, big_coords_sql, big_window_sql
from gridfold.catalog.registry import r6, register
from gridfold.operators.stats import STAT_ORDER, merge_moments, moments
from gridfold.plans.jobs import Crop, composite_summary, grid_summary, point_series
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import write_cells
from gridfold.sources.store import read_cells

K = 8
BOX = Crop(lon_min=60.0, lon_max=400.0, lat_min=-150.0, lat_max=40.0)
START, END = "2020-01-09", "2020-02-02"
DATES = ["2020-01-17", "2020-02-10"]
F32 = "CAST(CAST(value AS FLOAT) AS DOUBLE)"


def big_store(spark, sf) -> str:
    return write_cells(fx.cells_big(spark, sf), scratch_path(spark, "big-store"))


def range_summary_on(spark, store):
    cells = read_cells(spark, store, start=START, end=END)
    return r6(grid_summary(cells, BIG, "mean", "banded", K, BOX, persist=False).stats, *STAT_ORDER)


def point_series_on(spark, store, points):
    cells = read_cells(spark, store)
    out = point_series(cells, BIG, points, START, END, buffer=1, flag_quality=True)
    return r6(out, "data_value", "quality_flag")


def composite_summary_on(spark, store):
    _, stats = composite_summary(read_cells(spark, store), BIG, DATES, k=K)
    return r6(stats, *STAT_ORDER)


STORE_CTE = {"st": f"SELECT date, iy, ix, {F32} AS value, CAST(CAST(qflag AS FLOAT) AS DOUBLE) AS qflag "
                   "FROM cells_big"}


@register("store_range_summary", with_fixtures(f"""
SELECT round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min, round(max(value) + 3.725290298461914e-09, 6) AS max,
       round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM (SELECT {big_coords_sql(K)}, avg(value) AS value FROM ({big_block_sql(K, 't')}) b GROUP BY biy, bix) p
WHERE x BETWEEN 60.0 AND 400.0 AND y BETWEEN -150.0 AND 40.0""", {
    **STORE_CTE,
    "t": f"SELECT iy, ix, avg(value) AS value FROM st "
         f"WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY iy, ix"}))
def q_store_range_summary(spark, sf):
    return range_summary_on(spark, big_store(spark, sf))


@register("store_point_series", with_fixtures(f"""
SELECT point_id, station, date AS time, value AS data_value, qflag AS quality_flag
FROM ({big_window_sql(1, "st")}) s WHERE date BETWEEN DATE '{START}' AND DATE '{END}'""", {
    **STORE_CTE, "pi": big_point_index_sql("index")}))
def q_store_point_series(spark, sf):
    return point_series_on(spark, big_store(spark, sf), fx.points(spark, sf))


@register("store_composite_summary", with_fixtures(f"""
SELECT ord, date, round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min,
       round(max(value) + 3.725290298461914e-09, 6) AS max, round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM (SELECT ord, date, max(value) AS value FROM ({big_block_sql(K, 'sel')}) q
      GROUP BY ord, date, biy, bix) b
GROUP BY ord, date""", {
    **STORE_CTE,
    "sel": f"""SELECT c.*, r.ord FROM st c JOIN (VALUES {", ".join(
        f"({i}, DATE '{d}')" for i, d in enumerate(DATES))}) r(ord, d) ON c.date = r.d"""}))
def q_store_composite_summary(spark, sf):
    return composite_summary_on(spark, big_store(spark, sf))


# -- bucketed (co-located) store ----------------------------------------------
BUCKET_BLOCK = 64


def bucketed_store(spark, sf) -> str:
    import uuid
    from gridfold.sources.sinks import write_cells_bucketed
    table = f"gridfold_cells_{uuid.uuid4().hex[:10]}"
    return write_cells_bucketed(fx.cells_big(spark, sf), table, BIG,
                                scratch_path(spark, "bucketed-store"), block=BUCKET_BLOCK)


def summarise_on(spark, store):
    """The same product over the date-partitioned (not bucketed) store."""
    from gridfold.operators.coarsen import summarise
    cells = read_cells(spark, store, start=START, end=END)
    return r6(summarise(cells, "mean", K, BIG, "banded"), "value")


def bucketed_summarise_on(spark, table):
    from gridfold.operators.coarsen import summarise
    from gridfold.sources.store import read_bucketed
    cells = read_bucketed(spark, table, start=START, end=END)
    return r6(summarise(cells, "mean", K, BIG, "banded", bucket_block=BUCKET_BLOCK), "value")


@register("bucketed_summarise", with_fixtures(f"""
SELECT biy AS iy, bix AS ix, {big_coords_sql(K)}, round(avg(value) + 3.725290298461914e-09, 6) AS value
FROM ({big_block_sql(K, 't')}) b GROUP BY biy, bix""", {
    **STORE_CTE,
    "t": f"SELECT iy, ix, avg(value) AS value FROM st "
         f"WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY iy, ix"}))
def q_bucketed_summarise(spark, sf):
    """Time mean of a date range and 8 x 8 blocks over a store bucketed by
    64 x 64 blocks: no shuffle at all."""
    return bucketed_summarise_on(spark, bucketed_store(spark, sf))


@register("range_stats_from_partials", with_fixtures(f"""
SELECT round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min, round(max(value) + 3.725290298461914e-09, 6) AS max,
       round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM st WHERE date BETWEEN DATE '{START}' AND DATE '{END}'""", STORE_CTE))
def q_range_stats_from_partials(spark, sf):
    """Statistics of a date range from the partial statistics written with the
    store; its cells are not read."""
    from gridfold.operators.select import in_range
    path = scratch_path(spark, "big-moments")
    moments(read_cells(spark, big_store(spark, sf)), 64).write.partitionBy("date").parquet(path)
    return r6(merge_moments(spark.read.parquet(path).where(in_range(START, END))), *STAT_ORDER)
