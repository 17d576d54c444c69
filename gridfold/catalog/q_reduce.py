"""Queries: time reductions, coarsening, presets, statistics, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.registry import r6, register
from gridfold.operators.coarsen import coarsen, summarise
from gridfold.operators.select import mask_display, select_range
from gridfold.operators.stats import (display_norm, display_range, grid_extent,
                                      grid_stats, profile,
                                      quick_stats, stats_long, STAT_ORDER)
from gridfold.operators.temporal import temporal_reduce, tile_temporal, yearly_sum_mean
from gridfold.sources import fixtures as fx

SPEC = fx.CELLS_SPEC

# -- SQL helpers ---------------------------------------------------------------
# Block centre of a k-block on the 0.5 degree fixture grid (x0=10, y0=61).
def block_sql(k: int, src: str = "g", where: str = "") -> str:
    ny, nx = (SPEC.ny // k) * k, (SPEC.nx // k) * k
    return f"""
  SELECT CAST(floor(iy/{k}) AS INT) AS biy, CAST(floor(ix/{k}) AS INT) AS bix, *
  FROM {src} WHERE iy < {ny} AND ix < {nx} {where}"""


def coords_sql(k: int, iy: str = "iy", ix: str = "ix") -> str:
    d = 0.5 * k
    return (f"CAST(CAST(61.0 AS DOUBLE) - ({iy} + 0.5) * {d} AS DOUBLE) AS y, "
            f"CAST(CAST(10.0 AS DOUBLE) + ({ix} + 0.5) * {d} AS DOUBLE) AS x")


TEMPORAL_MEAN_SQL = "SELECT iy, ix, y, x, avg(value) AS value FROM cells GROUP BY iy, ix, y, x"
TEMPORAL_SUM_SQL = ("SELECT iy, ix, y, x, coalesce(sum(value), 0.0) AS value "
                    "FROM cells GROUP BY iy, ix, y, x")


# -- G1 / G2 / G3 ---------------------------------------------------------------
@register("temporal_mean", with_fixtures(
    "SELECT iy, ix, y, x, round(avg(value) + 3.725290298461914e-09, 6) AS value FROM cells GROUP BY iy, ix, y, x"))
def q_temporal_mean(spark, sf):
    return r6(temporal_reduce(fx.cells(spark, sf), "mean", SPEC), "value")


@register("temporal_sum", with_fixtures(TEMPORAL_SUM_SQL))
def q_temporal_sum(spark, sf):
    return temporal_reduce(fx.cells(spark, sf), "sum", SPEC)


@register("tile_temporal", with_fixtures(
    "SELECT tile, iy, ix, y, x, round(avg(value) + 3.725290298461914e-09, 6) AS value FROM cells GROUP BY tile, iy, ix, y, x"))
def q_tile_temporal(spark, sf):
    return r6(tile_temporal(fx.cells(spark, sf), "mean", SPEC), "value")


# -- G4 / G5 / G6: per-date 4 x 4 blocks ---------------------------------------
def _per_date_block_sql(agg: str) -> str:
    e = {"mean": "round(avg(value) + 3.725290298461914e-09, 6)", "sum": "coalesce(sum(value), 0.0)", "max": "max(value)"}[agg]
    return with_fixtures(f"""
SELECT date, biy AS iy, bix AS ix, {coords_sql(4, 'biy', 'bix')}, {e} AS value
FROM ({block_sql(4, 'cells')}) b
GROUP BY date, biy, bix""")


def _per_date_block(agg):
    def q(spark, sf):
        out = coarsen(fx.cells(spark, sf), 4, agg, SPEC, keys=("date",))
        return r6(out, "value") if agg == "mean" else out
    return q


for _agg in ("mean", "sum", "max"):
    register(f"coarsen_{_agg}", _per_date_block_sql(_agg))(_per_date_block(_agg))


# -- G7 presets: time reduction then 4 x 4 blocks -------------------------------
def _preset_sql(time_op: str, block_op: str) -> str:
    t = "avg(value)" if time_op == "mean" else "coalesce(sum(value), 0.0)"
    b = {"mean": "round(avg(value) + 3.725290298461914e-09, 6)", "sum": "coalesce(sum(value), 0.0)",
         "max": "round(max(value) + 3.725290298461914e-09, 6)"}[block_op]
    return with_fixtures(f"""
SELECT biy AS iy, bix AS ix, {coords_sql(4, 'biy', 'bix')}, {b} AS value
FROM ({block_sql(4, 't')}) b
GROUP BY biy, bix""", {"t": f"SELECT iy, ix, {t} AS value FROM cells GROUP BY iy, ix"})


def _preset(operator, preset):
    def q(spark, sf):
        return r6(summarise(fx.cells(spark, sf), operator, 4, SPEC, preset), "value")
    return q


for (_op, _preset_name), (_t, _b) in {("mean", "banded"): ("mean", "mean"),
                                      ("mean", "flat"): ("mean", "max"),
                                      ("sum", "banded"): ("sum", "sum"),
                                      ("sum", "flat"): ("sum", "max")}.items():
    register(f"summarise_{_op}_{_preset_name}", _preset_sql(_t, _b))(_preset(_op, _preset_name))


@register("summarise_only", with_fixtures(f"""
SELECT date, biy AS iy, bix AS ix, {coords_sql(4, 'biy', 'bix')}, max(value) AS value
FROM ({block_sql(4, 'cells')}) b
GROUP BY date, biy, bix"""))
def q_summarise_only(spark, sf):
    return summarise(fx.cells(spark, sf), "only_plot", 4, SPEC)


# -- G8 profiles of the temporal mean -------------------------------------------
@register("profile_sum", with_fixtures(
    "SELECT y, round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS value FROM t GROUP BY y",
    {"t": TEMPORAL_MEAN_SQL}))
def q_profile_sum(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    return r6(profile(g, "sum"), "value")


@register("profile_mean", with_fixtures(
    "SELECT y, round(coalesce(avg(value), 0.0) + 3.725290298461914e-09, 6) AS value FROM t GROUP BY y",
    {"t": TEMPORAL_MEAN_SQL}))
def q_profile_mean(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    return r6(profile(g, "mean"), "value")


# -- G12 / G12a / K5 / G13 / G14 / C11 / F7 -------------------------------------
STATS_SQL = """
SELECT round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min, round(max(value) + 3.725290298461914e-09, 6) AS max,
       round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM t"""


@register("grid_stats", with_fixtures(STATS_SQL, {"t": TEMPORAL_SUM_SQL}))
def q_grid_stats(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    return r6(grid_stats(g), *STAT_ORDER)


@register("stats_long", with_fixtures("""
SELECT ord, stat, round(value + 3.725290298461914e-09, 6) AS value FROM (
  SELECT 0 AS ord, 'mean' AS stat, avg(value) AS value FROM t UNION ALL
  SELECT 1, 'min', min(value) FROM t UNION ALL
  SELECT 2, 'max', max(value) FROM t UNION ALL
  SELECT 3, 'sum', coalesce(sum(value), 0.0) FROM t UNION ALL
  SELECT 4, 'std', stddev_pop(value) FROM t UNION ALL
  SELECT 5, 'var', var_pop(value) FROM t) s""", {"t": TEMPORAL_SUM_SQL}))
def q_stats_long(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    return r6(stats_long(grid_stats(g)), "value")


@register("quick_stats", with_fixtures("""
SELECT date, min(value) AS min, round(avg(value) + 3.725290298461914e-09, 6) AS mean, max(value) AS max
FROM cells GROUP BY date"""))
def q_quick_stats(spark, sf):
    return r6(quick_stats(fx.cells(spark, sf), keys=("date",)), "mean")


@register("grid_extent", with_fixtures("""
SELECT date, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
       min(x) - 0.25 AS west, max(x) + 0.25 AS east,
       min(y) - 0.25 AS south, max(y) + 0.25 AS north,
       count(DISTINCT x) AS n_x, count(DISTINCT y) AS n_y, count(*) AS n_cells
FROM cells WHERE value IS NOT NULL GROUP BY date"""))
def q_grid_extent(spark, sf):
    c = fx.cells(spark, sf).where(F.col("value").isNotNull())
    return grid_extent(c, SPEC, keys=("date",))


@register("display_range", with_fixtures("""
SELECT 'standard' AS plot_type, CAST(0.0001 AS DOUBLE) AS vmin,
       CAST(ceil(greatest(max(value) * 0.75, avg(value))) AS DOUBLE) AS vmax FROM t
UNION ALL
SELECT 'difference', -CAST(ceil(greatest(abs(min(value) - 40.0) * 0.75, abs(max(value) - 40.0) * 0.75)) AS DOUBLE),
       CAST(ceil(greatest(abs(min(value) - 40.0) * 0.75, abs(max(value) - 40.0) * 0.75)) AS DOUBLE) FROM t
UNION ALL
SELECT 'given', CAST(0.0001 AS DOUBLE), CAST(40.0 AS DOUBLE)""", {"t": TEMPORAL_MEAN_SQL}))
def q_display_range(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    std = display_range(quick_stats(g), "standard", max_factor=0.75)
    diff = display_range(quick_stats(g.withColumn("value", F.col("value") - 40.0)),
                         "difference", max_factor=0.75)
    given = display_range(quick_stats(g), "standard", vmax=40.0)
    return (std.select(F.lit("standard").alias("plot_type"), "vmin", "vmax")
            .unionByName(diff.select(F.lit("difference").alias("plot_type"), "vmin", "vmax"))
            .unionByName(given.select(F.lit("given").alias("plot_type"), "vmin", "vmax")))


@register("mask_display", with_fixtures("""
SELECT date, iy, ix, CASE WHEN value > 0.0001 THEN value END AS value FROM cells"""))
def q_mask_display(spark, sf):
    return mask_display(fx.cells(spark, sf)).select("date", "iy", "ix", "value")


@register("display_norm", with_fixtures("""
SELECT iy, ix, round(CASE WHEN v IS NULL THEN NULL
                          ELSE least(greatest((v - 0.0001) / (r.vmax - 0.0001), 0.0), 1.0) END + 3.725290298461914e-09, 6) AS norm
FROM (SELECT iy, ix, CASE WHEN value > 0.0001 THEN value END AS v FROM t) m,
     (SELECT CAST(ceil(greatest(max(value), avg(value))) AS DOUBLE) AS vmax FROM t) r""",
    {"t": TEMPORAL_MEAN_SQL}))
def q_display_norm(spark, sf):
    g = temporal_reduce(fx.cells(spark, sf), "mean", SPEC)
    limits = display_range(quick_stats(g), "standard")
    return r6(display_norm(mask_display(g), limits).select("iy", "ix", "norm"), "norm")


# -- G15 two-level roll-up over years --------------------------------------------
YEARS_SQL = """
SELECT make_date(CAST(year(date) + (ix + 3*iy + dayofyear(date)) % 4 AS BIGINT),
                 CAST(month(date) AS BIGINT), CAST(day(date) AS BIGINT)) AS date,
       tile, iy, ix, y, x, value, qflag FROM cells"""


def years_cells(spark, sf):
    return spread_over_years(fx.cells(spark, sf))


def spread_over_years(c):
    """The cell stack spread over four years (2020-2023) by a rule of the
    cell and day, so every cell has a different set of years."""
    shift = (F.col("ix") + 3 * F.col("iy") + F.dayofyear("date")) % 4
    return c.withColumn("date", F.make_date(F.year("date") + shift, F.month("date"),
                                            F.dayofmonth("date")))


@register("yearly_sum_mean", with_fixtures("""
SELECT iy, ix, y, x, round(avg(s) + 3.725290298461914e-09, 6) AS value, count(*) AS n_years FROM (
  SELECT iy, ix, y, x, year(date) AS yr, coalesce(sum(value), 0.0) AS s
  FROM cy GROUP BY iy, ix, y, x, year(date)) t
GROUP BY iy, ix, y, x""", {"cy": YEARS_SQL}))
def q_yearly_sum_mean(spark, sf):
    return r6(yearly_sum_mean(years_cells(spark, sf), SPEC), "value")


# -- flagship: mean map of a period at 4x coarser cells, with its statistics ----
@register("range_mean_coarse_stats", with_fixtures(STATS_SQL, {
    "t0": "SELECT iy, ix, avg(value) AS value FROM cells "
          "WHERE date BETWEEN DATE '2020-01-09' AND DATE '2020-02-10' GROUP BY iy, ix",
    "t": f"SELECT biy, bix, avg(value) AS value FROM ({block_sql(4, 't0')}) b GROUP BY biy, bix"}))
def q_range_mean_coarse_stats(spark, sf):
    return flagship(fx.cells(spark, sf))


def flagship(cells):
    sel = select_range(cells, "2020-01-09", "2020-02-10")
    product = summarise(sel, "mean", 4, SPEC, "banded")
    return r6(grid_stats(product), *STAT_ORDER)
