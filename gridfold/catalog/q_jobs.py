"""Queries: the user-level jobs (summaries and composites)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_big import big_block_sql, big_coords_sql
from gridfold.catalog.q_landcover import label_case
from gridfold.catalog.q_reduce import STATS_SQL, YEARS_SQL, block_sql, coords_sql, spread_over_years
from gridfold.catalog.q_reproject import DST, SIN_SPEC, SRC_MEAN_SQL, bilinear_sql
from gridfold.catalog.q_select import DATE_REQUEST, ranges_values_sql
from gridfold.catalog.registry import r6, register
from gridfold.operators.stats import STAT_ORDER
from gridfold.operators.temporal import yearly_sum_mean
from gridfold.plans.jobs import (Crop, composite_report, composite_summary, grid_summary,
                                range_summary)
from gridfold.sources import fixtures as fx

SPEC, BIG = fx.CELLS_SPEC, fx.BIG_SPEC
BOX = Crop(lon_min=12.0, lon_max=28.0, lat_min=52.0, lat_max=60.0)
K = 2
FACTOR = 8.0
EXCLUDED = ["Permanent Water Bodies", "Built-up"]

# The summary product in SQL: temporal mean, 2 x 2 block mean, crop, x 8.
PRODUCT_CTES = {
    "t0": "SELECT iy, ix, avg(value) AS value FROM cells GROUP BY iy, ix",
    "b": f"""SELECT biy AS iy, bix AS ix, {coords_sql(K, 'biy', 'bix')}, avg(value) AS value
             FROM ({block_sql(K, 't0')}) q GROUP BY biy, bix""",
    "t": f"""SELECT iy, ix, y, x, value * {FACTOR} AS value FROM b
             WHERE x BETWEEN 12.0 AND 28.0 AND y BETWEEN 52.0 AND 60.0""",
}


def summary(spark, sf, with_lc: bool = False):
    lc = dict(lc=fx.lc_fine(spark, sf), lc_spec=fx.LC_SPEC, exclude_lc=tuple(EXCLUDED)) if with_lc else {}
    return grid_summary(fx.cells(spark, sf), SPEC, "mean", "banded", K, BOX,
                        value_factor=FACTOR, persist=False, **lc)


@register("grid_summary", with_fixtures(STATS_SQL, PRODUCT_CTES))
def q_grid_summary(spark, sf):
    return r6(summary(spark, sf).stats, *STAT_ORDER)


@register("grid_summary_profile", with_fixtures(
    "SELECT y, round(coalesce(avg(value), 0.0) + 3.725290298461914e-09, 6) AS value FROM t GROUP BY y", PRODUCT_CTES))
def q_grid_summary_profile(spark, sf):
    return r6(summary(spark, sf).profiles["mean"], "value")


@register("grid_summary_display", with_fixtures("""
SELECT CAST(0.0001 AS DOUBLE) AS vmin, CAST(ceil(greatest(max(value), avg(value))) AS DOUBLE) AS vmax
FROM t""", PRODUCT_CTES))
def q_grid_summary_display(spark, sf):
    return summary(spark, sf).display


def _zonal_job_sql() -> str:
    excl = ", ".join(f"'{e}'" for e in EXCLUDED)
    return with_fixtures(f"""
SELECT lc_code, lc_label, round(gpp_sum + 3.725290298461914e-09, 6) AS gpp_sum,
       round_even(gpp_sum / sum(gpp_sum) OVER () * 100.0, 1) AS percentage
FROM (SELECT l.lc_code, {label_case('l.lc_code')} AS lc_label, coalesce(sum(t.value), 0.0) AS gpp_sum
      FROM lcg l LEFT JOIN t ON l.iy = t.iy AND l.ix = t.ix
      WHERE l.lc_code IS NOT NULL AND l.x BETWEEN 12.0 AND 28.0 AND l.y BETWEEN 52.0 AND 60.0
      GROUP BY l.lc_code) s
WHERE lc_label NOT IN ({excl})""", {
        **PRODUCT_CTES,
        "m": """SELECT CAST(floor((CAST(61.0 AS DOUBLE) - y) / 1.0) AS INT) AS iy,
                       CAST(floor((x - CAST(10.0 AS DOUBLE)) / 1.0) AS INT) AS ix, lc_code
                FROM lc_fine""",
        "lcg": f"""
SELECT a.iy, a.ix, {coords_sql(K, 'a.iy', 'a.ix')}, b.lc_code
FROM (SELECT DISTINCT iy, ix FROM m WHERE iy BETWEEN 0 AND {SPEC.ny // K - 1}
                                    AND ix BETWEEN 0 AND {SPEC.nx // K - 1}) a
LEFT JOIN (SELECT iy, ix, lc_code,
                  row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, lc_code) AS rn
           FROM (SELECT iy, ix, lc_code, count(*) AS n FROM m
                 WHERE lc_code IS NOT NULL GROUP BY iy, ix, lc_code) c) b
  ON a.iy = b.iy AND a.ix = b.ix AND b.rn = 1"""})


@register("grid_summary_zonal", _zonal_job_sql())
def q_grid_summary_zonal(spark, sf):
    return r6(summary(spark, sf, with_lc=True).zonal, "gpp_sum")


@register("grid_summary_reprojected", with_fixtures(STATS_SQL, {
    "src": SRC_MEAN_SQL, "t": bilinear_sql(SIN_SPEC, DST)}))
def q_grid_summary_reprojected(spark, sf):
    s = grid_summary(fx.cells(spark, sf), SIN_SPEC, "mean", "banded", 1, persist=False)
    return r6(s.stats, *STAT_ORDER)


RANGE_CTES = {
    "sel": f"""SELECT c.* FROM cells c
               JOIN (VALUES {ranges_values_sql()}) r(k, s, e) ON c.date BETWEEN r.s AND r.e""",
    "t0": "SELECT tile, iy, ix, coalesce(sum(value), 0.0) AS value FROM sel GROUP BY tile, iy, ix",
}


@register("range_summary", with_fixtures(STATS_SQL, {
    **RANGE_CTES,
    "t": f"SELECT sum(value) AS value FROM ({block_sql(4, 't0')}) q GROUP BY biy, bix"}))
def q_range_summary(spark, sf):
    s = range_summary(fx.cells(spark, sf), SPEC, fx.DATE_RANGES, "sum", 4, persist=False)
    return r6(s.stats, *STAT_ORDER)


@register("range_summary_lowmem", with_fixtures(STATS_SQL, {
    **RANGE_CTES,
    "t": f"SELECT max(value) AS value FROM ({block_sql(4, 't0')}) q GROUP BY biy, bix"}))
def q_range_summary_lowmem(spark, sf):
    s = range_summary(fx.cells(spark, sf), SPEC, fx.DATE_RANGES, "sum", 4, low_mem=True,
                      persist=False)
    return r6(s.stats, *STAT_ORDER)


# -- cells without any row count as missing, as in an array --------------------
BIG_BOX = Crop(lon_min=100.0, lon_max=300.0, lat_min=-120.0, lat_max=20.0)
FRAME_CTES = {
    "selb": f"""SELECT c.iy, c.ix, c.value FROM cells_big c
                JOIN (VALUES {ranges_values_sql()}) r(k, s, e) ON c.date BETWEEN r.s AND r.e""",
    "frame": f"SELECT CAST(i // {BIG.nx} AS INT) AS iy, CAST(i % {BIG.nx} AS INT) AS ix FROM range(0, {BIG.n_cells}) r(i)",
    "t0": """SELECT f.iy, f.ix, coalesce(s.value, 0.0) AS value
             FROM frame f LEFT JOIN (SELECT iy, ix, sum(value) AS value FROM selb GROUP BY iy, ix) s USING (iy, ix)""",
    "tb": f"""SELECT biy AS iy, bix AS ix, {big_coords_sql(4)}, sum(value) AS value
              FROM ({big_block_sql(4, 't0')}) q GROUP BY biy, bix""",
}


@register("range_sum_framed_stats", with_fixtures(STATS_SQL, {**FRAME_CTES, "t": "SELECT value FROM tb"}))
def q_range_sum_framed_stats(spark, sf):
    """Sums of a sparse grid: cells that no composite has are 0."""
    s = range_summary(fx.cells_big(spark, sf), BIG, fx.DATE_RANGES, "sum", 4, persist=False, dense=True)
    return r6(s.stats, *STAT_ORDER)


@register("profile_framed", with_fixtures(
    "SELECT y, round(avg(value) + 3.725290298461914e-09, 6) AS value FROM tb "
    "WHERE x BETWEEN 100.0 AND 300.0 AND y BETWEEN -120.0 AND 20.0 GROUP BY y", FRAME_CTES))
def q_profile_framed(spark, sf):
    """Profile of the cropped framed sums: all grid rows, absent cells as 0."""
    s = range_summary(fx.cells_big(spark, sf), BIG, fx.DATE_RANGES, "sum", 4, persist=False, dense=True, box=BIG_BOX)
    return r6(s.profiles["mean"], "value")


TILE_H, TILE_W = 8, 16


def tile_footprints(cells):
    """Footprints of the tiles present, from their names."""
    h, v = (F.regexp_extract("tile", r"h(\d+)v(\d+)", i).cast("int") for i in (1, 2))
    return cells.select("tile").distinct().select(
        "tile", (v * TILE_H).alias("iy_lo"), F.least(v * TILE_H + TILE_H, F.lit(SPEC.ny)).alias("iy_end"),
        (h * TILE_W).alias("ix_lo"), F.least(h * TILE_W + TILE_W, F.lit(SPEC.nx)).alias("ix_end")).select(
        "tile", "iy_lo", (F.col("iy_end") - 1).alias("iy_hi"), "ix_lo", (F.col("ix_end") - 1).alias("ix_hi"))


@register("range_lowmem_framed", with_fixtures("""
SELECT iy, ix, y, x, value FROM t""", {
    "gap": "SELECT * FROM cells WHERE tile <> 'h01v01' AND (7 * iy + ix) % 6 <> 0",
    "sel": f"""SELECT c.* FROM gap c JOIN (VALUES {ranges_values_sql()}) r(k, s, e) ON c.date BETWEEN r.s AND r.e""",
    "t0": f"""SELECT f.iy, f.ix, coalesce(s.value, 0.0) AS value
              FROM (SELECT CAST(i // {SPEC.nx} AS INT) AS iy, CAST(i % {SPEC.nx} AS INT) AS ix FROM range(0, {SPEC.n_cells}) r(i)) f
              LEFT JOIN (SELECT iy, ix, sum(value) AS value FROM sel GROUP BY iy, ix) s USING (iy, ix)
              WHERE NOT (f.iy // {TILE_H} = 1 AND f.ix // {TILE_W} = 1)""",
    "t": f"SELECT biy AS iy, bix AS ix, {coords_sql(3, 'biy', 'bix')}, max(value) AS value FROM ({block_sql(3, 't0')}) q GROUP BY biy, bix"}))
def q_range_lowmem_framed(spark, sf):
    """The per-tile path: cells without rows are 0 within the tiles' footprints
    and missing where no tile reaches (one tile is left out)."""
    gap = fx.cells(spark, sf).where("tile <> 'h01v01' and (7 * iy + ix) % 6 <> 0")
    s = range_summary(gap, SPEC, fx.DATE_RANGES, "sum", 3, low_mem=True, persist=False, dense=True,
                      footprints=tile_footprints(gap))
    return s.product


@register("yearly_framed", with_fixtures(f"""
SELECT f.iy, f.ix, CAST(61.0 - 0.5 * (f.iy + 0.5) AS DOUBLE) AS y, CAST(10.0 + 0.5 * (f.ix + 0.5) AS DOUBLE) AS x,
       round(avg(coalesce(s.value, 0.0)) + 3.725290298461914e-09, 6) AS value, count(*) AS n_years
FROM frame f CROSS JOIN (SELECT DISTINCT year(date) AS yr FROM cy) n
LEFT JOIN (SELECT iy, ix, year(date) AS yr, sum(value) AS value FROM cy GROUP BY 1, 2, 3) s
  ON s.iy = f.iy AND s.ix = f.ix AND s.yr = n.yr GROUP BY f.iy, f.ix""", {
    "cy": YEARS_SQL.replace("FROM cells", "FROM cells_big"), "frame": FRAME_CTES["frame"]}))
def q_yearly_framed(spark, sf):
    """Yearly sums and their mean on the whole grid, in one shuffle."""
    return r6(yearly_sum_mean(spread_over_years(fx.cells_big(spark, sf)), BIG, dense=True), "value")


@register("composite_summary", with_fixtures(f"""
SELECT ord, date, round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min,
       round(max(value) + 3.725290298461914e-09, 6) AS max, round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM (SELECT ord, date, max(value) AS value FROM ({block_sql(4, 'sel')}) q
      GROUP BY ord, date, biy, bix) b
GROUP BY ord, date""", {
    "sel": f"""SELECT c.*, r.ord FROM cells c JOIN (VALUES {", ".join(
        f"({i}, DATE '{d}')" for i, d in enumerate(DATE_REQUEST))}) r(ord, d) ON c.date = r.d"""}))
def q_composite_summary(spark, sf):
    _, stats = composite_summary(fx.cells(spark, sf), SPEC, DATE_REQUEST, k=4)
    return r6(stats, *STAT_ORDER)


@register("composite_summary_reprojected", with_fixtures("""
SELECT ord, date, round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min,
       round(max(value) + 3.725290298461914e-09, 6) AS max, round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM b GROUP BY ord, date""", {
    "sel": f"""SELECT c.*, r.ord FROM cells c JOIN (VALUES {", ".join(
        f"({i}, DATE '{d}')" for i, d in enumerate(DATE_REQUEST))}) r(ord, d) ON c.date = r.d""",
    "src": "SELECT ord, date, iy, ix, value FROM sel",
    "b": bilinear_sql(SIN_SPEC, DST, keys=("ord", "date"))}))
def q_composite_summary_reprojected(spark, sf):
    """Per-date products of a sinusoidal stack, reprojected in one job."""
    _, stats = composite_summary(fx.cells(spark, sf), SIN_SPEC, DATE_REQUEST, k=1)
    return r6(stats, *STAT_ORDER)


# -- everything of a composite summary from one pass ---------------------------
REPORT_CTES = {
    "sel": f"""SELECT c.*, r.ord FROM cells c JOIN (VALUES {", ".join(
        f"({i}, DATE '{d}')" for i, d in enumerate(DATE_REQUEST))}) r(ord, d) ON c.date = r.d""",
    "p": f"""SELECT ord, date, biy AS iy, bix AS ix, {coords_sql(2, 'biy', 'bix')}, max(value) * 8.0 AS value
             FROM ({block_sql(2, 'sel')}) q GROUP BY ord, date, biy, bix""",
}


def report(spark, sf):
    return composite_report(fx.cells(spark, sf), SPEC, DATE_REQUEST, 2, value_factor=FACTOR,
                            lc=fx.lc_fine(spark, sf), lc_spec=fx.LC_SPEC, exclude_lc=tuple(EXCLUDED), max_factor=0.5)


@register("composite_report_stats", with_fixtures("""
SELECT ord, date, round(avg(value) + 3.725290298461914e-09, 6) AS mean, round(min(value) + 3.725290298461914e-09, 6) AS min,
       round(max(value) + 3.725290298461914e-09, 6) AS max, round(coalesce(sum(value), 0.0) + 3.725290298461914e-09, 6) AS sum,
       round(stddev_pop(value) + 3.725290298461914e-09, 6) AS std, round(var_pop(value) + 3.725290298461914e-09, 6) AS var
FROM p GROUP BY ord, date""", REPORT_CTES))
def q_composite_report_stats(spark, sf):
    return r6(report(spark, sf).stats, *STAT_ORDER)


@register("composite_report_display", with_fixtures("""
SELECT ord, date, CAST(0.0001 AS DOUBLE) AS vmin, CAST(ceil(greatest(max(value) * 0.5, avg(value))) AS DOUBLE) AS vmax
FROM p GROUP BY ord, date""", REPORT_CTES))
def q_composite_report_display(spark, sf):
    return report(spark, sf).display


@register("composite_report_profile", with_fixtures("""
SELECT ord, date, y, round(coalesce(avg(value), 0.0) + 3.725290298461914e-09, 6) AS value FROM p GROUP BY ord, date, y""",
    REPORT_CTES))
def q_composite_report_profile(spark, sf):
    return r6(report(spark, sf).profiles["mean"], "value")


@register("composite_report_zonal", with_fixtures(f"""
SELECT ord, date, lc_code, lc_label, gpp_sum,
       round_even(gpp_sum / sum(gpp_sum) OVER (PARTITION BY ord, date) * 100.0, 1) AS percentage
FROM (SELECT k.ord, k.date, k.lc_code, {label_case("k.lc_code")} AS lc_label, coalesce(s.v, 0.0) AS gpp_sum
      FROM (SELECT d.ord, d.date, l.lc_code FROM (SELECT DISTINCT ord, date FROM p) d,
                   (SELECT DISTINCT lc_code FROM lcg WHERE lc_code IS NOT NULL) l) k
      LEFT JOIN (SELECT p.ord, p.date, l.lc_code, sum(p.value) AS v FROM p JOIN lcg l ON p.iy = l.iy AND p.ix = l.ix
                 GROUP BY 1, 2, 3) s ON s.ord = k.ord AND s.date = k.date AND s.lc_code = k.lc_code) z
WHERE lc_label NOT IN ({", ".join(f"'{e}'" for e in EXCLUDED)})""", {
    **REPORT_CTES,
    "m": """SELECT CAST(floor((CAST(61.0 AS DOUBLE) - y) / 1.0) AS INT) AS iy,
                   CAST(floor((x - CAST(10.0 AS DOUBLE)) / 1.0) AS INT) AS ix, lc_code FROM lc_fine""",
    "lcg": f"""SELECT iy, ix, lc_code FROM (
                 SELECT iy, ix, lc_code, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, lc_code) AS rn
                 FROM (SELECT iy, ix, lc_code, count(*) AS n FROM m
                       WHERE lc_code IS NOT NULL AND iy < {SPEC.ny // 2} AND ix < {SPEC.nx // 2}
                       GROUP BY iy, ix, lc_code) c) b WHERE rn = 1"""}))
def q_composite_report_zonal(spark, sf):
    return report(spark, sf).zonal
