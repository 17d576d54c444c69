"""Queries: mosaic, frames, time stacks, tile completeness, incremental
products."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.catalog.fixture_sql import with_fixtures
from gridfold.catalog.q_reduce import YEARS_SQL, block_sql, coords_sql, years_cells
from gridfold.catalog.registry import r6, register
from gridfold.operators.align import (dates_of, first_tile_wins, frame_cells, mosaic, overlaps, skip_existing,
                                      tile_gaps, time_stack)
from gridfold.operators.coarsen import summarise
from gridfold.operators.select import select_range
from gridfold.operators.temporal import temporal_reduce, tile_temporal
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import write_cells

SPEC = fx.CELLS_SPEC
TILE_H, TILE_W = 8, 16


def tile_pixels(spark, sf):
    """The stack as tiles deliver it: tile-local (row, col) per pixel."""
    c = fx.cells(spark, sf)
    return c.select("date", "tile", (F.col("iy") % TILE_H).alias("row"),
                    (F.col("ix") % TILE_W).alias("col"), "value", "qflag")


@register("mosaic", with_fixtures("SELECT date, tile, value, qflag, iy, ix, y, x FROM cells"))
def q_mosaic(spark, sf):
    return mosaic(tile_pixels(spark, sf), SPEC, TILE_H, TILE_W)


# a second tile on the north-west one: the pixels of h02v01 delivered as h00v00
PLANTED_SQL = f"""
SELECT date, tile, iy, ix, value, qflag FROM cells
UNION ALL
SELECT date, 'h00v00b' AS tile, iy - {TILE_H} AS iy, ix - {2 * TILE_W} AS ix, value, qflag FROM cells WHERE tile = 'h02v01'"""


def planted_overlap(spark, sf):
    px = tile_pixels(spark, sf)
    return mosaic(px.unionByName(px.where("tile = 'h02v01'").withColumn("tile", F.lit("h00v00b"))), SPEC, TILE_H, TILE_W)


@register("mosaic_overlaps", with_fixtures("""
SELECT date, iy, ix, count(*) AS n FROM p GROUP BY date, iy, ix HAVING count(*) > 1""", {"p": PLANTED_SQL}))
def q_mosaic_overlaps(spark, sf):
    return overlaps(planted_overlap(spark, sf))


@register("mosaic_first_tile", with_fixtures("""
SELECT date, tile, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, CAST(60.75 - 0.5 * iy AS DOUBLE) AS y,
       CAST(10.25 + 0.5 * ix AS DOUBLE) AS x, value, qflag
FROM (SELECT *, row_number() OVER (PARTITION BY date, iy, ix ORDER BY tile) AS r FROM p) q WHERE r = 1""",
    {"p": PLANTED_SQL}))
def q_mosaic_first_tile(spark, sf):
    """Cells that two tiles claim go to the first tile."""
    return first_tile_wins(planted_overlap(spark, sf), SPEC).select("date", "tile", "iy", "ix", "y", "x", "value", "qflag")


@register("grid_frame", with_fixtures(f"""
SELECT f.date, f.iy, f.ix, CAST(60.75 - 0.5*f.iy AS DOUBLE) AS y, CAST(10.25 + 0.5*f.ix AS DOUBLE) AS x,
       c.value, c.qflag
FROM (SELECT d.date, CAST(r.i // {SPEC.nx} AS INT) AS iy, CAST(r.i % {SPEC.nx} AS INT) AS ix
      FROM (SELECT DISTINCT date FROM cells) d, range(0, {SPEC.n_cells}) r(i)) f
LEFT JOIN cells c ON c.date = f.date AND c.iy = f.iy AND c.ix = f.ix"""))
def q_grid_frame(spark, sf):
    c = fx.cells(spark, sf)
    return frame_cells(c, SPEC, dates=dates_of(c), value_cols=("value", "qflag"))


@register("grid_frame_sum", with_fixtures(f"""
SELECT f.iy, f.ix, coalesce(t.value, 0.0) AS value
FROM (SELECT CAST(i // {SPEC.nx} AS INT) AS iy, CAST(i % {SPEC.nx} AS INT) AS ix
      FROM range(0, {SPEC.n_cells}) r(i)) f
LEFT JOIN (SELECT iy, ix, sum(value) AS value FROM cells GROUP BY iy, ix) t
  ON t.iy = f.iy AND t.ix = f.ix"""))
def q_grid_frame_sum(spark, sf):
    """Dense temporal sum: cells without any row count as 0, as on a
    NaN-filled array."""
    g = temporal_reduce(fx.cells(spark, sf), "sum", SPEC)
    return (frame_cells(g, SPEC).select("iy", "ix", F.coalesce("value", F.lit(0.0)).alias("value")))


YEARS = (2020, 2021, 2022, 2023)


@register("time_stack", with_fixtures(f"""
SELECT biy AS iy, bix AS ix, {coords_sql(4, 'biy', 'bix')}, round(max(value) + 3.725290298461914e-09, 6) AS value
FROM ({block_sql(4, 't')}) b GROUP BY biy, bix""", {
    "cy": YEARS_SQL,
    "t0": "SELECT year(date) AS yr, iy, ix, coalesce(sum(value), 0.0) AS value FROM cy GROUP BY 1, 2, 3",
    "t": "SELECT iy, ix, avg(value) AS value FROM t0 GROUP BY iy, ix"}))
def q_time_stack(spark, sf):
    """Yearly sums made one year at a time, stacked with 1 January as their
    date, then the mean over the years coarsened by max (the flat preset)."""
    cy = years_cells(spark, sf)
    parts = [temporal_reduce(select_range(cy, f"{y}-01-01", f"{y}-12-31"), "sum", SPEC)
             .withColumn("date", F.make_date(F.lit(y), F.lit(1), F.lit(1))) for y in YEARS]
    return r6(summarise(time_stack(*parts), "mean", 4, SPEC, "flat"), "value")


# some tiles are missing on later dates
TILES_SQL = """SELECT DISTINCT date, tile FROM cells
WHERE value IS NOT NULL AND NOT (date > DATE '2020-01-01' AND (dayofyear(date) + ix // 16 + 2 * (iy // 8)) % 5 = 0)"""


@register("tile_gaps", with_fixtures("""
SELECT e.tile, e.date FROM (
  SELECT f.tile, d.date FROM (SELECT DISTINCT tile FROM tl WHERE date = (SELECT min(date) FROM tl)) f,
                             (SELECT DISTINCT date FROM tl) d) e
WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.tile = e.tile AND tl.date = e.date)""",
    {"tl": TILES_SQL}))
def q_tile_gaps(spark, sf):
    lost = (F.col("date") > F.lit("2020-01-01").cast("date")) & (
        (F.dayofyear("date") + F.floor(F.col("ix") / 16) + 2 * F.floor(F.col("iy") / 8)) % 5 == 0)
    tiles = fx.cells(spark, sf).where(F.col("value").isNotNull() & ~lost).select("date", "tile").distinct()
    return tile_gaps(tiles, "tile")


@register("skip_existing", with_fixtures("SELECT DISTINCT tile, 'mean' AS operator FROM cells"))
def q_skip_existing(spark, sf):
    """Per-tile products wanted for two operators; the 'sum' products are
    already written, so only the 'mean' ones remain.  The key holds the
    operator, not only the tile."""
    c = fx.cells(spark, sf)
    done = tile_temporal(c, "sum", SPEC).withColumn("operator", F.lit("sum"))
    path = write_cells(done, scratch_path(spark, "tile-products"))
    existing = spark.read.parquet(path)
    wanted = (c.select("tile").distinct()
              .select("tile", F.explode(F.array(F.lit("mean"), F.lit("sum"))).alias("operator")))
    return skip_existing(wanted, existing, ["tile", "operator"])
