"""Test tables derived from the driver's TPC-H-like parquet tables.

The raster operators need gridded inputs; these are built from ``lineitem``,
``part`` and ``customer`` by Spark itself, so their work grows with the scale
factor.  The same definitions exist as SQL (``gridfold.catalog.fixture_sql``)
for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.model import GridSpec

# Fixed values of the fixture grids.
CELLS_NY, CELLS_NX = 22, 43          # 0.5 degree cells
BIG_NY, BIG_NX = 523, 1021           # bench variant
CELLS_SPEC = GridSpec(x0=10.0, y0=61.0, dx=0.5, dy=0.5, nx=CELLS_NX, ny=CELLS_NY)
BIG_SPEC = GridSpec(x0=10.0, y0=61.0, dx=0.5, dy=0.5, nx=BIG_NX, ny=BIG_NY)
LC_SPEC = GridSpec(x0=10.0, y0=61.0, dx=0.25, dy=0.25, nx=86, ny=44)
FIRST_DATE = "2020-01-01"
DAYS_PER_COMPOSITE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, ny: int = CELLS_NY,
          nx: int = CELLS_NX) -> DataFrame:
    """Stack of 8-day composites: one row per (date, cell) present.

    Value = (sum of quantities of the lineitems mapped to the cell) mod 97;
    quality = min tax in percent.  Every 11th cell-date and the whole cell
    (iy=3, ix=7) are NULL.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax")
    g = li.groupBy(
        F.col("l_linenumber").alias("ln"),
        (F.col("l_orderkey") % ny).cast("int").alias("iy"),
        (F.col("l_partkey") % nx).cast("int").alias("ix"),
    ).agg(
        (F.sum("l_quantity").cast("bigint") % 97).cast("double").alias("value"),
        F.min(F.round(F.col("l_tax") * 100).cast("int")).alias("qflag"),
    )
    hole = (((F.col("ix") + 2 * F.col("iy") + F.col("ln")) % 11) == 0) | (
        (F.col("ix") == 7) & (F.col("iy") == 3))
    tile = F.concat(
        F.lit("h"), F.lpad(F.floor(F.col("ix") / 16).cast("int").cast("string"), 2, "0"),
        F.lit("v"), F.lpad(F.floor(F.col("iy") / 8).cast("int").cast("string"), 2, "0"))
    return g.select(
        F.date_add(F.lit(FIRST_DATE).cast("date"),
                   (F.lit(DAYS_PER_COMPOSITE) * (F.col("ln") - 1)).cast("int")).alias("date"),
        tile.alias("tile"),
        "iy", "ix",
        (F.lit(60.75) - F.lit(0.5) * F.col("iy")).cast("double").alias("y"),
        (F.lit(10.25) + F.lit(0.5) * F.col("ix")).cast("double").alias("x"),
        F.when(hole, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.col("qflag").cast("double").alias("qflag"),
    )


def cells_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, ny=BIG_NY, nx=BIG_NX)


def cells_long(spark: SparkSession, sf_dir: str, ny: int = CELLS_NY,
               nx: int = CELLS_NX) -> DataFrame:
    """The band-dimension form: band 1 = value, band 2 = quality flag."""
    c = cells(spark, sf_dir, ny, nx)
    from gridfold.sources.store import to_long
    return to_long(c)


def lc_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """86 x 44 land-cover raster at half the cell size.

    Every part row is spread over the 44 raster rows; a fine cell takes the
    class of the part with the smallest key mapped to its column.  Codes are
    10..90, 95 and 100; every 37th diagonal is NULL (no class).
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = part.select(
        (F.col("p_partkey") % LC_SPEC.nx).cast("int").alias("ix2"),
        "p_partkey", "p_size",
        F.explode(F.sequence(F.lit(0), F.lit(LC_SPEC.ny - 1))).alias("iy2"),
    ).withColumn(
        "k", ((F.col("p_size") + 3 * F.floor(F.col("iy2") / 2)
               + (F.col("iy2") % 2) * F.col("p_partkey")) % 11).cast("int"))
    g = rows.groupBy("iy2", "ix2").agg(F.min_by("k", "p_partkey").alias("k"))
    code = (F.when(((F.col("ix2") + F.col("iy2")) % 37) == 0, F.lit(None).cast("int"))
             .when(F.col("k") < 9, (F.col("k") + 1) * 10)
             .when(F.col("k") == 9, F.lit(95))
             .otherwise(F.lit(100)))
    return g.select(
        F.col("iy2").alias("iy"), F.col("ix2").alias("ix"),
        LC_SPEC.y_of("iy2").alias("y"), LC_SPEC.x_of("ix2").alias("x"),
        code.cast("int").alias("lc_code"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per customer; some lie outside the grid, some exactly
    midway between cell centres."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.select(
        F.col("c_custkey").cast("bigint").alias("point_id"),
        F.col("c_name").alias("station"),
        (F.lit(9.0) + ((F.col("c_custkey") * 37) % 500) / F.lit(20.0)).cast("double").alias("x"),
        (F.lit(62.0) - ((F.col("c_custkey") * 53) % 290) / F.lit(20.0)).cast("double").alias("y"),
        F.lit("EPSG:4326").alias("crs"),
    )


# Fixed date ranges of the range-selection checks (they overlap on 2020-01-17).
DATE_RANGES = [("2020-01-01", "2020-01-17"), ("2020-01-17", "2020-02-02")]
