"""Composite store: listing dated tile files, parsing their names, reading
saved cells and point tables.

A store is ``root/<date>/<prefix>_<YYYYMMDD>_<tile_key>.tif``.  Directory
names are accepted as ``YYYY-MM-DD`` and as ``YYYYMMDD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.model import QUALITY_BAND, VALUE_BAND, nan_to_null

DASHED_DIR = r"^\d{4}-\d{2}-\d{2}$"
COMPACT_DIR = r"^\d{8}$"


# -- date directories (F1, C1) ---------------------------------------------
def date_of_dirname(name: Column | str) -> Column:
    """Date of a directory name, NULL if it is not a valid date directory.

    The syntactic test (digits and dashes) comes first; a name that passes it
    but is not a calendar date (``2020-13-40``) also yields NULL.
    """
    name = F.col(name) if isinstance(name, str) else name
    return (F.when(name.rlike(DASHED_DIR), F.try_to_date(name, "yyyy-MM-dd"))
             .when(name.rlike(COMPACT_DIR), F.try_to_date(name, "yyyyMMdd")))


def date_dirs(names: DataFrame, col: str = "name", strict: bool = False) -> DataFrame:
    """Keep the valid date directories of ``names`` and add their ``date``.

    ``strict=True`` fails the job on a name that looks like a date but is not
    one (as a calendar parser would), instead of dropping it.
    """
    d = names.withColumn("date", date_of_dirname(col))
    if strict:
        looks = F.col(col).rlike(DASHED_DIR) | F.col(col).rlike(COMPACT_DIR)
        d = d.withColumn("date", F.when(looks & F.col("date").isNull(),
                                        F.raise_error(F.concat(F.lit("not a date: "), F.col(col))))
                         .otherwise(F.col("date")).cast("date"))
    return d.where(F.col("date").isNotNull())


# -- tile file names (C2) --------------------------------------------------
TILE_NAME = r"^([^_]*_[^_]*)_([^_]*)_(.*)\.tif$"


def parse_tile_name(df: DataFrame, col: str = "file") -> DataFrame:
    """Add ``prefix`` (first two ``_`` parts), ``name_date`` (third part, a
    date when it is ``YYYYMMDD``) and ``tile_key`` (the rest, without
    ``.tif``).  ``tile_key`` identifies one tile across dates."""
    c = F.col(col)
    return (df.withColumn("prefix", F.regexp_extract(c, TILE_NAME, 1))
              .withColumn("name_date", F.try_to_date(F.regexp_extract(c, TILE_NAME, 2),
                                                     "yyyyMMdd"))
              .withColumn("tile_key", F.regexp_extract(c, TILE_NAME, 3)))


# -- listing (S1) ----------------------------------------------------------
def scan_tiles(spark: SparkSession, root: str) -> DataFrame:
    """List ``<root>/<date>/*.tif`` as (path, dir, file, date, prefix, tile_key).

    Only file metadata is read (``binaryFile`` skips ``content`` when it is
    not selected); the listing is distributed by Spark's file index.
    """
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.tif")
             .load(root)
             .select("path"))
    files = files.select(
        "path",
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return parse_tile_name(date_dirs(files, "dir"), "file")


# -- band shapes (F5) ------------------------------------------------------
def to_long(cells: DataFrame) -> DataFrame:
    """Wide (value, qflag) -> long (band, value).  Narrow: no shuffle."""
    keys = [c for c in cells.columns if c not in ("value", "qflag")]
    head = [c for c in keys if c in ("date", "tile")]
    rest = [c for c in keys if c not in head]
    return cells.select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit(VALUE_BAND).alias("band"), F.col("value").alias("v")),
            F.struct(F.lit(QUALITY_BAND).alias("band"), F.col("qflag").cast("double").alias("v")),
        )).alias("b"),
    ).select(*head, F.col("b.band").alias("band"), *rest, F.col("b.v").alias("value"))


def band_select(cells_long: DataFrame, band: int = VALUE_BAND) -> DataFrame:
    """Rows of one band; the band filter reaches the parquet scan."""
    return cells_long.where(F.col("band") == F.lit(band)).drop("band")


# -- saved cells (S3) ------------------------------------------------------
def read_cells(spark: SparkSession, path: str | list[str], start=None, end=None,
               dates: list[str] | None = None) -> DataFrame:
    """Read cells written by ``write_cells``; date bounds become partition
    filters (only the chosen ``date=`` folders are listed and read)."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if dates:
        df = df.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    value_cols = [c for c in ("value", "qflag") if c in df.columns]
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in value_cols})


def read_bucketed(spark: SparkSession, table: str, start=None, end=None,
                  dates: list[str] | None = None) -> DataFrame:
    """Read a table written by ``write_cells_bucketed`` (keeps ``blk``)."""
    df = spark.table(table)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if dates:
        df = df.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    return df.withColumns({c: nan_to_null(F.col(c).cast("double"))
                           for c in ("value", "qflag") if c in df.columns})


# -- points (S4, C7, F9) ---------------------------------------------------
def _wkb_points(geom):
    """WKB / EWKB points -> (x, y); NaN for empty points; raises for any
    other geometry type.  Vectorised per Arrow batch."""
    import numpy as np
    import pandas as pd
    import struct

    def one(b):
        if b is None:
            return (np.nan, np.nan)
        b = bytes(b)
        bo = "<" if b[0] == 1 else ">"
        t = struct.unpack(bo + "I", b[1:5])[0]
        off = 5
        if t & 0x20000000:          # EWKB with SRID
            off += 4
        base = (t & 0x0FFFFFFF) % 1000
        if base != 1:
            raise ValueError(f"geometry type {base} is not a point")
        return struct.unpack(bo + "dd", b[off:off + 16])
    xy = np.array([one(b) for b in geom], dtype=float).reshape(-1, 2)
    return pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1]})


def point_xy(geometry: str):
    """Column struct (x, y) decoded from a WKB point column."""
    from pyspark.sql.functions import pandas_udf
    udf = pandas_udf(_wkb_points, "x DOUBLE, y DOUBLE")
    return udf(F.col(geometry))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in their order.  One count per
    partition reaches the driver; rows stay where they are."""
    local = F.monotonically_increasing_id()          # partition number above 33 bits of row number
    sizes = df.select(F.shiftright(local, 33).cast("int").alias("p")).groupBy("p").count().collect()
    before, upto = [], 0
    counts = {r["p"]: r["count"] for r in sizes}
    for p in range(max(counts, default=-1) + 1):
        before.append(upto)
        upto += counts.get(p, 0)
    tagged = df.withColumn("_n", local)
    start = F.get(F.lit(before or [0]).cast("array<bigint>"), F.shiftright("_n", 33).cast("int"))
    return tagged.withColumn(name, start + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n")


def read_points(df: DataFrame, x: str = "x", y: str = "y", name_col: str | None = None,
                id_col: str = "point_id", crs: str | None = None,
                crs_col: str = "crs", geometry_col: str | None = None) -> DataFrame:
    """Validate a point table and bring it to (point_id, station, x, y, crs).

    * a CRS is required: either ``crs=`` for the whole table or a ``crs``
      column without NULLs (the job fails otherwise);
    * ``geometry_col``: coordinates come from a WKB geometry (GeoParquet
      style); any geometry that is not a Point fails the job;
    * rows without coordinates (empty geometries) are skipped;
    * the station is ``name_col`` or ``point_%05d`` of the point id.
    """
    if geometry_col is not None:
        df = (df.withColumn("_xy", point_xy(geometry_col))
                .withColumns({x: F.col("_xy.x"), y: F.col("_xy.y")}).drop("_xy"))
    if crs is not None:
        crs_c = F.lit(crs)
    elif crs_col in df.columns:
        crs_c = F.when(F.col(crs_col).isNull(),
                       F.raise_error(F.lit("CRS not defined for the points"))).otherwise(F.col(crs_col))
    else:
        raise ValueError("CRS not defined for the points")
    name = (F.col(name_col).cast("string") if name_col
            else F.format_string("point_%05d", F.col(id_col)))
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull()
                     & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y)))
              .select(F.col(id_col).cast("bigint").alias("point_id"),
                      name.alias("station"),
                      F.col(x).cast("double").alias("x"),
                      F.col(y).cast("double").alias("y"),
                      crs_c.cast("string").alias("crs")))
