"""Alignment: mosaic of tiles, dense frames, time stacks, tile completeness
and incremental products.

Frames are generated from the GridSpec with ``spark.range`` (distributed,
no driver-side axis lists and no cross join of axes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.model import GridSpec

# Rows of a generated frame per partition (keeps frame tasks ~tens of MB).
FRAME_ROWS_PER_PARTITION = 2_000_000


def grid_frame(spark: SparkSession, spec: GridSpec, dates=None) -> DataFrame:
    """Every cell of ``spec`` as (iy, ix, y, x).

    ``dates`` (a list of date strings, or a Column holding an array of
    dates, e.g. a scalar subquery) adds one row per cell and date."""
    n = spec.n_cells
    parts = max(spark.sparkContext.defaultParallelism, -(-n // FRAME_ROWS_PER_PARTITION))
    f = spark.range(0, n, 1, parts).select(
        (F.col("id") / F.lit(spec.nx)).cast("long").cast("int").alias("iy"),
        (F.col("id") % F.lit(spec.nx)).cast("int").alias("ix"))
    f = spec.with_coords(f)
    if dates is not None:
        arr = dates if not isinstance(dates, (list, tuple)) else F.array(
            *[F.lit(str(d)).cast("date") for d in dates])
        f = f.select(F.explode(arr).alias("date"), "iy", "ix", "y", "x")
    return f


def frame_cells(cells: DataFrame, spec: GridSpec, dates=None,
                value_cols: tuple[str, ...] = ("value",)) -> DataFrame:
    """Outer-align ``cells`` on the full frame: absent cells (or cell-dates)
    appear with NULL values (J2, the 'outer' alignment)."""
    spark = cells.sparkSession
    keys = ["iy", "ix"] + (["date"] if dates is not None else [])
    f = grid_frame(spark, spec, dates)
    vals = cells.select(*keys, *value_cols)
    return f.join(vals, keys, "left").select(*([k for k in ("date",) if k in keys]),
                                              "iy", "ix", "y", "x", *value_cols)


def frame_rows(spark: SparkSession, spec: GridSpec,
               window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(iy, ix) of every cell of ``spec``, or of an inclusive index window
    (iy_lo, iy_hi, ix_lo, ix_hi)."""
    iy_lo, iy_hi, ix_lo, ix_hi = window or (0, spec.ny - 1, 0, spec.nx - 1)
    ny, nx = max(0, iy_hi - iy_lo + 1), max(0, ix_hi - ix_lo + 1)
    parts = max(spark.sparkContext.defaultParallelism, -(-ny * nx // FRAME_ROWS_PER_PARTITION))
    at = F.col("id")
    return spark.range(0, ny * nx, 1, parts).select(
        (F.floor(at / F.lit(max(nx, 1))) + F.lit(iy_lo)).cast("int").alias("iy"),
        (at % F.lit(max(nx, 1)) + F.lit(ix_lo)).cast("int").alias("ix"))


def footprint_rows(footprints: DataFrame) -> DataFrame:
    """(tile, iy, ix) of every cell of tile footprints (tile, iy_lo, iy_hi,
    ix_lo, ix_hi; inclusive).  One row per tile is spread over tasks by its
    grid rows before its cells are listed."""
    rows = footprints.select("tile", "ix_lo", "ix_hi", F.explode(F.sequence("iy_lo", "iy_hi")).alias("iy"))
    n = footprints.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, "tile", "iy").select(
        "tile", "iy", F.explode(F.sequence("ix_lo", "ix_hi")).alias("ix"))


def with_frame(cells: DataFrame, frame: DataFrame) -> DataFrame:
    """The stack with one more row, without values, for every cell of
    ``frame``.  A reduction over time then has every cell of the frame (a sum
    of 0, a mean of NULL) as an outer-aligned array has, for the price of one
    composite: no frame of cells x dates is built and nothing is joined."""
    return cells.unionByName(frame.drop(*[c for c in frame.columns if c not in cells.columns]),
                             allowMissingColumns=True)


def dates_of(cells: DataFrame):
    """All distinct dates of ``cells`` as an array-valued scalar subquery
    (one value per composite date: bounded by the number of dates)."""
    return cells.select(F.array_sort(F.collect_set("date"))).scalar()


def mosaic(tile_pixels: DataFrame, spec: GridSpec, tile_h: int, tile_w: int,
           tile_col: str = "tile") -> DataFrame:
    """Place tile-local pixels on the global grid.

    Tiles are named ``hHHvVV`` (column HH, row VV of the tile grid); a pixel
    at local (row, col) of tile (v, h) is global cell
    (v * tile_h + row, h * tile_w + col).  Coordinates come from ``spec``."""
    h = F.regexp_extract(F.col(tile_col), r"h(\d+)v(\d+)", 1).cast("int")
    v = F.regexp_extract(F.col(tile_col), r"h(\d+)v(\d+)", 2).cast("int")
    keep = [c for c in tile_pixels.columns if c not in ("row", "col")]
    out = tile_pixels.select(
        *keep,
        (v * F.lit(tile_h) + F.col("row")).cast("int").alias("iy"),
        (h * F.lit(tile_w) + F.col("col")).cast("int").alias("ix"))
    return spec.with_coords(out)


def overlaps(cells: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Cells that two tiles both claim: (keys, iy, ix, n) with n > 1."""
    keys = tuple(k for k in keys if k in cells.columns)
    extra = ("band",) if "band" in cells.columns else ()
    return (cells.groupBy(*keys, *extra, "iy", "ix").agg(F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") > 1))


def check_no_overlaps(cells: DataFrame, keys: tuple[str, ...] = ("date",)) -> None:
    """Fail if the mosaic has a cell twice (one small action)."""
    if overlaps(cells, keys).limit(1).count():
        raise ValueError("tiles overlap: a cell appears more than once")


def first_tile_wins(cells: DataFrame, spec: GridSpec, last: bool = False,
                    keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """One row per cell where tiles overlap: that of the tile whose name sorts
    first (or last).  One aggregate with a map-side step; cells are counted
    only once in whatever follows."""
    rest = [c for c in cells.columns if c not in (*keys, "tile", "iy", "ix", "y", "x")]
    pick = (F.max_by if last else F.min_by)(F.struct("tile", *rest), F.struct(F.col("tile"), *rest))
    one = cells.groupBy(*keys, "iy", "ix").agg(pick.alias("_c"))
    return spec.with_coords(one.select(*keys, "iy", "ix", "_c.*")).select(*cells.columns)


def time_stack(*parts: DataFrame) -> DataFrame:
    """Concatenate dated parts along time."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def tile_gaps(tiles: DataFrame, tile_col: str = "tile_key") -> DataFrame:
    """(tile, date) pairs missing from ``tiles`` when the tile set of the
    first date is expected on every date (J9, strict alignment)."""
    first = tiles.select(F.min("date")).scalar()
    all_dates = tiles.select(F.array_sort(F.collect_set("date"))).scalar()
    expected = (tiles.where(F.col("date") == first).select(tile_col).distinct()
                     .select(tile_col, F.explode(all_dates).alias("date")))
    return expected.join(tiles.select(tile_col, "date"), [tile_col, "date"], "left_anti")


def check_complete(tiles: DataFrame, tile_col: str = "tile_key") -> None:
    if tile_gaps(tiles, tile_col).limit(1).count():
        raise ValueError("a tile of the first date is missing on a later date")


def skip_existing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Products still to compute: ``wanted`` minus keys already in
    ``existing`` (J10).  The key should name the operator and the date set,
    not only the tile, so that a product of other dates is not reused."""
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")
