"""Sinks: cells and grids as Parquet, series / profiles / shares as CSV,
statistics as text.

Cells are written partitioned by ``date`` (date selections then prune whole
folders) and sorted by (iy, ix) inside each file, so Parquet row-group
statistics also prune crops.  Values are stored as float32.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridfold.model import GridSpec

from gridfold.operators.stats import STAT_ORDER, stats_long
from gridfold.sources.stations import (FILES, drop_file_table, local_folder, read_station_files,
                                       write_station_files)

FLOAT_COLS = ("value", "qflag")


def as_float32(df: DataFrame) -> DataFrame:
    """Data columns to float32 (C5); indices and coordinates unchanged."""
    return df.withColumns({c: F.col(c).cast("float") for c in FLOAT_COLS if c in df.columns})


def write_cells(df: DataFrame, path: str, float32: bool = True, mode: str = "overwrite",
                band_rows: int = 512) -> str:
    """Write a cell stack or grid as zstd Parquet (K1).

    Stacks are partitioned by ``date``.  Rows are first hash-partitioned by
    (date, strip of ``band_rows`` grid rows), so one task writes whole strips
    and each file is one contiguous strip of one date: the file count follows
    the data size, not tasks x dates, and a strip (band_rows x nx cells) bounds
    a task.  Inside a file rows are sorted by (iy, ix), so Parquet row-group
    statistics prune crops.  No sampling pass (unlike range partitioning)."""
    out = as_float32(df) if float32 else df
    parts = [c for c in ("date",) if c in out.columns]
    keys = [c for c in ("iy", "ix") if c in out.columns]
    if "iy" in out.columns:
        strip = F.floor(F.col("iy") / F.lit(band_rows))
        out = out.repartition(*[F.col(c) for c in parts], strip)
    w = (out.sortWithinPartitions(*parts, *keys).write.mode(mode)
            .option("compression", "zstd"))
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return path


def block_id(spec: GridSpec, block: int) -> Column:
    """Square spatial block of ``block`` x ``block`` cells, row-major."""
    nbx = -(-spec.nx // block)
    return (F.floor(F.col("iy") / F.lit(block)) * F.lit(nbx)
            + F.floor(F.col("ix") / F.lit(block))).cast("int")


def write_cells_bucketed(df: DataFrame, table: str, spec: GridSpec, path: str,
                         block: int = 64, buckets: int | None = None,
                         mode: str = "overwrite") -> str:
    """Write a stack as a table partitioned by ``date`` and bucketed by the
    spatial block ``blk`` (K1, co-located layout).

    A reader that groups by (blk, ...) gets the bucket partitioning for free:
    per-cell time reductions, and block reductions with k dividing
    ``block``, then run inside the scan tasks with no shuffle, while date
    filters still prune folders.  ``buckets`` sets the files per date and
    the read parallelism (default: twice the shuffle partitions)."""
    spark = df.sparkSession
    n = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = as_float32(df).withColumn("blk", block_id(spec, block))
    # hash partitioning by blk with n partitions puts bucket i in task i, so
    # each task writes one file per date instead of one per bucket per date
    out = out.repartition(n, "blk")
    (out.write.mode(mode).partitionBy("date").bucketBy(n, "blk").sortBy("iy", "ix")
        .option("compression", "zstd").option("path", path).format("parquet")
        .saveAsTable(table))
    return table


def write_series_csv(series: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One CSV folder per station (K2).  Two points with the same name keep
    both their rows (they share a folder).  On a local or mounted file system
    the tasks create the files themselves (``gridfold.sources.stations``)."""
    # all rows of a point in one task (one row per date: bounded), so a
    # station folder gets one file per point, not one per (task, station);
    # a name shared by many points is spread over several tasks
    keys = ["station"] + (["point_id"] if "point_id" in series.columns else [])
    rows = series.repartition(*keys).sortWithinPartitions(*keys, "time")
    folder = local_folder(series.sparkSession, path)
    if folder is not None and mode == "overwrite":
        write_station_files(rows, folder)
    else:
        if folder is not None and mode == "append":
            drop_file_table(folder)
        rows.write.mode(mode).partitionBy("station").option("header", True).csv(path)
    return path


def read_series_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The series that ``write_series_csv`` wrote, with ``schema`` (DDL, station
    included)."""
    folder = local_folder(spark, path)
    if folder is not None and os.path.isdir(os.path.join(folder, FILES)):
        return read_station_files(spark, folder, StructType.fromDDL(schema))
    return spark.read.schema(schema).option("header", True).csv(path)


def write_profile_csv(profile: DataFrame, path: str, mode: str = "overwrite") -> str:
    """(y, value) without missing rows, one file (K3).  A profile has one
    row per grid row, so a single writer task is bounded by the grid height."""
    (profile.select("y", "value").dropna().repartition(1).sortWithinPartitions(F.col("y").desc())
            .write.mode(mode).option("header", True).csv(path))
    return path


def write_zonal_csv(shares: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Land-cover shares (<= 11 rows), one file (K4)."""
    (shares.select("lc_code", "lc_label", "gpp_sum", "percentage").repartition(1)
           .sortWithinPartitions("lc_code")
           .write.mode(mode).option("header", True).csv(path))
    return path


def stats_lines(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``key: value`` lines in the order mean, min, max, sum, std, var."""
    return stats_long(stats, keys).select(
        *keys, "ord",
        F.concat(F.col("stat"), F.lit(": "), F.col("value").cast("string")).alias("line"))


def write_stats_text(stats: DataFrame, path: str, mode: str = "overwrite",
                     keys: tuple[str, ...] = ()) -> str:
    """Statistics as six-line text files (K5): one file, or one per key
    value (e.g. per date) in ``key=value`` folders."""
    lines = stats_lines(stats, keys)
    if keys:
        (lines.repartition(*keys).sortWithinPartitions(*keys, "ord").select(*keys, "line")
              .write.mode(mode).partitionBy(*keys).text(path))
    else:
        lines.coalesce(1).sortWithinPartitions("ord").select("line").write.mode(mode).text(path)
    return path


__all__ = ["write_cells", "write_series_csv", "read_series_csv", "write_profile_csv", "write_zonal_csv",
           "write_stats_text", "stats_lines", "as_float32", "STAT_ORDER"]
