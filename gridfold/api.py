"""Entry points shaped like the reference's four public functions.

They read a composite store, run the jobs of ``gridfold.plans.jobs`` and
write the data outputs (statistics text, profile CSVs, land-cover share
CSV, saved stack / product, station series).  Maps and plots are not drawn;
their data are returned as DataFrames.

A store is either a GeoTIFF tree ``<directory>/<date>/*.tif`` (dates as
``YYYY-MM-DD`` or ``YYYYMMDD``) or a Parquet cell store written by
``write_cells``.  The grid of a GeoTIFF tree is inferred from the headers of
the tiles of all selected dates unless ``spec`` is given.  ``dense`` (default)
is the rule of arrays: a cell without any row is missing in every composite,
so its sum is 0; ``dense=False`` leaves such cells out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.model import GridSpec
from gridfold.operators.align import check_complete, first_tile_wins
from gridfold.operators.points import sample_window, to_grid_crs
from gridfold.operators.select import in_range, select_range, select_ranges
from gridfold.plans import jobs, products
from gridfold.sources import sinks
from gridfold.sources.raster import (decode_store, infer_spec, list_tile_files, read_tile_files, tile_footprints,
                                     tile_headers, tile_overlaps)
from gridfold.sources.store import numbered, read_cells, read_points


@dataclass
class Actions:
    """The ``extra_actions`` string as flags ('record+plot+sum+mean')."""
    plot: bool = False
    record: bool = False
    sum: bool = False
    mean: bool = False

    @classmethod
    def parse(cls, text: str) -> "Actions":
        parts = {p.strip() for p in (text or "").replace(",", "+").split("+") if p.strip()}
        unknown = parts - {"plot", "record", "sum", "mean"}
        if unknown:
            raise ValueError(f"unknown extra actions: {sorted(unknown)}")
        return cls(**{p: True for p in parts})

    @property
    def side_products(self) -> bool:
        return self.plot or self.record

    def methods(self) -> tuple[str, ...]:
        return tuple(m for m in ("sum", "mean") if getattr(self, m))


@dataclass
class Stack:
    """An opened store: its cells and grid, and for a tile tree the footprints
    of the tiles and the (tile_key, date) pairs of its files."""
    cells: DataFrame
    spec: GridSpec
    footprints: DataFrame | None = None
    tiles: DataFrame | None = None


FORMATS = ("auto", "geotiff", "parquet")
OVERLAPS = ("error", "first", "last")


def _is_tiff_tree(spark: SparkSession, directory: str, format: str = "auto") -> bool:
    """Whether the store is a tile tree; "auto" looks for a .tif file by Spark's
    own listing, on any file system."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}, not {format!r}")
    return format == "geotiff" or (format == "auto" and not list_tile_files(spark, directory).limit(1).isEmpty())


def open_stack(spark: SparkSession, directory: str, spec: GridSpec | None = None, crs: str | None = None,
               when=None, format: str = "auto", overlap: str = "error", alignment: str = "outer") -> Stack:
    """Opens a store.  ``when`` (a Column over ``date``) selects dates before
    files are opened (tile tree) or as a partition filter (Parquet).

    ``overlap``: what two tiles of one date that share cells do: raise an
    error, or give the cell to the tile whose name sorts first or last.
    ``alignment="strict"``: a tile of the first date that is missing on a
    later date raises an error; "outer" takes what is there."""
    if overlap not in OVERLAPS:
        raise ValueError(f"overlap is one of {OVERLAPS}, not {overlap!r}")
    if alignment not in ("outer", "strict"):
        raise ValueError(f"alignment is outer or strict, not {alignment!r}")
    if not _is_tiff_tree(spark, directory, format):
        if spec is None:
            raise ValueError("a Parquet cell store needs its GridSpec")
        cells = read_cells(spark, directory)
        cells = cells.where(when) if when is not None else cells
        if alignment == "strict":
            check_complete(cells.select("tile", "date").distinct(), "tile")
        return Stack(cells, spec)
    tiles = list_tile_files(spark, directory, when).select("tile_key", "date")
    if alignment == "strict":
        check_complete(tiles)
    headers = tile_headers(read_tile_files(spark, directory, when))
    if spec is None:
        spec = infer_spec(headers, crs)           # the tiles of every selected date
    cells = decode_store(spark, directory, spec, when)
    clash = tile_overlaps(headers).first()
    if clash is not None:
        if overlap == "error":
            raise ValueError(f"tiles overlap on one date: {clash['a']} and {clash['b']}")
        cells = first_tile_wins(cells, spec, last=overlap == "last")
    return Stack(cells, spec, tile_footprints(headers, spec), tiles)


def load_stack(spark: SparkSession, directory: str, spec: GridSpec | None = None,
               crs: str | None = None, when=None, **kw) -> tuple[DataFrame, GridSpec]:
    """Cells and grid of ``open_stack``."""
    stack = open_stack(spark, directory, spec, crs, when, **kw)
    return stack.cells, stack.spec


def _crop(lon_min, lon_max, lat_min, lat_max) -> jobs.Crop:
    return jobs.Crop(lon_min, lon_max, lat_min, lat_max)


def _outputs(summary: jobs.Summary, out_dir: str, actions: Actions, export_stats: bool,
             with_lc: bool) -> dict:
    # release() frees the kept product once the outputs have been used
    out = {"product": summary.product, "stats": summary.stats, "display": summary.display,
           "release": summary.release}
    if export_stats:
        sinks.write_stats_text(summary.stats, f"{out_dir}/stats")
    if actions.side_products:
        for m, prof in summary.profiles.items():
            out[f"profile_{m}"] = prof
            if actions.record:
                sinks.write_profile_csv(prof, f"{out_dir}/data_save/longitude_data_{m}")
        if with_lc and summary.zonal is not None:
            out["lc_percentages"] = summary.zonal
            if actions.record:
                sinks.write_zonal_csv(summary.zonal, f"{out_dir}/data_save/lc_percentages")
    return out


def plot_dataset(spark: SparkSession, cells: DataFrame, spec: GridSpec, out_dir: str,
                 operator: str = "mean", preset: str = "banded", coarsen: int = 1,
                 lon_min=None, lon_max=None, lat_min=None, lat_max=None, max_factor: float = 1.0,
                 vmax: float | None = None, value_factor: float = 1.0, output_data: bool = False,
                 extra_actions: str = "", lc: DataFrame | None = None,
                 lc_spec: GridSpec | None = None, exclude_lc_class=(), export_stats: bool = False,
                 plot_type: str = "standard", stop_after_save: bool = False,
                 dense: bool = True) -> dict | None:
    """Operator + coarsen, reprojection, crop, scale, statistics, display
    range, profiles and land-cover shares of a stack (E4)."""
    actions = Actions.parse(extra_actions)
    with_lc = lc is not None and actions.side_products
    s = jobs.grid_summary(
        cells, spec, operator, preset, coarsen, _crop(lon_min, lon_max, lat_min, lat_max),
        value_factor=value_factor, plot_type=plot_type, vmax=vmax, max_factor=max_factor,
        profiles=actions.methods() if actions.side_products else (),
        lc=lc if with_lc else None, lc_spec=lc_spec, exclude_lc=tuple(exclude_lc_class),
        save_path=f"{out_dir}/data_save/stack" if output_data else None,
        stop_after_save=stop_after_save, dense=dense)
    if s is None:
        return None
    return _outputs(s, out_dir, actions, export_stats, with_lc)


def plot_range(spark: SparkSession, directory: str, dates: list, out_dir: str, coarsen: int = 1,
               operator: str = "mean", low_mem: bool = False, vmax: float | None = None,
               output_data: bool = False, value_factor: float = 1.0, extra_actions: str = "",
               lc: DataFrame | None = None, lc_spec: GridSpec | None = None,
               lon_min=None, lon_max=None, lat_min=None, lat_max=None,
               max_factor: float = 1.0, exclude_lc_class=(), export_stats: bool = False,
               stop_after_save: bool = False, spec: GridSpec | None = None,
               crs: str | None = None, continue_plot: bool = False, dense: bool = True,
               format: str = "auto", overlap: str = "error", alignment: str = "outer") -> dict | None:
    """Summary over a date range or a list of ranges (E3).  ``dates`` is
    [start, end] or [[start, end], ...]; '' is an open bound.

    ``low_mem`` with ``continue_plot`` resumes: products of tiles whose
    selected dates, operator and grid are unchanged are read from
    ``<out_dir>/data_save/tile_products`` and only the others are computed
    (J10, see ``plans.products``)."""
    ranges = [tuple(d) for d in dates] if dates and isinstance(dates[0], (list, tuple)) \
        else [tuple(dates)]
    when = reduce(lambda a, b: a | b, [in_range(s_, e_) for s_, e_ in ranges])
    stack = open_stack(spark, directory, spec, crs, when, format, overlap, alignment)
    actions = Actions.parse(extra_actions)
    with_lc = lc is not None and actions.side_products
    tail = dict(box=_crop(lon_min, lon_max, lat_min, lat_max), value_factor=value_factor, vmax=vmax,
                max_factor=max_factor, profiles=actions.methods() if actions.side_products else (),
                lc=lc if with_lc else None, lc_spec=lc_spec, exclude_lc=tuple(exclude_lc_class), dense=dense)
    if low_mem and continue_plot:
        per_tile = products.resumed(select_ranges(stack.cells, ranges), stack.spec, operator,
                                    f"{out_dir}/data_save/tile_products", dense, stack.footprints)
        s = jobs.tile_summary(per_tile, stack.spec, coarsen, **tail)
    else:
        s = jobs.range_summary(
            stack.cells, stack.spec, ranges, operator, coarsen, low_mem=low_mem,
            save_path=f"{out_dir}/data_save/stack" if output_data else None,
            stop_after_save=stop_after_save, footprints=stack.footprints, **tail)
    if s is None:
        return None
    return _outputs(s, out_dir, actions, export_stats, with_lc)


def plot_composite(spark: SparkSession, directory: str, dates: list, out_dir: str,
                   coarsen: int = 1, value_factor: float = 1.0, save_composite: bool = False,
                   extra_actions: str = "", lon_min=None, lon_max=None, lat_min=None,
                   lat_max=None, export_stats: bool = False, stop_after_save: bool = False,
                   spec: GridSpec | None = None, crs: str | None = None,
                   lc: DataFrame | None = None, lc_spec: GridSpec | None = None,
                   exclude_lc_class=(), vmax: float | None = None, max_factor: float = 1.0,
                   format: str = "auto", overlap: str = "error") -> dict | None:
    """Per-composite products and statistics for the chosen dates (E2),
    all dates in one job; an empty list takes every date.  Statistics, display
    range, profiles and land-cover sums come from one pass over the product."""
    dates = list(dates or [])
    when = F.col("date").isin([F.lit(d).cast("date") for d in dates]) if dates else None
    cells, spec = load_stack(spark, directory, spec, crs, when=when, format=format, overlap=overlap)
    box = _crop(lon_min, lon_max, lat_min, lat_max)
    actions = Actions.parse(extra_actions)
    r = jobs.composite_report(cells, spec, dates, coarsen, box, value_factor,
                              lc=lc if actions.side_products else None, lc_spec=lc_spec,
                              exclude_lc=tuple(exclude_lc_class), vmax=vmax, max_factor=max_factor,
                              profiles=actions.methods() if actions.side_products else (),
                              save_path=f"{out_dir}/data_save/composites" if save_composite else None,
                              stop_after_save=stop_after_save)
    if r is None:
        return None
    out = {"product": r.product, "stats": r.stats, "display": r.display}
    if export_stats:
        sinks.write_stats_text(r.stats.drop("ord"), f"{out_dir}/stats", keys=("date",))
    tables = {f"profile_{m}": (p, f"longitude_data_{m}") for m, p in r.profiles.items()}
    if r.zonal is not None:
        tables["lc_percentages"] = (r.zonal, "lc_percentages")
    for name, (table, folder) in tables.items():
        out[name] = table
        if actions.record:
            # one file per date: a date has one row per grid row or class
            (table.repartition("date").write.mode("overwrite").partitionBy("date")
                  .option("header", True).csv(f"{out_dir}/data_save/{folder}"))
    return out


def extract_timeseries(spark: SparkSession, directory: str, dir_out: str, points: DataFrame,
                       name_column: str | None = None, time_start: str = "",
                       time_end: str = "", scale_factor: float | None = None,
                       flag_value: bool = True, flag_quality: bool = False,
                       cellbuffer_extend: int = 0, extract_area: bool = False,
                       spec: GridSpec | None = None, crs: str | None = None,
                       edge: str = "truncate", max_distance: float | None = None,
                       format: str = "auto", overlap: str = "error") -> DataFrame:
    """Per-station series (E1), one row for every station and date, written as
    CSV folders per station; the window cells are also written when
    ``extract_area``.  ``points`` needs x, y, crs and ``point_id`` (numbered
    from 0 in the table's order when absent); ``name_column`` names the
    stations, else ``point_%05d``.  ``edge="reference"``: windows past the top
    or left edge are empty."""
    when = in_range(time_start or None, time_end or None) if (time_start or time_end) else None
    cells, spec = load_stack(spark, directory, spec, crs, when=when, format=format, overlap=overlap)
    if "point_id" not in points.columns:
        points = numbered(points, "point_id")
    pts = read_points(points, name_col=name_column)
    series = jobs.point_series(cells, spec, pts, time_start or None, time_end or None,
                               buffer=cellbuffer_extend, scale_factor=scale_factor,
                               flag_value=flag_value, flag_quality=flag_quality, edge=edge,
                               max_distance=max_distance)
    sinks.write_series_csv(series, f"{dir_out}/time_series")
    if extract_area and cellbuffer_extend > 0:
        sel = select_range(cells, time_start or None, time_end or None)
        area = sample_window(sel, to_grid_crs(pts, spec.crs), spec, cellbuffer_extend, edge)
        sinks.write_cells(area, f"{dir_out}/time_series_area", float32=False)
    return series
