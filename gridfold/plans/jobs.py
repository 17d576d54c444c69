"""User-level jobs: the summary of a date range or of single composites,
and point time series.  Each builds one logical plan per output; outputs
that share the product grid read it from one persisted copy.

Order of steps (as in the reference workflow):
save stack -> operator + coarsen -> reproject (if not lon/lat) -> crop ->
scale -> statistics -> display range -> profiles -> land-cover shares.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.model import WGS84, GridSpec
from gridfold.operators.align import footprint_rows, frame_rows, with_frame
from gridfold.operators.coarsen import coarsen, summarise
from gridfold.operators.landcover import lc_to_grid, zonal_share, zonal_sum
from gridfold.operators.points import sample_nearest, sample_window, series, to_grid_crs
from gridfold.operators.reproject import reproject_bilinear, source_window, target_grid
from gridfold.operators.select import (crop, is_cropped, scale_value, select_dates,
                                       select_range, select_ranges)
from gridfold.operators.stats import STAT_ORDER, display_range, grid_stats, profile, quick_stats
from gridfold.operators.temporal import temporal_reduce, value_band
from gridfold.session import scratch_path
from gridfold.sources.sinks import block_id, write_cells


@dataclass
class Crop:
    lon_min: float | None = None
    lon_max: float | None = None
    lat_min: float | None = None
    lat_max: float | None = None

    def kw(self) -> dict:
        return dict(lon_min=self.lon_min, lon_max=self.lon_max,
                    lat_min=self.lat_min, lat_max=self.lat_max)

    @property
    def active(self) -> bool:
        return is_cropped(**self.kw())


@dataclass
class Summary:
    """Outputs of a grid summary; all are lazy DataFrames over ``product``."""
    product: DataFrame
    spec: GridSpec
    stats: DataFrame
    display: DataFrame
    profiles: dict = field(default_factory=dict)
    zonal: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached product once its outputs have been taken."""
        self.product.unpersist()


def materialize(product: DataFrame, how: bool | str = True) -> DataFrame:
    """Keep the product for its several outputs.

    ``True``: cache (memory, spilling to disk); a lost executor's blocks are
    recomputed from lineage.  ``"checkpoint"``: write it to the session's
    checkpoint folder and cut the lineage (survives executor loss without
    recomputing the reductions).  ``False``: recompute per output."""
    if how == "checkpoint":
        from gridfold.session import shared_dir
        shared_dir(product.sparkSession)
        return product.checkpoint(eager=True)
    if how:
        return product.persist(StorageLevel.MEMORY_AND_DISK)
    return product


def sub_spec(spec: GridSpec, box: Crop) -> tuple[GridSpec, tuple[int, int, int, int]]:
    """The part of ``spec`` whose cell centres lie in ``box`` (a grid of its
    own, indices restarting at 0) and its index window in ``spec``."""
    iy_lo, iy_hi, ix_lo, ix_hi = spec.index_window(**box.kw())
    s = replace(spec, x0=spec.x0 + ix_lo * spec.dx, y0=spec.y0 - iy_lo * spec.dy,
                nx=max(0, ix_hi - ix_lo + 1), ny=max(0, iy_hi - iy_lo + 1))
    return s, (iy_lo, iy_hi, ix_lo, ix_hi)


def source_box(spec: GridSpec, k: int, box: Crop) -> tuple[int, int, int, int] | None:
    """Index window (iy_lo, iy_hi, ix_lo, ix_hi) of the source cells that a
    product can use; None for the whole grid.  On a lon/lat grid these are the
    k-blocks whose centres lie in the crop box, on a projected one the
    blocks that the bilinear step of the (cropped) lon/lat product touches."""
    if spec.crs != WGS84:
        iy_lo, iy_hi, ix_lo, ix_hi = source_window(spec.coarsened(k), product_spec(spec, k, box))
    elif box.active:
        iy_lo, iy_hi, ix_lo, ix_hi = spec.coarsened(k).index_window(**box.kw())
    else:
        return None
    return iy_lo * k, (iy_hi + 1) * k - 1, ix_lo * k, (ix_hi + 1) * k - 1


def precrop_source(cells: DataFrame, spec: GridSpec, k: int, box: Crop) -> DataFrame:
    """Keep only the cells of ``source_box``: an index-range filter on iy/ix
    that reaches the Parquet scan, before any reduction.  The exact crop on
    coordinates still follows."""
    window = source_box(spec, k, box)
    if window is None:
        return cells
    return cells.where(F.col("iy").between(*window[:2]) & F.col("ix").between(*window[2:]))


def grid_summary(cells: DataFrame, spec: GridSpec, operator: str = "mean",
                 preset: str = "banded", k: int = 1, box: Crop | None = None,
                 value_factor: float = 1.0, plot_type: str = "standard",
                 vmax: float | None = None, max_factor: float = 1.0,
                 profiles: tuple[str, ...] = ("sum", "mean"),
                 lc: DataFrame | None = None, lc_spec: GridSpec | None = None,
                 exclude_lc: tuple[str, ...] = (), persist: bool | str = True,
                 bucket_block: int | None = None, save_path: str | None = None,
                 stop_after_save: bool = False, dense: bool = False) -> Summary | None:
    """Summary of a stack (E4): product grid, statistics, display range,
    latitude profiles and land-cover shares.  ``dense``: cells of the grid
    without any row count as missing in every composite, as in an array (a sum
    is 0 there, a profile has every grid row).  ``bucket_block``: the stack
    is a bucketed store (see ``summarise``).  ``save_path``: the stack as
    given (before any reduction) is written there first; with
    ``stop_after_save`` nothing else is computed (returns None)."""
    if save_path is not None:
        write_cells(cells, save_path)
        if stop_after_save:
            return None
    box = box or Crop()
    reproject = spec.crs != WGS84
    if operator == "only_plot" and "date" in value_band(cells).columns:
        raise ValueError("grid_summary reduces over time; use composite_summary per date")
    src = precrop_source(cells, spec, k, box)
    if dense and operator != "only_plot":
        src = value_band(src)
        src = src.select([c for c in ("date", "iy", "ix", "blk", "value") if c in src.columns])
        frame = frame_rows(cells.sparkSession, spec, source_box(spec, k, box))
        if "blk" in src.columns:
            frame = frame.withColumn("blk", block_id(spec, bucket_block))
        src = with_frame(src, frame)
    product = summarise(src, operator, k, spec, preset, bucket_block)
    pspec = spec.coarsened(k)
    if reproject:
        dst = product_spec(spec, k, box)
        product = reproject_bilinear(product, pspec, dst)
        pspec = dst
    return summary_of_product(product, pspec, box, value_factor, plot_type, vmax, max_factor,
                               profiles, lc, lc_spec, exclude_lc, persist, dense)


def range_summary(cells: DataFrame, spec: GridSpec, ranges: list[tuple], operator: str = "mean",
                  k: int = 1, low_mem: bool = False, save_path: str | None = None,
                  stop_after_save: bool = False, footprints: DataFrame | None = None,
                  **kw) -> Summary | None:
    """Summary over date ranges (E3).  Overlapping ranges count a date once
    per range.  ``low_mem`` reproduces the per-tile path: the operator per
    tile first, then blocks by ``max`` (a different answer when k > 1).
    ``save_path`` writes the selected stack (with its range index ``k``)
    before the reduction; the low-memory path saves the per-tile product
    instead, as its stack no longer exists.

    ``dense=True`` is the rule of arrays for cells without rows: they are
    missing in every composite of the grid, or on the low-memory path of
    their tile (``footprints``: tile, iy_lo, iy_hi, ix_lo, ix_hi; by default
    the bounds of each tile's cells), where no tile reaches staying missing."""
    sel = select_ranges(cells, ranges)
    if save_path is not None and not low_mem:
        write_cells(sel, save_path)
        if stop_after_save:
            return None
    if low_mem:
        if operator not in ("mean", "sum"):
            raise ValueError(f"the per-tile path reduces by mean or sum, not {operator!r}")
        per_tile = tile_products(sel, spec, operator, kw.get("dense", False), footprints)
        if save_path is not None:
            write_cells(per_tile, save_path)
            if stop_after_save:
                return None
        return tile_summary(per_tile, spec, k, **kw)
    return grid_summary(sel, spec, operator, "banded", k, **kw)


def tile_bounds(cells: DataFrame) -> DataFrame:
    """Footprint of each tile as far as its cells show it."""
    return cells.groupBy("tile").agg(F.min("iy").alias("iy_lo"), F.max("iy").alias("iy_hi"),
                                     F.min("ix").alias("ix_lo"), F.max("ix").alias("ix_hi"))


def tile_products(cells: DataFrame, spec: GridSpec, operator: str, dense: bool = False,
                  footprints: DataFrame | None = None) -> DataFrame:
    """Every tile reduced over its dates (the low-memory form, G3); ``dense``
    as in ``range_summary``."""
    cells = value_band(cells).select("tile", "iy", "ix", "value")
    if dense:
        cells = with_frame(cells, footprint_rows(tile_bounds(cells) if footprints is None else footprints))
    return temporal_reduce(cells, operator, spec, keys=("tile",))


def tile_summary(per_tile: DataFrame, spec: GridSpec, k: int, **kw) -> Summary:
    """Summary of per-tile products, new or read again: blocks by ``max``,
    reprojection, crop and scale as on the other path."""
    box = kw.get("box") or Crop()
    # the crop's source window reaches the scan or the reduction
    product = coarsen(precrop_source(per_tile, spec, k, box).drop("tile"), k, "max", spec)
    pspec = spec.coarsened(k)
    if spec.crs != WGS84:
        dst = product_spec(spec, k, box)
        product, pspec = reproject_bilinear(product, pspec, dst), dst
    return summary_of_product(product, pspec, **kw)


def summary_of_product(product: DataFrame, pspec: GridSpec, box: Crop | None = None,
                        value_factor: float = 1.0, plot_type: str = "standard",
                        vmax=None, max_factor: float = 1.0,
                        profiles=("sum", "mean"), lc=None, lc_spec=None,
                        exclude_lc=(), persist: bool | str = True, dense: bool = False) -> Summary:
    box = box or Crop()
    rows = sub_spec(pspec, box)[0] if box.active else pspec
    product = materialize(scale_value(crop(product, **box.kw()), value_factor), persist)
    stats = grid_stats(product)
    disp = display_range(quick_stats(product), plot_type, vmax, max_factor)
    profs = {m: profile(product, m, spec=rows if dense else None) for m in profiles}
    zonal = None
    if lc is not None and lc_spec is not None:
        window = pspec.index_window(**box.kw()) if box.active else None
        lcg = crop(lc_to_grid(lc, lc_spec, pspec, window), **box.kw())
        zonal = zonal_share(zonal_sum(product, lcg), exclude_lc)
    return Summary(product, pspec, stats, disp, profs, zonal)


def composite_product(cells: DataFrame, spec: GridSpec, dates: list[str], k: int = 1,
                      box: Crop | None = None, value_factor: float = 1.0) -> DataFrame:
    """Products (ord, date, iy, ix, y, x, value) of the requested dates."""
    box = box or Crop()
    sel = select_dates(precrop_source(cells, spec, k, box), dates)
    product = coarsen(value_band(sel), k, "max", spec, keys=("ord", "date"))
    if spec.crs != WGS84:
        product = reproject_bilinear(product, spec.coarsened(k), product_spec(spec, k, box),
                                     keys=("ord", "date"))
    return scale_value(crop(product, **box.kw()), value_factor)


def _save_composites(cells: DataFrame, dates: list[str], save_path: str) -> None:
    """Each chosen composite once, even when the request repeats a date."""
    unique = list(dict.fromkeys(dates))
    write_cells(value_band(select_dates(cells, unique)).drop("ord"), save_path)


def composite_summary(cells: DataFrame, spec: GridSpec, dates: list[str], k: int = 1,
                      box: Crop | None = None, value_factor: float = 1.0,
                      save_path: str | None = None,
                      stop_after_save: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """Per-composite products and statistics for the requested dates (E2),
    all dates in one job: ``ord`` (request position) and ``date`` are group
    keys instead of a loop.  Returns (product, stats).  ``save_path``: the
    chosen composites (value band, full resolution) are written first."""
    if save_path is not None:
        _save_composites(cells, dates, save_path)
        if stop_after_save:
            return None
    product = composite_product(cells, spec, dates, k, box, value_factor)
    return product, grid_stats(product, keys=("ord", "date"))


@dataclass
class CompositeReport:
    """Outputs of ``composite_report``; all but ``product`` read one small table."""
    product: DataFrame
    stats: DataFrame
    display: DataFrame
    profiles: dict
    zonal: DataFrame | None = None


def composite_report(cells: DataFrame, spec: GridSpec, dates: list[str], k: int = 1,
                     box: Crop | None = None, value_factor: float = 1.0, lc: DataFrame | None = None,
                     lc_spec: GridSpec | None = None, exclude_lc: tuple[str, ...] = (),
                     vmax: float | None = None, max_factor: float = 1.0, plot_type: str = "standard",
                     profiles: tuple[str, ...] = ("sum", "mean"), save_path: str | None = None,
                     stop_after_save: bool = False) -> CompositeReport | None:
    """Everything a composite summary gives (E2) from one pass: statistics,
    profiles and land-cover sums are grouping sets over (ord, date), the grid
    row and the class, reduced in one aggregate and written as one table of a
    row per date, date and grid row, and date and class."""
    if save_path is not None:
        _save_composites(cells, dates, save_path)
        if stop_after_save:
            return None
    box = box or Crop()
    product = composite_product(cells, spec, dates, k, box, value_factor)
    pspec = product_spec(spec, k, box)
    with_lc = lc is not None and lc_spec is not None
    lcg = None
    source = product
    if with_lc:
        window = pspec.index_window(**box.kw()) if box.active else None
        lcg = crop(lc_to_grid(lc, lc_spec, pspec, window), **box.kw()).select("iy", "ix", "lc_code")
        source = product.join(lcg, ["iy", "ix"], "left")
    keys = ("ord", "date")
    v = F.col("value")
    sets = [[*keys], *([[*keys, "y"]] if profiles else []), *([[*keys, "lc_code"]] if with_lc else [])]
    columns = list(dict.fromkeys(c for one in sets for c in one))
    parts = source.groupingSets([[F.col(c) for c in one] for one in sets], *columns).agg(
        F.grouping_id().alias("level"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"))
    path = scratch_path(cells.sparkSession, "composite-report")
    parts.write.parquet(path)
    table = cells.sparkSession.read.schema(parts.schema).parquet(path)

    def level(one):
        """The rows of a grouping set: its id has a bit for each column left out."""
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in one)
        return table.where(F.col("level") == bits)
    stats = level(keys).select(*keys, *STAT_ORDER)
    profs = {m: level((*keys, "y")).select(*keys, "y", F.coalesce(F.col(m), F.lit(0.0)).alias("value")) for m in profiles}
    zonal = None
    if with_lc:
        # a class of the grid without values on a date has a sum of 0 there
        classes = lcg.where("lc_code is not null").select("lc_code").distinct()
        pairs = level(keys).select(*keys, F.explode(classes.agg(F.collect_list("lc_code")).scalar()).alias("lc_code"))
        sums = level((*keys, "lc_code")).select(*[F.col(c).alias(f"_{c}") for c in (*keys, "lc_code")], "sum")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("lc_code") == F.col("_lc_code")]
        found = pairs.join(sums, same, "left").select(
            *keys, "lc_code", F.coalesce(F.col("sum"), F.lit(0.0)).alias("gpp_sum"))
        zonal = zonal_share(found, exclude_lc, keys=keys)
    display = display_range(stats.select(*keys, "min", "mean", "max"), plot_type, vmax, max_factor, keys=keys)
    return CompositeReport(product, stats, display, profs, zonal)


def product_spec(spec: GridSpec, k: int, box: Crop | None = None) -> GridSpec:
    """Grid of a product: the k-coarsened grid, or for a projected stack the
    lon/lat target grid (restricted to the crop box when there is one)."""
    box = box or Crop()
    pspec = spec.coarsened(k)
    if spec.crs == WGS84:
        return pspec
    full = target_grid(pspec, WGS84, **box.kw())
    return sub_spec(full, box)[0] if box.active else full


def composite_zonal(product: DataFrame, pspec: GridSpec, lc: DataFrame, lc_spec: GridSpec,
                    box: Crop | None = None, exclude_lc: tuple[str, ...] = ()) -> DataFrame:
    """Land-cover shares of every composite (per ``ord``, ``date``)."""
    box = box or Crop()
    window = pspec.index_window(**box.kw()) if box.active else None
    lcg = crop(lc_to_grid(lc, lc_spec, pspec, window), **box.kw())
    keys = ("ord", "date")
    return zonal_share(zonal_sum(product, lcg, keys), exclude_lc, keys=keys)


def point_series(cells: DataFrame, spec: GridSpec, points: DataFrame, start=None, end=None,
                 buffer: int = 0, scale_factor: float | None = None, flag_value: bool = True,
                 flag_quality: bool = False, edge: str = "truncate",
                 points_crs: str | None = None, max_distance: float | None = None) -> DataFrame:
    """Time series at points (E1): date range -> points in the grid CRS ->
    nearest cell (buffer 0) or window mean -> per-station series, one row for
    every station and date of the selection."""
    if not (flag_value or flag_quality):
        raise ValueError("a series needs its values, its quality flags or both")
    sel = select_range(cells, start, end)
    if points_crs is None:
        pts = to_grid_crs(points, spec.crs)
    elif points_crs == spec.crs:
        pts = points
    else:
        pts = to_grid_crs(points.withColumn("crs", F.lit(points_crs)), spec.crs)
    if buffer > 0:
        sampled = sample_window(sel, pts, spec, buffer, edge)
    else:
        sampled = sample_nearest(sel, pts, spec, max_distance=max_distance)
    return series(sampled, scale_factor, flag_value, flag_quality)
