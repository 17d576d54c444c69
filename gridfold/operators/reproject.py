"""Bilinear reprojection of a grid to a longitude/latitude grid.

A target centre lies among four source cells; the upper left one is its base.
Every source value is sent to the (up to four) bases it serves, and one
aggregate by base lines up the four values: the only shuffle.  The target
cells of a base are then listed from the inverse of the projection, tested
with the forward formula, and weighted on the spot.  The result is
sum(w * v) / sum(w) over the neighbours that have a value (weights are
renormalised), NULL (absent row) when none has.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions.projection import latitude, longitude, transform, transform_bounds
from gridfold.model import WGS84, GridSpec
from gridfold.operators.select import is_cropped

# Fixed value: effective width in pixels of the displayed map; a cropped
# product is never made finer than extent / 1600.
DISPLAY_PIXELS = 1600


def target_resolution(spec: GridSpec, dst_crs: str = WGS84, lon_min=None, lon_max=None,
                      lat_min=None, lat_max=None) -> tuple[float, tuple]:
    """Resolution rule of the target grid (J6a) and the transformed bounds.

    r = min(extent_lon / nx, extent_lat / ny) with the grid's own nx, ny;
    when cropped the extents are those of the crop box (open sides from the
    data) and r = max(r, max(extent_lon, extent_lat) / 1600)."""
    tb = transform_bounds(spec.crs, dst_crs, spec.bounds)
    w, s, e, n = tb
    if is_cropped(lon_min, lon_max, lat_min, lat_max):
        w = w if lon_min is None else lon_min
        e = e if lon_max is None else lon_max
        s = s if lat_min is None else lat_min
        n = n if lat_max is None else lat_max
    ext_lon, ext_lat = abs(e - w), abs(n - s)
    r = min(ext_lon / spec.nx, ext_lat / spec.ny)
    if is_cropped(lon_min, lon_max, lat_min, lat_max):
        r = max(r, max(ext_lon, ext_lat) / DISPLAY_PIXELS)
    return r, tb


def target_resolution_df(extent: DataFrame, nx: int, ny: int, lon_min=None, lon_max=None,
                         lat_min=None, lat_max=None) -> DataFrame:
    """The same rule as a column expression over a one-row extent
    (west, east, south, north), e.g. the output of ``grid_extent``."""
    cropped = is_cropped(lon_min, lon_max, lat_min, lat_max)

    def pick(v, col):
        return F.col(col) if v is None else F.lit(float(v))
    w, e = pick(lon_min, "west"), pick(lon_max, "east")
    s, n = pick(lat_min, "south"), pick(lat_max, "north")
    ext_lon, ext_lat = F.abs(e - w), F.abs(n - s)
    r = F.least(ext_lon / F.lit(nx), ext_lat / F.lit(ny))
    if cropped:
        r = F.greatest(r, F.greatest(ext_lon, ext_lat) / F.lit(DISPLAY_PIXELS))
    return extent.select(ext_lon.alias("extent_lon"), ext_lat.alias("extent_lat"),
                         r.alias("resolution"))


def target_grid(spec: GridSpec, dst_crs: str = WGS84, **crop) -> GridSpec:
    """Target grid: the transformed bounds at the rule's resolution, anchored
    at their north-west corner."""
    r, (w, s, e, n) = target_resolution(spec, dst_crs, **crop)
    nx = max(1, int(math.floor((e - w) / r + 0.5)))
    ny = max(1, int(math.floor((n - s) / r + 0.5)))
    return GridSpec(x0=w, y0=n, dx=r, dy=r, nx=nx, ny=ny, crs=dst_crs)


def source_window(src: GridSpec, dst: GridSpec, margin: int = 1):
    """Index window of ``src`` that the target grid can touch (+ margin), to
    restrict the source before the join (a pushable range filter)."""
    sb = transform_bounds(dst.crs, src.crs, dst.bounds)
    w, s, e, n = sb
    ix_lo = max(0, int(math.floor((w - src.x0) / src.dx)) - margin)
    ix_hi = min(src.nx - 1, int(math.floor((e - src.x0) / src.dx)) + margin)
    iy_lo = max(0, int(math.floor((src.y0 - n) / src.dy)) - margin)
    iy_hi = min(src.ny - 1, int(math.floor((src.y0 - s) / src.dy)) + margin)
    return iy_lo, iy_hi, ix_lo, ix_hi


def _places(src: GridSpec, dst: GridSpec) -> tuple:
    """Fractional source index (u, v) of the target centre (tiy, tix)."""
    sx, sy = transform(dst.crs, src.crs, dst.x_of("tix"), dst.y_of("tiy"))
    return ((sx - F.lit(src.x0)) / F.lit(src.dx) - F.lit(0.5),
            (F.lit(src.y0) - sy) / F.lit(src.dy) - F.lit(0.5))


def _listed(lo, hi, n: int):
    """The whole numbers from lo to hi within 0 .. n - 1, none if lo > hi."""
    lo = F.greatest(F.floor(lo), F.lit(0)).cast("int")
    hi = F.least(F.ceil(hi), F.lit(n - 1)).cast("int")
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def targets_of_bases(bases: DataFrame, src: GridSpec, dst: GridSpec) -> DataFrame:
    """The target cells (tiy, tix) of each base (j, i), with fu and fv, their
    place between the four cells.  On the projections known here y depends on
    the latitude only, and x grows with the longitude along a row."""
    if dst.crs != WGS84:
        raise ValueError("the target of a reprojection is a longitude/latitude grid")
    top = F.lit(src.y0) - (F.col("j") + F.lit(0.5)) * F.lit(src.dy)
    west = F.lit(src.x0) + (F.col("i") + F.lit(0.5)) * F.lit(src.dx)
    row = [(F.lit(dst.y0) - latitude(src.crs, y)) / F.lit(dst.dy) - F.lit(0.5) for y in (top, top - F.lit(src.dy))]
    rows = bases.withColumn("tiy", _listed(*row, dst.ny))
    lat = dst.y_of("tiy")
    column = [(longitude(src.crs, x, lat) - F.lit(dst.x0)) / F.lit(dst.dx) - F.lit(0.5)
              for x in (west, west + F.lit(src.dx))]
    cells = rows.withColumn("tix", _listed(*column, dst.nx))
    u, v = _places(src, dst)
    cells = cells.withColumns({"u": u, "v": v})
    return (cells.where((F.floor("u") == F.col("i")) & (F.floor("v") == F.col("j"))
                        & F.col("u").between(-0.5, src.nx - 0.5) & F.col("v").between(-0.5, src.ny - 0.5))
            .withColumns({"fu": F.col("u") - F.col("i"), "fv": F.col("v") - F.col("j")}).drop("u", "v"))


def reproject_bilinear(grid: DataFrame, src: GridSpec, dst: GridSpec,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    """Resample ``grid`` (on ``src``) to ``dst`` bilinearly.

    ``keys`` (e.g. ``date``) resample several grids in one job."""
    iy_lo, iy_hi, ix_lo, ix_hi = source_window(src, dst)
    source = grid.where(F.col("iy").between(iy_lo, iy_hi) & F.col("ix").between(ix_lo, ix_hi)
                        & F.col("value").isNotNull()).select(*keys, "iy", "ix", "value")
    corners = [(dj, di) for dj in (0, 1) for di in (0, 1)]
    serves = F.explode(F.array(*[F.struct((F.col("iy") - dj).alias("j"), (F.col("ix") - di).alias("i"),
                                          F.lit(n).alias("n")) for n, (dj, di) in enumerate(corners)]))
    bases = (source.select(*keys, "value", serves.alias("_b")).groupBy(*keys, F.col("_b.j").alias("j"), F.col("_b.i").alias("i"))
             .agg(*[F.max(F.when(F.col("_b.n") == n, F.col("value"))).alias(f"v{n}") for n in range(4)]))
    cells = targets_of_bases(bases, src, dst)
    weight = {n: (F.col("fv") if dj else 1 - F.col("fv")) * (F.col("fu") if di else 1 - F.col("fu"))
              for n, (dj, di) in enumerate(corners)}
    none = F.lit(0.0)
    total = sum((F.when(F.col(f"v{n}").isNotNull(), w).otherwise(none) for n, w in weight.items()), none)
    value = sum((F.coalesce(F.col(f"v{n}") * w, none) for n, w in weight.items()), none)
    out = (cells.withColumns({"_w": total, "_v": value}).where(F.col("_w") > 0)
           .select(*keys, F.col("tiy").alias("iy"), F.col("tix").alias("ix"), (F.col("_v") / F.col("_w")).alias("value")))
    return dst.with_coords(out).select(*keys, "iy", "ix", "y", "x", "value")
