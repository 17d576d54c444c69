"""Land cover on the product grid: mode resampling, zonal sums and shares.

The land-cover raster is brought onto the grid of the product (mode of the
fine cells whose centres fall into a product cell; ties -> smallest code),
then joined to the product cell by cell and reduced per class.  The class
group has at most 11 keys; its partial aggregate leaves <= 11 rows per task,
so a class covering most of the grid does not skew the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.functions.labels import lc_label
from gridfold.functions.projection import transform, transform_bounds
from gridfold.model import GridSpec
from gridfold.operators.align import frame_rows
from gridfold.operators.reproject import source_window


def fine_window(lc_spec: GridSpec, spec: GridSpec, window) -> tuple[int, int, int, int]:
    """Rows/columns of the land-cover raster whose centres can fall into the
    product cells ``window`` = (iy_lo, iy_hi, ix_lo, ix_hi), one cell of
    margin on each side (the exact mapping still decides)."""
    iy_lo, iy_hi, ix_lo, ix_hi = window

    def rng(origin_t, step_t, lo, hi, origin_f, step_f, sign):
        # fine index r has centre origin_f + sign * (r + 0.5) * step_f
        a = sign * (origin_t - origin_f) / step_f + lo * step_t / step_f - 0.5
        b = sign * (origin_t - origin_f) / step_f + (hi + 1) * step_t / step_f - 0.5
        return int(math.floor(a)) - 1, int(math.ceil(b)) + 1
    r_lo, r_hi = rng(spec.y0, spec.dy, iy_lo, iy_hi, lc_spec.y0, lc_spec.dy, -1)
    c_lo, c_hi = rng(spec.x0, spec.dx, ix_lo, ix_hi, lc_spec.x0, lc_spec.dx, 1)
    return r_lo, r_hi, c_lo, c_hi


def _is_finer(lc_spec: GridSpec, spec: GridSpec) -> bool:
    """Whether land-cover cells are at most as large as the product's, by their
    mean size in the product's CRS."""
    if lc_spec.crs == spec.crs:
        return lc_spec.dx <= spec.dx and lc_spec.dy <= spec.dy
    w, s, e, n = transform_bounds(lc_spec.crs, spec.crs, lc_spec.bounds)
    return (e - w) / lc_spec.nx <= spec.dx and (n - s) / lc_spec.ny <= spec.dy


def _window_in(lc_spec: GridSpec, spec: GridSpec, window) -> tuple[int, int, int, int]:
    """Land-cover index window under a product window in another CRS."""
    iy_lo, iy_hi, ix_lo, ix_hi = window
    part = replace(spec, x0=spec.x0 + ix_lo * spec.dx, y0=spec.y0 - iy_lo * spec.dy,
                   nx=max(1, ix_hi - ix_lo + 1), ny=max(1, iy_hi - iy_lo + 1))
    return source_window(lc_spec, part)


def lc_to_grid(lc: DataFrame, lc_spec: GridSpec, spec: GridSpec, window=None) -> DataFrame:
    """Land cover (iy, ix, lc_code on ``lc_spec``) onto ``spec``.

    Finer land cover: every fine centre votes for the product cell that
    contains it; the most frequent code wins, the smallest on ties; NULL
    codes do not vote.  Coarser land cover: each product cell takes the fine
    cell that contains its centre (a frame of the product grid joined by
    index).  Centres are projected where the two grids differ in CRS."""
    if _is_finer(lc_spec, spec):
        if window is not None:
            # only the land cover under the product window is read
            r_lo, r_hi, c_lo, c_hi = (fine_window if lc_spec.crs == spec.crs else _window_in)(lc_spec, spec, window)
            lc = lc.where(F.col("iy").between(r_lo, r_hi) & F.col("ix").between(c_lo, c_hi))
        x, y = transform(lc_spec.crs, spec.crs, lc_spec.x_of("ix"), lc_spec.y_of("iy"))
        m = lc.select(spec.iy_of(y).alias("iy"), spec.ix_of(x).alias("ix"), "lc_code")
        m = m.where(F.col("iy").between(0, spec.ny - 1) & F.col("ix").between(0, spec.nx - 1))
        out = m.groupBy("iy", "ix").agg(F.mode("lc_code", True).cast("int").alias("lc_code"))
    else:
        frame = frame_rows(lc.sparkSession, spec, window)
        x, y = transform(spec.crs, lc_spec.crs, spec.x_of("ix"), spec.y_of("iy"))
        probe = frame.select("iy", "ix", lc_spec.iy_of(y).alias("fiy"), lc_spec.ix_of(x).alias("fix"))
        out = probe.join(lc.select(F.col("iy").alias("fiy"), F.col("ix").alias("fix"), "lc_code"),
                         ["fiy", "fix"]).select("iy", "ix", "lc_code")
    return spec.with_coords(out).select("iy", "ix", "y", "x", "lc_code")


def lc_classes(lc_grid: DataFrame) -> DataFrame:
    """Distinct non-null class codes present."""
    return lc_grid.where(F.col("lc_code").isNotNull()).select("lc_code").distinct()


def with_labels(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``lc_label`` for ``lc_code``."""
    return df.withColumn("lc_label", lc_label("lc_code", strict))


def zonal_sum(grid: DataFrame, lc_grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the product per land-cover class.

    Every class present on the grid appears, with 0 when none of its cells
    has a value; NULL classes are skipped.  ``keys`` (e.g. ``ord``, ``date``)
    give one set of sums per key: the (key, class) pairs are the distinct
    keys of ``grid`` exploded over the <= 11 classes, so a class without
    values on some date still gets its 0 there."""
    lc = lc_grid.where(F.col("lc_code").isNotNull()).select("iy", "ix", "lc_code")
    if not keys:
        joined = lc.join(grid.select("iy", "ix", "value"), ["iy", "ix"], "left")
        return joined.groupBy("lc_code").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("gpp_sum"))
    sums = (grid.select(*keys, "iy", "ix", "value").join(lc, ["iy", "ix"])
                .groupBy(*keys, "lc_code").agg(F.sum("value").alias("s")))
    key_set = grid.select(F.collect_set(F.struct(*keys))).scalar()   # one entry per key value
    pairs = (lc.select("lc_code").distinct()
               .select("lc_code", F.explode(key_set).alias("k"))
               .select(*[F.col(f"k.{c}").alias(c) for c in keys], "lc_code"))
    # keys may be null (``ord`` of an open date list): null meets null
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "lc_code")], "s")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "lc_code")])
    return (pairs.join(sums, same, "left")
                 .select(*keys, "lc_code", F.coalesce(F.col("s"), F.lit(0.0)).alias("gpp_sum")))


def zonal_share(zonal: DataFrame, exclude_labels: list[str] | tuple = (),
                strict: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of each class in the total, in percent with one decimal,
    rounded half to even (G11, C9).  Classes are excluded by label before the
    total is taken, so the shares of the rest add up to 100 (F8).  With
    ``keys`` the total is taken per key (a window over <= 11 rows a key)."""
    z = with_labels(zonal, strict)
    if exclude_labels:
        z = z.where(~F.coalesce(F.col("lc_label").isin(list(exclude_labels)), F.lit(False)))
    if keys:
        total = F.sum("gpp_sum").over(Window.partitionBy(*keys))
    else:
        total = z.agg(F.sum("gpp_sum")).scalar()   # <= 11 rows, computed once
    pct = F.bround(F.try_divide(F.col("gpp_sum"), total) * F.lit(100.0), 1)
    return z.select(*keys, "lc_code", "lc_label", "gpp_sum", pct.alias("percentage"))
