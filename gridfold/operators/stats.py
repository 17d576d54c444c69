"""Whole-grid reductions: statistics, extent, latitude profiles, display
range and colour normalisation.

Every statistic is one aggregate with a partial step (one row per task is
shuffled).  Missing values are skipped; std/var are population (ddof 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.model import GridSpec
from gridfold.operators.select import DISPLAY_FLOOR

STAT_ORDER = ("mean", "min", "max", "sum", "std", "var")


def grid_stats(grid: DataFrame, keys: tuple[str, ...] = (), col: str = "value") -> DataFrame:
    """mean, min, max, sum, std, var over the cells.

    ``keys`` (e.g. ``date``) give one row per key; without keys one row."""
    v = F.col(col)
    aggs = [F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
            F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var")]
    return grid.groupBy(*keys).agg(*aggs) if keys else grid.agg(*aggs)


def quick_stats(grid: DataFrame, keys: tuple[str, ...] = (), col: str = "value") -> DataFrame:
    """min, mean, max in one pass."""
    v = F.col(col)
    aggs = [F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max")]
    return grid.groupBy(*keys).agg(*aggs) if keys else grid.agg(*aggs)


def moments(cells: DataFrame, band_rows: int = 512, col: str = "value") -> DataFrame:
    """Mergeable partial statistics of a stack: for every date and strip of
    ``band_rows`` grid rows n, mean, m2 (sum of squared differences from the
    mean), min and max (G12).  Written with a store they answer statistics of
    any date range without reading its cells."""
    v = F.col(col)
    return (cells.groupBy("date", F.floor(F.col("iy") / F.lit(band_rows)).cast("int").alias("strip"))
            .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
                 F.min(v).alias("min"), F.max(v).alias("max")))


def merge_moments(parts: DataFrame) -> DataFrame:
    """The row of ``grid_stats`` from partial statistics: squared differences
    add up after each part's mean is moved to the common one."""
    n, total = F.col("n"), F.sum(F.col("n") * F.col("mean"))
    parts = parts.where(n > 0)
    mean = parts.agg(F.try_divide(total, F.sum(n))).scalar()
    m2 = F.sum(F.col("m2") + n * F.pow(F.col("mean") - mean, F.lit(2.0)))
    var = F.greatest(F.try_divide(m2, F.sum(n)), F.lit(0.0))
    none = F.coalesce(F.sum(n), F.lit(0)) == 0
    out = parts.agg(mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
                    F.coalesce(total, F.lit(0.0)).alias("sum"), F.when(~none, F.sqrt(var)).alias("std"),
                    F.when(~none, var).alias("var"))
    return out


def stats_long(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot a statistics row into (ord, stat, value) lines (K5)."""
    pairs = ", ".join(f"{i}, '{s}', CAST(`{s}` AS DOUBLE)" for i, s in enumerate(STAT_ORDER))
    return stats.selectExpr(*keys, f"stack({len(STAT_ORDER)}, {pairs}) AS (ord, stat, value)")


def grid_extent(grid: DataFrame, spec: GridSpec | None = None,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """Coordinate extent of the cells present (G13): centre min/max, outer
    bounds (centres +/- half a cell) and axis / cell counts."""
    hx = F.lit(spec.dx / 2 if spec else 0.0)
    hy = F.lit(spec.dy / 2 if spec else 0.0)
    aggs = [F.min("x").alias("x_min"), F.max("x").alias("x_max"),
            F.min("y").alias("y_min"), F.max("y").alias("y_max"),
            F.count_distinct("x").alias("n_x"), F.count_distinct("y").alias("n_y"),
            F.count(F.lit(1)).alias("n_cells")]
    e = grid.groupBy(*keys).agg(*aggs) if keys else grid.agg(*aggs)
    return e.select(*keys, "x_min", "x_max", "y_min", "y_max",
                    (F.col("x_min") - hx).alias("west"), (F.col("x_max") + hx).alias("east"),
                    (F.col("y_min") - hy).alias("south"), (F.col("y_max") + hy).alias("north"),
                    "n_x", "n_y", "n_cells")


PROFILE_METHODS = ("sum", "mean")


def profile(grid: DataFrame, method: str = "sum", keys: tuple[str, ...] = (),
            col: str = "value", spec: GridSpec | None = None) -> DataFrame:
    """Reduction over x for every y (G8, a latitude profile).

    A row with no valid value gives 0 for both methods.  With ``spec`` every
    row of that grid is in the profile (without ``keys`` only), also rows
    that no cell stands in."""
    if spec is not None and not keys:
        rows = grid.sparkSession.range(spec.ny).select(
            spec.y_of(F.col("id").cast("int")).alias("y"), F.lit(None).cast("double").alias(col))
        grid = grid.select("y", col).unionByName(rows)
    if method == "sum":
        e = F.coalesce(F.sum(col), F.lit(0.0))
    elif method == "mean":
        e = F.coalesce(F.avg(col), F.lit(0.0))
    else:
        raise ValueError(f"a profile is a sum or a mean, not {method!r}")
    return grid.groupBy(*keys, "y").agg(e.alias("value"))


PLOT_TYPES = ("standard", "difference")
# Fixed value: a given colour-scale maximum is never below this.
MIN_VMAX = 20.0


def display_range(quick: DataFrame, plot_type: str = "standard", vmax: float | None = None,
                  max_factor: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Colour-scale limits from (min, mean, max).

    standard:   vmax = ceil(max(max * f, mean)), or ceil(max(vmax, 20)) if
                given; vmin = 0.0001.
    difference: vmax = ceil(max(|min| * f, |max| * f)), or ceil(max(vmax, 20));
                vmin = -vmax.
    """
    f = F.lit(float(max_factor))
    if plot_type == "standard":
        top = (F.lit(float(max(vmax, MIN_VMAX))) if vmax is not None
               else F.greatest(F.col("max") * f, F.col("mean")))
        hi = F.ceil(top).cast("double")
        lo = F.lit(DISPLAY_FLOOR)
    elif plot_type == "difference":
        top = (F.lit(float(max(vmax, MIN_VMAX))) if vmax is not None
               else F.greatest(F.abs(F.col("min")) * f, F.abs(F.col("max")) * f))
        hi = F.ceil(top).cast("double")
        lo = -hi
    else:
        raise NotImplementedError(
            f"a display range is standard or difference, not {plot_type!r}")
    return quick.select(*keys, lo.cast("double").alias("vmin"), hi.alias("vmax"))


def display_norm(grid: DataFrame, limits: DataFrame, col: str = "value") -> DataFrame:
    """Colour-scale position clip((v - vmin) / (vmax - vmin), 0, 1) (C11).

    ``limits`` is the one-row output of ``display_range``; it enters the
    plan as scalar subqueries (computed once), not as a join."""
    vmin = limits.select(F.col("vmin")).scalar()
    vmax = limits.select(F.col("vmax")).scalar()
    pos = F.try_divide(F.col(col) - vmin, vmax - vmin)
    # greatest/least skip NULLs, so a missing value is kept missing explicitly
    clipped = F.least(F.greatest(pos, F.lit(0.0)), F.lit(1.0))
    return grid.withColumn("norm", F.when(pos.isNotNull(), clipped))
