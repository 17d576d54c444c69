"""Reductions over time.

Missing values (NULL, or an absent row) are skipped.  ``mean`` of a cell
with no valid value is NULL; ``sum`` of such a cell is 0, as a NaN-skipping
sum gives.  Both are hash aggregates with a map-side partial step, so a
task's rows are combined per cell before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.model import VALUE_BAND, GridSpec

OPERATORS = ("mean", "sum")


def reduce_expr(op: str, col: str = "value") -> Column:
    if op == "mean":
        return F.avg(col)
    if op == "sum":
        return F.coalesce(F.sum(col), F.lit(0.0))
    if op == "max":
        return F.max(col)
    if op == "min":
        return F.min(col)
    raise ValueError(f"no time reduction {op!r}: use mean or sum")


def value_band(cells: DataFrame) -> DataFrame:
    """The value band of either shape (wide: column ``value``; long: band 1)."""
    if "band" in cells.columns:
        return cells.where(F.col("band") == F.lit(VALUE_BAND)).drop("band")
    return cells


def temporal_reduce(cells: DataFrame, op: str = "mean", spec: GridSpec | None = None,
                    keys: tuple[str, ...] = (), col: str = "value") -> DataFrame:
    """Reduce each cell over all its dates (G1 mean, G2 sum).

    ``keys`` are extra group keys kept in the output (``tile`` for the
    per-tile form, G3; ``year`` for roll-ups).  Coordinates are recomputed
    from ``spec`` instead of being carried through the shuffle.
    """
    if op not in OPERATORS:
        raise ValueError(f"no time reduction {op!r}: use mean or sum")
    cells = value_band(cells)
    out = cells.groupBy(*keys, "iy", "ix").agg(reduce_expr(op, col).alias("value"))
    if spec is not None:
        out = spec.with_coords(out)
    else:
        out = out.withColumn("y", F.lit(None).cast("double")).withColumn("x", F.lit(None).cast("double"))
    return out.select(*keys, "iy", "ix", "y", "x", "value")


def tile_temporal(cells: DataFrame, op: str = "mean", spec: GridSpec | None = None) -> DataFrame:
    """Per-tile temporal reduction (G3): every tile over all dates.

    A cell belongs to one tile, so ``tile`` only joins the group key; the
    result equals the whole-grid reduction and can be written per tile."""
    return temporal_reduce(cells, op, spec, keys=("tile",))


def yearly_sum_mean(cells: DataFrame, spec: GridSpec | None = None, dense: bool = False) -> DataFrame:
    """Sum per cell and calendar year, then the mean of those yearly sums
    over the years present for the cell (G15).

    A year in which a cell has rows but no valid value contributes a sum of 0;
    a year without any row for the cell is not counted.  ``dense`` is the rule
    of arrays: every cell of ``spec`` has a sum (0 at least) in every year of
    the stack.  The mean of the yearly sums is then the whole sum over the
    number of years, so one aggregate and one shuffle do."""
    cells = value_band(cells)
    if dense:
        from gridfold.operators.align import frame_rows, with_frame
        years = cells.select(F.count_distinct(F.year("date"))).scalar()
        narrow = cells.select("iy", "ix", "value")
        total = (with_frame(narrow, frame_rows(cells.sparkSession, spec)).groupBy("iy", "ix")
                 .agg(reduce_expr("sum").alias("value")))
        out = total.select("iy", "ix", F.try_divide(F.col("value"), years.cast("double")).alias("value"),
                           years.alias("n_years"))
        return spec.with_coords(out).select("iy", "ix", "y", "x", "value", "n_years")
    yearly = (cells.groupBy(F.year("date").alias("year"), "iy", "ix")
                   .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")))
    out = yearly.groupBy("iy", "ix").agg(F.avg("value").alias("value"),
                                         F.count(F.lit(1)).alias("n_years"))
    if spec is not None:
        out = spec.with_coords(out)
    return out.select("iy", "ix", "y", "x", "value", "n_years")
