"""Selections: dates, date ranges, date lists, bounding boxes, display mask.

Dates arrive from the caller as Python values, so every date selection is a
literal predicate on ``date`` first: on a store partitioned by date it
becomes a partition filter and only the chosen folders are read.  The
multiplicity that overlapping ranges or repeated dates ask for is added
afterwards by a narrow ``explode`` (no join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(v) -> Column:
    return F.lit(str(v)).cast("date")


def _open(v) -> bool:
    return v is None or v == ""


def in_range(start=None, end=None, col: str = "date") -> Column:
    """Inclusive date range; None or '' is an open bound (first/last date)."""
    c = F.col(col)
    cond = F.lit(True)
    if not _open(start):
        cond = cond & (c >= _d(start))
    if not _open(end):
        cond = cond & (c <= _d(end))
    return cond


def select_range(cells: DataFrame, start=None, end=None) -> DataFrame:
    """Rows whose date lies in [start, end] (F2)."""
    return cells.where(in_range(start, end))


def select_ranges(cells: DataFrame, ranges: list[tuple], distinct: bool = False) -> DataFrame:
    """Rows in any of several ranges.

    By default the result is a bag: a date inside two overlapping ranges
    appears once per range, tagged with the range index ``k``.  With
    ``distinct=True`` each row appears once and no ``k`` is added.
    """
    if not ranges:
        raise ValueError("no date ranges given")
    conds = [in_range(s, e) for s, e in ranges]
    pruned = cells.where(reduce(lambda a, b: a | b, conds))
    if distinct:
        return pruned
    hits = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conds)]),
                    lambda v: v.isNotNull())
    return pruned.withColumn("k", F.explode(hits))


def select_dates(cells: DataFrame, dates: list[str]) -> DataFrame:
    """Rows of the requested dates.

    Requested dates that do not exist are dropped; an empty list keeps every
    date.  Request order and repeats are kept as ``ord`` (position in the
    request), one output row per occurrence.
    """
    if not dates:
        return cells.withColumn("ord", F.lit(None).cast("int"))
    positions: dict[str, list[int]] = {}
    for i, d in enumerate(dates):
        positions.setdefault(str(d), []).append(i)
    pruned = cells.where(F.col("date").isin([_d(d) for d in positions]))
    lookup = F.create_map(*[x for d, ps in positions.items()
                            for x in (_d(d), F.array(*[F.lit(p) for p in ps]))])
    return pruned.withColumn("ord", F.explode(F.element_at(lookup, F.col("date"))))


def crop(grid: DataFrame, lon_min=None, lon_max=None, lat_min=None, lat_max=None,
         x: str = "x", y: str = "y") -> DataFrame:
    """Bounding-box crop on cell centres, inclusive on both ends.
    A missing bound is the data extent, i.e. no condition on that side."""
    cond = F.lit(True)
    if lon_min is not None:
        cond = cond & (F.col(x) >= F.lit(float(lon_min)))
    if lon_max is not None:
        cond = cond & (F.col(x) <= F.lit(float(lon_max)))
    if lat_min is not None:
        cond = cond & (F.col(y) >= F.lit(float(lat_min)))
    if lat_max is not None:
        cond = cond & (F.col(y) <= F.lit(float(lat_max)))
    return grid.where(cond)


def is_cropped(lon_min=None, lon_max=None, lat_min=None, lat_max=None) -> bool:
    return any(v is not None for v in (lon_min, lon_max, lat_min, lat_max))


# Fixed value: smallest value shown on a map (display mask and colour-scale
# lower end of the standard plot).
DISPLAY_FLOOR = 0.0001


def mask_display(grid: DataFrame, floor: float = DISPLAY_FLOOR, col: str = "value") -> DataFrame:
    """Keep values > floor for display; others become NULL (F7).  Rows stay."""
    return grid.withColumn(col, F.when(F.col(col) > F.lit(floor), F.col(col)))


def scale_value(grid: DataFrame, factor: float, col: str = "value") -> DataFrame:
    """Multiply the value by a constant factor (C3); 1.0 is a no-op."""
    if factor == 1.0:
        return grid
    return grid.withColumn(col, F.col(col) * F.lit(float(factor)))


def date_bounds(df: DataFrame, col: str = "date") -> DataFrame:
    """First and last available date (O2), one row."""
    return df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date"))
