"""Sampling the stack at points: nearest cell or the mean of a window.

Every station has one row for every date of the stack, with NULL where it has
no valid cell.  Points are indexed on the grid with column arithmetic; points
of one cell have the same series, so series are made once for each distinct
cell asked for and then joined to the points.  Work and memory before that join
are bounded by the grid and its dates, however many points there are; more
than a few points are shuffled, never broadcast.  Windows are joined to the cells
by square blocks as wide as the window, so a window is at most four join rows
whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.projection import transform
from gridfold.model import GridSpec
from gridfold.operators.align import dates_of
from gridfold.plans.broadcast import row_count_at_most


def to_grid_crs(points: DataFrame, crs: str) -> DataFrame:
    """Points (x, y, crs) -> the grid's CRS (C8).  The points' CRS must be a
    single value (checked with a bounded action: at most two distinct
    values reach the driver)."""
    src = points.select("crs").where(F.col("crs").isNotNull()).distinct().limit(2).collect()
    if not src:
        return points
    if len(src) > 1:
        raise ValueError("points carry more than one CRS; convert them per CRS")
    src_crs = src[0][0]
    if src_crs == crs:
        return points
    x, y = transform(src_crs, crs, F.col("x"), F.col("y"))
    # both coordinates from the old pair in one projection
    return points.withColumns({"x": x, "y": y, "crs": F.lit(crs)})


def nearest_index(points: DataFrame, spec: GridSpec, tie: str = "coord") -> DataFrame:
    """Add the nearest cell (iy, ix) of every point, with no distance limit:
    outside points snap to the edge (D24).

    ``tie="coord"``: midway points go to the larger coordinate on both axes
    (label-based nearest); ``tie="index"``: to the higher index on both axes
    (i.e. larger x but smaller y; the window path)."""
    u = (F.col("x") - F.lit(spec.x0)) / F.lit(spec.dx) - F.lit(0.5)
    v = (F.lit(spec.y0) - F.col("y")) / F.lit(spec.dy) - F.lit(0.5)
    ix = F.floor(u + F.lit(0.5))
    if tie == "coord":
        iy = F.ceil(v - F.lit(0.5))
    elif tie == "index":
        iy = F.floor(v + F.lit(0.5))
    else:
        raise ValueError(f"unknown tie rule {tie}")

    def clamp(c, n):
        return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    return points.withColumn("iy", clamp(iy, spec.ny)).withColumn("ix", clamp(ix, spec.nx))


def _value_cols(cells: DataFrame) -> list[str]:
    return [c for c in ("value", "qflag") if c in cells.columns]


MAX_ROW_RUNS = 32


def row_runs(rows: list[int], max_runs: int = MAX_ROW_RUNS) -> list[tuple[int, int]]:
    """Sorted grid rows -> at most ``max_runs`` inclusive ranges covering
    them (the widest gaps stay open)."""
    rows = sorted(set(rows))
    gaps = sorted(range(1, len(rows)), key=lambda i: rows[i - 1] - rows[i])
    cuts = sorted(i for i in gaps[:max_runs - 1] if rows[i] - rows[i - 1] > 1)
    return [(rows[a], rows[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(rows)])] if rows else []


def prune_rows(cells: DataFrame, indexed: DataFrame, buffer: int = 0) -> DataFrame:
    """Keep only the grid rows the points need, as ``iy`` ranges that reach
    the Parquet scan (row groups and strip files of other rows are skipped).
    The distinct rows are bounded by the grid height, however many points."""
    rows = [r[0] for r in indexed.select("iy").distinct().collect() if r[0] is not None]
    if not rows:
        return cells.where(F.lit(False))
    cond = None
    for a, b in row_runs(rows):
        c = F.col("iy").between(a - buffer, b + buffer)
        cond = c if cond is None else cond | c
    return cells.where(cond)


def join_windows(cells: DataFrame, indexed: DataFrame, buffer: int) -> DataFrame:
    """Cells of the (2b+1) x (2b+1) window around each point's cell (piy, pix):
    an equi-join on blocks of the window's width, of which a window touches at
    most four, and an exact test of the distance."""
    edge = F.lit(2 * buffer + 1)

    def block(c: Column) -> Column:
        return F.floor(c / edge).cast("int")

    def touched(c: Column) -> Column:
        return F.array_distinct(F.array(block(c - buffer), block(c + buffer)))
    pts = (indexed.withColumnsRenamed({"iy": "piy", "ix": "pix"})
           .withColumn("_by", F.explode(touched(F.col("piy")))).withColumn("_bx", F.explode(touched(F.col("pix")))))
    near = (cells.withColumn("_by", block(F.col("iy"))).withColumn("_bx", block(F.col("ix")))
            .join(pts, ["_by", "_bx"]))
    if buffer:
        near = near.where((F.abs(F.col("iy") - F.col("piy")) <= buffer) & (F.abs(F.col("ix") - F.col("pix")) <= buffer))
    return near.drop("_by", "_bx", "iy", "ix")


def _dated(cells: DataFrame, dates) -> DataFrame:
    """The cells of the dates wanted; a list reaches the scan's partition filter."""
    if isinstance(dates, (list, tuple)):
        return cells.where(F.col("date").isin([F.lit(str(d)).cast("date") for d in dates]))
    return cells if dates is None else cells.where(F.array_contains(dates, F.col("date")))


MAX_LISTED_CELLS = 1000
MAX_BROADCAST_POINTS = 10_000


def asked_cells(cells: DataFrame, asked: DataFrame, spec: GridSpec) -> DataFrame:
    """The cells (piy, pix) that points lie in.  A few are listed in the scan's
    filter; more are joined."""
    places = asked.select("iy", "ix").distinct()
    few = places.limit(MAX_LISTED_CELLS + 1).collect()
    if len(few) > MAX_LISTED_CELLS:
        return join_windows(cells, places, 0)
    code = F.col("iy").cast("long") * F.lit(spec.nx) + F.col("ix")
    return (cells.where(code.isin([r["iy"] * spec.nx + r["ix"] for r in few]))
            .withColumnsRenamed({"iy": "piy", "ix": "pix"}))


def complete_series(near: DataFrame, found: DataFrame, cells: DataFrame, dates=None) -> DataFrame:
    """Mean of the matched cells for every point and date (and band) of the
    stack: one row for each, NULL where nothing valid was matched.

    ``near`` has the matched cells of each place (piy, pix), ``found`` the
    points with their place and, in ``counts``, whether the place's values hold
    for them.  The full set of places and dates takes part in the aggregate as
    rows without values, so completing the series costs no join.  ``dates``:
    the dates wanted (a list, or a Column with an array); by default those in
    ``cells``."""
    vcols = _value_cols(cells)
    if dates is None:
        dates = dates_of(cells)
    elif isinstance(dates, (list, tuple)):
        dates = F.array(*[F.lit(str(d)).cast("date") for d in dates]).cast("array<date>")
    band = ["band"] if "band" in cells.columns else []
    # equal points are one
    points = found.groupBy("point_id", "station", "piy", "pix").agg(F.max("counts").alias("counts"))
    rows = found.select("piy", "pix").distinct().select("piy", "pix", F.explode(dates).alias("date"))
    if band:
        rows = rows.withColumn("band", F.explode(cells.select(F.array_sort(F.collect_set("band"))).scalar()))
    rows = rows.select("piy", "pix", "date", *band,
                       *[F.lit(None).cast(near.schema[c].dataType).alias(c) for c in vcols])
    means = (near.select(*rows.columns).unionByName(rows).groupBy("piy", "pix", "date", *band)
             .agg(*[F.avg(c).alias(c) for c in vcols]).withColumnsRenamed({"piy": "_piy", "pix": "_pix"}))
    same = F.col("piy").eqNullSafe(F.col("_piy")) & F.col("pix").eqNullSafe(F.col("_pix"))
    # a file of many points may be small enough for Spark to broadcast it, and one
    # task would then write the rows of all of them: merged, they stay spread
    if row_count_at_most(found.select("point_id"), MAX_BROADCAST_POINTS) is None:
        points = points.hint("merge")
    return points.join(means, same).select("point_id", "station", "date", *band,
                                           *[F.when(F.col("counts"), F.col(c)).alias(c) for c in vcols])


def _sample(cells: DataFrame, points: DataFrame, spec: GridSpec, buffer: int, tie: str,
            inside: Column | None, dates) -> DataFrame:
    """``inside``: condition on an indexed point for its window to count."""
    indexed = nearest_index(points.select("point_id", "station", "x", "y"), spec, tie)
    vals = _dated(cells, dates).select("date", "iy", "ix", *[c for c in ("band",) if c in cells.columns], *_value_cols(cells))
    asked = indexed if inside is None else indexed.where(inside)
    pruned = prune_rows(vals, asked, buffer)
    if buffer:
        near = join_windows(pruned, asked.select("iy", "ix").distinct(), buffer)
    else:
        near = asked_cells(pruned, asked, spec)
    found = (indexed.withColumn("counts", F.lit(True) if inside is None else F.coalesce(inside, F.lit(False)))
             .withColumnsRenamed({"iy": "piy", "ix": "pix"}))
    return complete_series(near, found, vals, dates)


def _close(points: DataFrame, spec: GridSpec, max_distance: float) -> Column:
    """Whether the point's cell centre is within ``max_distance`` on both axes."""
    return ((F.abs(F.col("x") - spec.x_of("ix")) <= F.lit(float(max_distance)))
            & (F.abs(F.col("y") - spec.y_of("iy")) <= F.lit(float(max_distance))))


def sample_nearest(cells: DataFrame, points: DataFrame, spec: GridSpec, tie: str = "coord",
                   max_distance: float | None = None, dates=None) -> DataFrame:
    """Value of the nearest cell for every point and date.

    Without ``max_distance`` (in grid units, on each axis) outside points snap
    to the edge; with it farther points have NULL series."""
    inside = None if max_distance is None else _close(points, spec, max_distance)
    return _sample(cells, points, spec, 0, tie, inside, dates)


def sample_window(cells: DataFrame, points: DataFrame, spec: GridSpec, buffer: int,
                  edge: str = "truncate", dates=None) -> DataFrame:
    """Mean over the (2b+1) x (2b+1) window around each point's nearest cell
    (index tie rule), per date (and band) (J5, G9).

    Values and quality flags are both averaged; missing cells are skipped, a
    window without valid cells gives NULL.  Windows are cut at the grid edges;
    ``edge="reference"`` reproduces slice semantics with a negative start: a
    window reaching past the top or left edge is empty for that point."""
    if buffer <= 0:
        return sample_nearest(cells, points, spec, tie="coord", dates=dates)
    if edge not in ("truncate", "reference"):
        raise ValueError(f"unknown edge rule {edge}")
    inside = (F.col("iy") >= buffer) & (F.col("ix") >= buffer) if edge == "reference" else None
    return _sample(cells, points, spec, buffer, "index", inside, dates)


def first_not_below(axis: Column, v: Column) -> Column:
    """Place of the first value >= v in a sorted array (its size where none
    is), by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(axis).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(axis, mid) < v
        closed = s["lo"] >= s["hi"]
        return F.struct(F.when(~closed & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(~closed & ~below, mid).otherwise(s["hi"]).alias("hi"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(axis) + F.lit(2.0))).cast("int") + 1)
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def nearest_on_axis(axis: Column, v: Column, tie_up: bool = True) -> Column:
    """The value of a sorted axis nearest to ``v``; halfway the larger one
    (``tie_up``) or the smaller one."""
    def pick(at):
        before, after = F.get(axis, at - 1), F.get(axis, at)
        low = F.abs(v - before)
        high = F.abs(v - after)
        closer = low < high if tie_up else low <= high
        return F.when(v.isNotNull(), F.when(before.isNull() | (after.isNotNull() & ~closer), after).otherwise(before))
    # a bound variable: the search runs once, not for each use of its result
    return F.get(F.transform(F.array(first_not_below(axis, v)), pick), F.lit(0))


def sample_nearest_irregular(cells: DataFrame, points: DataFrame, tie: str = "coord",
                             max_distance: float | None = None, dates=None) -> DataFrame:
    """Value of the nearest cell where the axes are no regular grid, for
    example a mosaic with whole tile columns missing (J4).

    The axes are the distinct ``y`` and ``x`` of the stack (at most the grid's
    height and width), found by binary search for each point; ties as in
    ``nearest_index``, ``max_distance`` as in ``sample_nearest``."""
    if tie not in ("coord", "index"):
        raise ValueError(f"unknown tie rule {tie}")

    def axis(c):
        return cells.select(F.array_sort(F.collect_set(c))).scalar()
    found = points.select("point_id", "station", "x", "y", axis("y").alias("_ys"), axis("x").alias("_xs")).select(
        "point_id", "station", "x", "y", nearest_on_axis(F.col("_ys"), F.col("y"), tie == "coord").alias("piy"),
        nearest_on_axis(F.col("_xs"), F.col("x")).alias("pix"))
    vals = _dated(cells, dates).select("date", "y", "x", *[c for c in ("band",) if c in cells.columns], *_value_cols(cells))
    counts = F.lit(True)
    if max_distance is not None:
        far = F.lit(float(max_distance))
        counts = F.coalesce((F.abs(F.col("x") - F.col("pix")) <= far) & (F.abs(F.col("y") - F.col("piy")) <= far),
                            F.lit(False))
    found = found.withColumn("counts", counts)
    near = vals.withColumnsRenamed({"y": "piy", "x": "pix"}).join(
        found.where("counts").select("piy", "pix").distinct(), ["piy", "pix"])
    return complete_series(near, found, vals, dates)


def series(sampled: DataFrame, scale_factor: float | None = None, flag_value: bool = True,
           flag_quality: bool = False) -> DataFrame:
    """Per-station series (point_id, station, time, data_value, quality_flag)
    (C4, C10).  The scale factor applies to the value only.  A long input
    (band column) is pivoted with conditional aggregates."""
    if not (flag_value or flag_quality):
        raise ValueError("a series needs its values, its quality flags or both")
    if "band" in sampled.columns:
        sampled = (sampled.groupBy("point_id", "station", "date")
                   .agg(F.max(F.when(F.col("band") == 1, F.col("value"))).alias("value"),
                        F.max(F.when(F.col("band") == 2, F.col("value"))).alias("qflag")))
    out = [F.col("point_id"), F.col("station"), F.col("date").alias("time")]
    if flag_value:
        v = F.col("value")
        if scale_factor is not None:
            v = v * F.lit(float(scale_factor))
        out.append(v.alias("data_value"))
    if flag_quality:
        out.append(F.col("qflag").alias("quality_flag"))
    return sampled.select(*out)
