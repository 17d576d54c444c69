"""Block reductions (coarsening) and the operator presets of a summary.

``coarsen(k)`` groups k x k cells into one block.  Incomplete blocks at the
east and south ends are trimmed (axis lengths come from the GridSpec, never
from the row count).  The block's coordinates are the mean of its members'
centres, i.e. the centre of the coarsened grid's cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.model import GridSpec
from gridfold.operators.temporal import reduce_expr, temporal_reduce, value_band

BLOCK_AGGS = ("mean", "sum", "max")


def coarsen(grid: DataFrame, k: int, agg: str, spec: GridSpec,
            keys: tuple[str, ...] = (), col: str = "value") -> DataFrame:
    """Reduce k x k blocks with ``mean`` (G4), ``sum`` (G5) or ``max``.

    ``keys`` (e.g. ``date``) are kept as extra group keys.  Each input row
    must be unique per (keys, iy, ix).  With k = 1 the values pass through
    unchanged (a sum of a missing cell is 0), without a shuffle.
    """
    if agg not in BLOCK_AGGS:
        raise ValueError(f"block aggregate {agg} not supported")
    if k < 1:
        raise ValueError("coarsen factor must be >= 1")
    out_spec = spec.coarsened(k)
    if k == 1:
        v = F.coalesce(F.col(col), F.lit(0.0)) if agg == "sum" else F.col(col)
        out = grid.select(*keys, "iy", "ix", v.alias("value"))
        return out_spec.with_coords(out).select(*keys, "iy", "ix", "y", "x", "value")
    trimmed = grid.where((F.col("iy") < F.lit(out_spec.ny * k)) &
                         (F.col("ix") < F.lit(out_spec.nx * k)))
    out = trimmed.groupBy(
        *keys,
        F.floor(F.col("iy") / F.lit(k)).cast("int").alias("iy"),
        F.floor(F.col("ix") / F.lit(k)).cast("int").alias("ix"),
    ).agg(reduce_expr(agg, col).alias("value"))
    return out_spec.with_coords(out).select(*keys, "iy", "ix", "y", "x", "value")


# Presets of the operator + block-aggregate composition (time reduction
# first, then blocks: a mean of means, not weighted by valid counts).
#   banded: a stack that still has its band axis -> mean/mean, sum/sum
#   flat:   a single-band stack                  -> mean/max,  sum/max
#   only_plot: no time reduction                 -> max per date
PRESETS = {
    ("mean", "banded"): ("mean", "mean"),
    ("mean", "flat"): ("mean", "max"),
    ("sum", "banded"): ("sum", "sum"),
    ("sum", "flat"): ("sum", "max"),
}


# Largest k whose colocated plan is used.  That plan sends every raw row of
# a block (at most 2k x 2k cells x dates) to one task without a map-side
# combine; for larger k the two-step plan's partial aggregation spreads it.
MAX_COLOCATE_K = 64


def colocate_by_block(cells: DataFrame, spec: GridSpec, k: int, block: int = 64,
                      partitions: int | None = None) -> tuple[DataFrame, int]:
    """Hash-partition raw rows by a spatial block (a multiple of k, so a
    k-block never straddles two) and tag them with ``blk``.  The time and
    block reductions of ``summarise(bucket_block=...)`` then both ride on
    this one Exchange.  Meant for stores where a task holds one date (a
    date-partitioned store), where map-side combining saves nothing."""
    from gridfold.sources.sinks import block_id
    b = k * max(1, -(-block // k))
    tagged = cells.withColumn("blk", block_id(spec, b))
    out = tagged.repartition(partitions, "blk") if partitions else tagged.repartition("blk")
    return out, b


def summarise(cells: DataFrame, operator: str, k: int, spec: GridSpec,
              preset: str = "banded", bucket_block: int | None = None,
              colocate: bool = True) -> DataFrame:
    """Operator over time followed by k x k coarsening.

    ``operator="only_plot"`` coarsens every date with ``max`` and keeps the
    date (when present) as a key.

    ``bucket_block``: the input carries ``blk`` (spatial blocks of that size,
    see ``write_cells_bucketed``).  ``blk`` then joins the group keys, so a
    store bucketed by ``blk`` is reduced inside its scan tasks; for the
    block step only when k divides the bucket block (a coarse block must not
    straddle two buckets).

    ``colocate`` (1 < k <= 64, not bucketed): rows are hash-partitioned once by a
    spatial block that k divides, and both reductions ride on that one
    Exchange instead of shuffling raw rows by cell and then cells by block.
    Pass False for inputs whose tasks already hold many dates of the same
    cells (there map-side combining before the first shuffle pays).
    """
    if (colocate and bucket_block is None and 1 < k <= MAX_COLOCATE_K
            and operator != "only_plot" and "blk" not in cells.columns):
        cells, bucket_block = colocate_by_block(cells, spec, k)
    colocated = bucket_block is not None and "blk" in cells.columns
    bkey = ("blk",) if colocated else ()
    bkey_k = bkey if colocated and bucket_block % k == 0 else ()
    if operator == "only_plot":
        src = value_band(cells)
        keys = ("date",) if "date" in src.columns else ()
        return coarsen(src, k, "max", spec, keys=keys + bkey_k).drop(*bkey_k)
    if (operator, preset) not in PRESETS:
        raise ValueError(
            f"no time reduction {operator!r} with preset {preset!r}: use mean or sum")
    time_op, block_op = PRESETS[(operator, preset)]
    per_cell = temporal_reduce(cells, time_op, spec, keys=bkey)
    if bkey and not bkey_k:
        per_cell = per_cell.drop("blk")
    return coarsen(per_cell, k, block_op, spec, keys=bkey_k).drop(*bkey_k)
