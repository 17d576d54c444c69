"""Per-tile products that a later run can go on from.

A folder holds ``data`` (product rows tagged with the batch that wrote them)
and ``done`` (one row for each tile, signature and batch, written after the
batch's data).  The signature hashes the operator, the rule for missing cells,
the grid and the dates that the selection really holds for the tile, repeats
counted.  So products are read again only if they would come out the same: a
date added under an open range end, or a range counted twice, is computed
anew.  Rows of a batch that was cut off before its ``done`` rows are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.model import GridSpec
from gridfold.operators.align import skip_existing
from gridfold.operators.temporal import OPERATORS

DONE = "tile STRING, signature STRING, batch STRING"


def signatures(selected: DataFrame, spec: GridSpec, operator: str, dense: bool,
               footprints: DataFrame | None = None) -> DataFrame:
    """(tile, signature) of a selected stack.  A tile has at most one entry for
    each composite of the selection."""
    keys = [c for c in ("k",) if c in selected.columns]         # the range a date was selected by
    days = (selected.select("tile", "date", *keys).distinct().groupBy("tile")
            .agg(F.array_sort(F.collect_list(F.col("date").cast("string"))).alias("days")))
    rule = [F.lit(f"{operator}|{dense}|{spec}"), F.array_join("days", ",")]
    if dense and footprints is not None:
        days = days.join(footprints, "tile", "left")
        rule += [F.concat_ws(",", "iy_lo", "iy_hi", "ix_lo", "ix_hi")]
    return days.select("tile", F.sha2(F.concat_ws("|", *rule).cast("binary"), 256).alias("signature"))


def _done(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(DONE).parquet(f"{path}/done")
    except AnalysisException:          # nothing written yet
        return spark.createDataFrame([], DONE)


def resumed(selected: DataFrame, spec: GridSpec, operator: str, path: str, dense: bool = False,
            footprints: DataFrame | None = None) -> DataFrame:
    """Per-tile products (tile, iy, ix, value) of the selection: those in
    ``path`` with the same signature, the others computed and added."""
    from gridfold.plans.jobs import tile_products
    if operator not in OPERATORS:
        raise ValueError(f"the per-tile path reduces by mean or sum, not {operator!r}")
    spark = selected.sparkSession
    batch = uuid.uuid4().hex
    # one row per tile of the grid, computed once
    wanted = spark.createDataFrame(signatures(selected, spec, operator, dense, footprints).collect(),
                                   "tile STRING, signature STRING")
    todo = [r["tile"] for r in skip_existing(wanted, _done(spark, path), ["tile", "signature"]).select("tile").collect()]
    if todo:
        some = footprints if footprints is None else footprints.where(F.col("tile").isin(todo))
        fresh = tile_products(selected.where(F.col("tile").isin(todo)), spec, operator, dense, some)
        # doubles are kept: a resumed product equals a computed one
        (fresh.withColumn("batch", F.lit(batch)).select("tile", "iy", "ix", "value", "batch")
              .write.mode("append").partitionBy("batch").parquet(f"{path}/data"))
        (wanted.where(F.col("tile").isin(todo)).withColumn("batch", F.lit(batch))
               .write.mode("append").parquet(f"{path}/done"))
    # one batch for each tile and signature, should two runs have written it
    current = (_done(spark, path).join(wanted, ["tile", "signature"]).groupBy("tile")
               .agg(F.min("batch").alias("batch")))
    data = spark.read.schema("tile STRING, iy INT, ix INT, value DOUBLE, batch STRING").parquet(f"{path}/data")
    return data.join(current, ["tile", "batch"], "left_semi").drop("batch")
