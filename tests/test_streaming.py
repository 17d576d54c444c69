"""Incremental composites: a store that grows by dates gives, after each
run, the same product as a batch reduction over the dates so far."""

from pyspark.sql import functions as F

from gridfold.operators.temporal import temporal_reduce
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import write_cells
from gridfold.sources.store import read_cells
from gridfold.streaming import composite_stream, read_running, start_running_temporal
from tests.conftest import SF_SMALL


def _same(a, b):
    ra = {(r["iy"], r["ix"]): r["value"] for r in a.collect()}
    rb = {(r["iy"], r["ix"]): r["value"] for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        assert (ra[k] is None and rb[k] is None) or abs(ra[k] - rb[k]) < 1e-6


def test_running_mean_and_sum(spark):
    cells = fx.cells(spark, SF_SMALL)
    store = scratch_path(spark, "stream-store")
    log = scratch_path(spark, "stream-log")
    ckpt = scratch_path(spark, "stream-ckpt")
    write_cells(cells.where(F.col("date") <= "2020-01-17"), store, mode="append")
    q = start_running_temporal(composite_stream(spark, store), log, ckpt)
    q.awaitTermination()
    first = read_cells(spark, store)
    _same(read_running(spark, log, "mean", fx.CELLS_SPEC),
          temporal_reduce(first, "mean", fx.CELLS_SPEC))
    # new dates arrive; only they are read by the next run
    write_cells(cells.where(F.col("date") > "2020-01-17"), store, mode="append")
    q = start_running_temporal(composite_stream(spark, store), log, ckpt)
    q.awaitTermination()
    allc = read_cells(spark, store)
    _same(read_running(spark, log, "mean", fx.CELLS_SPEC), temporal_reduce(allc, "mean", fx.CELLS_SPEC))
    _same(read_running(spark, log, "sum", fx.CELLS_SPEC), temporal_reduce(allc, "sum", fx.CELLS_SPEC))
