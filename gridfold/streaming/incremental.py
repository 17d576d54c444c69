"""Running temporal reductions over a growing date-partitioned cell store.

    stream = composite_stream(spark, store)               # new files only
    q = start_running_temporal(stream, log_path, ckpt)     # state: (sum, n) per cell
    q.processAllAvailable()
    product = read_running(spark, log_path, "mean", spec)  # current product

Every trigger emits the cells whose state changed (update mode) with their
cumulative (sum, count).  ``foreachBatch`` writes them to
``<log>/batch_id=<n>`` with overwrite, so a replayed batch rewrites the same
folder (idempotent).  Readers take the newest row per cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfold.model import GridSpec
from gridfold.session import scratch_path

STATE_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STORE_SCHEMA = ("tile STRING, iy INT, ix INT, y DOUBLE, x DOUBLE, value FLOAT, "
                "qflag FLOAT, date DATE")


def composite_stream(spark: SparkSession, store: str, schema: str = STORE_SCHEMA,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a cell store written by ``write_cells`` (partitioned by
    date), as a stream.  Files already seen by the query's checkpoint are
    never read again."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.parquet(store)
    return df.withColumn("value", F.col("value").cast("double"))


def running_state(stream: DataFrame) -> DataFrame:
    """Cumulative (sum, count of valid values) per cell: the state needed
    for both the running mean and the running sum."""
    return (stream.groupBy("iy", "ix")
                  .agg(F.sum("value").alias("s"), F.count("value").alias("n")))


def start_running_temporal(stream: DataFrame, log_path: str, checkpoint: str | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Start the running reduction; its updates land in ``log_path``."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "running-ckpt")
    # one state row per cell: keep it in RocksDB (off the JVM heap) unless
    # the session already names a provider; the choice is kept in the
    # checkpoint, so a restarted query uses the same store
    if spark.conf.get(STATE_PROVIDER_KEY, None) is None:
        spark.conf.set(STATE_PROVIDER_KEY, ROCKSDB_PROVIDER)

    def flush(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
              .write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}"))

    w = (running_state(stream).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(flush))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_running(spark: SparkSession, log_path: str, op: str, spec: GridSpec) -> DataFrame:
    """The current product: the newest state of every cell, then mean
    (NULL without a valid value) or sum (0 without a valid value)."""
    log = spark.read.parquet(log_path)
    last = log.groupBy("iy", "ix").agg(F.max_by(F.struct("s", "n"), "batch_id").alias("st"))
    if op == "mean":
        v = F.try_divide(F.col("st.s"), F.col("st.n").cast("double"))
    elif op == "sum":
        v = F.coalesce(F.col("st.s"), F.lit(0.0))
    else:
        raise ValueError(f"Operator {op} not supported. Supported operators are: mean and sum.")
    out = last.select("iy", "ix", v.alias("value"))
    return spec.with_coords(out).select("iy", "ix", "y", "x", "value")
