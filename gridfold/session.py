"""Session helpers: the settings every job assumes, and the shared folder
for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on.  AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones; dates are
# day-precision so the session zone is pinned to UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def scale_conf(shuffle_bytes: float, total_cores: int,
               partition_bytes: int = 256 << 20) -> dict:
    """Settings for a job that shuffles about ``shuffle_bytes``.

    Shuffle partitions start at ~``partition_bytes`` each (at least two
    waves of the cluster's cores) and AQE merges small ones back to the same
    advisory size and splits skewed ones; scans read splits of the same
    size.  At 100 TB of cells with a full-stack time shuffle this gives
    ~400k partitions, e.g. on 4000 cores ~100 waves of one task per core."""
    n = max(2 * total_cores, int(shuffle_bytes // partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def get_session(master: str | None = None, app: str = "gridfold",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Only when the session has none (local tests) a private one is made and
    registered as the checkpoint folder, so lineage cuts and written tables
    always land in a place every executor can reach.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="gridfold-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for one written table."""
    base = shared_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}gridfold/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they
    find it from whatever folder the driver was started in."""
    import shutil
    sc = spark.sparkContext
    if getattr(sc, "_gridfold_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gridfold-ship-")     # read by the driver's file server only
    archive = shutil.make_archive(os.path.join(folder, "gridfold"), "zip", os.path.dirname(home),
                                  os.path.basename(home))
    sc.addPyFile(archive)
    sc._gridfold_shipped = True
