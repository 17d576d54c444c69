"""File outputs: headers, line order, one file where the reference writes
one file, float32 storage, per-station folders."""

import glob
import os

from pyspark.sql import functions as F

from gridfold.operators.landcover import zonal_share
from gridfold.operators.stats import grid_stats, profile
from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import (write_cells, write_profile_csv, write_series_csv,
                                    write_stats_text, write_zonal_csv)
from tests.conftest import SF_SMALL


def _lines(path):
    out = []
    for f in sorted(glob.glob(f"{path}/part-*")):
        out += open(f).read().splitlines()
    return out


def test_profile_csv_one_file_north_first(spark):
    g = spark.createDataFrame([(1.25, 2.0), (1.75, None), (0.75, 1.0)], "y DOUBLE, value DOUBLE")
    path = write_profile_csv(profile(g, "sum"), scratch_path(spark, "sink-profile"))
    assert len(glob.glob(f"{path}/part-*")) == 1
    assert _lines(path) == ["y,value", "1.75,0.0", "1.25,2.0", "0.75,1.0"]


def test_stats_text_order(spark):
    g = spark.createDataFrame([(1.0,), (3.0,)], "value DOUBLE")
    lines = _lines(write_stats_text(grid_stats(g), scratch_path(spark, "sink-stats")))
    assert lines == ["mean: 2.0", "min: 1.0", "max: 3.0", "sum: 4.0", "std: 1.0", "var: 1.0"]


def test_zonal_csv_columns(spark):
    z = spark.createDataFrame([(10, 1.0), (20, 3.0)], "lc_code INT, gpp_sum DOUBLE")
    lines = _lines(write_zonal_csv(zonal_share(z), scratch_path(spark, "sink-zonal")))
    assert lines == ["lc_code,lc_label,gpp_sum,percentage", "10,Tree Cover,1.0,25.0",
                     "20,Shrubland,3.0,75.0"]


def test_cells_partitioned_by_date_float32(spark):
    c = fx.cells(spark, SF_SMALL)
    path = write_cells(c, scratch_path(spark, "sink-cells"))
    dates = sorted(os.path.basename(d) for d in glob.glob(f"{path}/date=*"))
    assert dates == sorted(f"date={r[0]}" for r in c.select("date").distinct().collect())
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["value"] == "float" and back.count() == c.count()


def test_series_one_folder_per_station(spark):
    s = spark.createDataFrame([(1, "a", "2020-01-01", 1.0), (1, "a", "2020-01-09", 2.0),
                               (2, "b", "2020-01-01", 3.0)],
                              "point_id BIGINT, station STRING, time STRING, data_value DOUBLE")
    s = s.withColumn("time", F.col("time").cast("date"))
    path = write_series_csv(s, scratch_path(spark, "sink-series"))
    assert sorted(os.path.basename(d) for d in glob.glob(f"{path}/station=*")) == ["station=a", "station=b"]
    assert len(glob.glob(f"{path}/station=a/part-*")) == 1
