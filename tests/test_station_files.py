"""Station folders written and read by the tasks: the same folders and text as
Spark's own writer, without its process and checksum file for every station."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gridfold.session import scratch_path
from gridfold.sources import fixtures as fx
from gridfold.sources.sinks import read_series_csv, write_series_csv
from gridfold.sources.stations import local_folder
from tests.conftest import SF_SMALL

SCHEMA = "point_id BIGINT, time DATE, data_value DOUBLE, quality_flag DOUBLE, station STRING"
NAMES = ["plain", "a b", "a/b", "a%2Fb", "x=y:z", "q\"'#*?", "\\[]{}^", "tab\tline\n", "~!@$&()+,;<>|`-_.", "", None,
         "plain"]
VALUES = [1.0, None, float("nan"), 1e-7, 1e20, -0.0, 123456.789]


def _series(spark, names):
    rows = [(i, n, VALUES[i % len(VALUES)], float(i)) for i, n in enumerate(names)]
    return (spark.createDataFrame(rows, "point_id BIGINT, station STRING, data_value DOUBLE, quality_flag DOUBLE")
            .withColumn("time", F.explode(F.expr("sequence(date'2020-01-01', date'2020-01-17', interval 8 days)")))
            .select("point_id", "station", "time", "data_value", "quality_flag"))


def _text(path):
    """Folder -> its lines, headers counted."""
    found = {}
    for f in glob.glob(f"{glob.escape(path)}/station=*/part-*"):
        with open(f, encoding="utf-8") as lines:
            found.setdefault(os.path.basename(os.path.dirname(f)), []).extend(lines)
    return {folder: sorted(lines) for folder, lines in found.items()}


def _rows(df):
    return sorted(map(repr, df.select("point_id", "station", "time", "data_value", "quality_flag").collect()))


def _processes():
    with open("/proc/stat") as f:
        return int(next(line for line in f if line.startswith("processes")).split()[1])


def test_no_process_and_no_checksum_file_for_a_station(spark):
    s = _series(spark, [f"s{i}" for i in range(400)]).localCheckpoint()
    write_series_csv(s, scratch_path(spark, "warm"))
    before = _processes()
    path = write_series_csv(s, scratch_path(spark, "many"))
    assert _processes() - before < 400                  # about six for each station before
    assert len(glob.glob(f"{path}/station=*")) == 400
    assert all(len(os.listdir(d)) == 1 for d in glob.glob(f"{path}/station=*"))


def test_same_folders_and_text_as_sparks_writer(spark):
    s = _series(spark, NAMES)
    ours, theirs = scratch_path(spark, "ours"), scratch_path(spark, "theirs")
    write_series_csv(s, ours)
    (s.repartition("station", "point_id").write.partitionBy("station").option("header", True).csv(theirs))

    def lines(path):
        return {d: [x for x in t if not x.startswith("point_id")] for d, t in _text(path).items()}
    assert lines(ours) == lines(theirs)
    assert {x for t in _text(ours).values() for x in t if x.startswith("point_id")} == {
        "point_id,time,data_value,quality_flag\n"}
    read = spark.read.schema(SCHEMA).option("header", True)
    assert _rows(read_series_csv(spark, ours, SCHEMA)) == _rows(read.csv(ours)) == _rows(read.csv(theirs))
    # written by others: no table of files
    assert _rows(read_series_csv(spark, theirs, SCHEMA)) == _rows(read.csv(theirs))


def test_overwrite_takes_the_place_of_the_old_folder_only_when_done(spark):
    path = write_series_csv(_series(spark, ["a", "b"]), scratch_path(spark, "again"))
    old = _text(path)
    failing = _series(spark, ["c", "d"]).withColumn(
        "data_value", F.when(F.col("point_id") == 1, F.raise_error(F.lit("stop")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="stop"):
        write_series_csv(failing, path)
    assert _text(path) == old
    write_series_csv(_series(spark, ["c"]), path)
    assert sorted(_text(path)) == ["station=c"]
    assert glob.glob(f"{os.path.dirname(path)}/_{os.path.basename(path)}*") == []
    write_series_csv(_series(spark, ["e"]), path, mode="append")
    assert {r["station"] for r in read_series_csv(spark, path, SCHEMA).collect()} == {"c", "e"}


def test_series_without_rows(spark):
    path = write_series_csv(_series(spark, ["a"]).where("point_id < 0"), scratch_path(spark, "none"))
    assert read_series_csv(spark, path, SCHEMA).count() == 0


def test_a_name_of_many_points_keeps_all_rows(spark):
    s = _series(spark, ["one"] * 50 + ["é ☃"])          # the JVM here may not take the second as a file name
    path = write_series_csv(s, scratch_path(spark, "shared"))
    assert os.listdir(path).count("station=one") == 1
    back = read_series_csv(spark, f"file:{path}", SCHEMA)
    assert _rows(back) == _rows(s)


def test_names_of_one_folder_keep_all_rows(spark):
    s = _series(spark, [None, "", "a", "__HIVE_DEFAULT_PARTITION__"]).coalesce(1)
    back = read_series_csv(spark, write_series_csv(s, scratch_path(spark, "unnamed")), SCHEMA)
    assert back.count() == s.count() == 12
    assert back.where("station IS NULL").count() == 9


def test_local_folder(spark):
    assert local_folder(spark, "/a/b/") == local_folder(spark, "file:/a/b") == local_folder(spark, "file:///a/b") == "/a/b"
    for other in ("hdfs://host/a", "s3a://bucket/a", "file://host/a", "hdfs:/a"):
        assert local_folder(spark, other) is None


def test_extract_timeseries_writes_stations_without_side_files(spark):
    from gridfold.api import extract_timeseries
    from gridfold.catalog.q_ingest import tile_store
    out = scratch_path(spark, "extract")
    s = extract_timeseries(spark, tile_store(spark, SF_SMALL), out, fx.points(spark, SF_SMALL).drop("station"),
                           time_start="2020-01-17", scale_factor=0.5, flag_quality=True)
    path = f"{out}/time_series"
    assert _rows(read_series_csv(spark, path, SCHEMA)) == _rows(s)
    folders = glob.glob(f"{path}/station=*")
    assert len(folders) == fx.points(spark, SF_SMALL).count()
    assert all(len(os.listdir(d)) == 1 for d in folders)


def _batch(names):
    import pyarrow as pa
    lines = [f"{i},2020-01-01" for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], ["station", "line"])


def _attempt(monkeypatch, number, partition=0):
    from types import SimpleNamespace

    from gridfold.sources import stations
    task = SimpleNamespace(partitionId=lambda: partition, taskAttemptId=lambda: number)
    monkeypatch.setattr(stations.TaskContext, "get", lambda: task)


def _noted(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def test_folders_are_made_apart_and_moved_to_the_one_all_tasks_share(tmp_path, monkeypatch):
    from gridfold.sources.stations import _write_files
    root, mkdir, made = str(tmp_path), os.mkdir, []
    monkeypatch.setattr(os, "mkdir", lambda path, *a, **k: (made.append(path), mkdir(path, *a, **k))[1])
    _attempt(monkeypatch, 7)
    files = _noted(_write_files(root, "point_id,time\n")([_batch(["a", "a", "b"])]))
    assert files == [("station=a/part-00000-000000.csv", 2), ("station=b/part-00000-000001.csv", 1)]
    assert [p for p in made if os.path.dirname(p) == root and "station=" in p] == []
    with open(f"{root}/station=a/part-00000-000000.csv") as f:
        assert f.read() == "point_id,time\n0,2020-01-01\n1,2020-01-01\n"


def test_attempts_leave_whole_files_only_and_a_second_one_the_same(tmp_path, monkeypatch):
    from gridfold.sources.stations import _write_files

    def fails():
        yield _batch(["a", "b", "b"])
        raise OSError("lost")
    root = str(tmp_path)
    _attempt(monkeypatch, 1)
    with pytest.raises(OSError, match="lost"):
        _noted(_write_files(root, "h\n")(fails()))
    assert glob.glob(f"{root}/station=*/.*") == [] and sorted(_text(root)) == ["station=a"]
    _attempt(monkeypatch, 2)
    one = _noted(_write_files(root, "h\n")([_batch(["a", "b", "b"])]))
    _attempt(monkeypatch, 3, partition=1)               # another point of the name
    two = _noted(_write_files(root, "h\n")([_batch(["a"])]))
    assert sum(n for _, n in one + two) == 4
    assert {d: len(t) for d, t in _text(root).items()} == {"station=a": 4, "station=b": 3}


def test_nothing_of_the_tasks_at_work_is_left(spark):
    path = write_series_csv(_series(spark, ["a", "b", "a"]), scratch_path(spark, "left"))
    assert sorted(os.listdir(path)) == ["_SUCCESS", "_files", "station=a", "station=b"]
