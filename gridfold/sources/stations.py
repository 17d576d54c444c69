"""One CSV folder per station on a local or mounted file system.

Spark's writer starts a process for the permissions of every file it creates
there (and writes a checksum file beside it), and its reader lists every folder
into the driver.  With a folder for each of many stations that is nearly all of
the work, so the tasks create the files themselves, with the rows as Spark
formats them, and note them in a table beside the folders from which the reader
takes them.
"""

from __future__ import annotations

import csv
import errno
import functools
import io
import itertools
import operator
import os
import re
import shutil
import urllib.parse
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridfold.session import ship_package

FILES = "_files"                                    # readers skip names with an underscore
MADE = "_made"                                      # folders of tasks at work
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
BATCH = 10_000


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The absolute path of a folder on a local or mounted file system, None
    for a path on any other."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme is None:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        scheme = default.split(":")[0]
    elif rest.startswith("//"):
        host, rest = re.fullmatch(r"//([^/]*)(.*)", rest, re.S).groups()
        if host:
            return None
    return os.path.abspath(rest) if scheme == "file" else None


def station_folder(station: str | None) -> str:
    """The folder of a station, named as Spark names partition folders."""
    return "station=" + (ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", station) if station else NO_NAME)


def station_of(file: str) -> str | None:
    name = os.path.dirname(file)[len("station="):]
    return None if name == NO_NAME else urllib.parse.unquote(name)


def _batches(rows, schema: pa.Schema):
    """Tuples -> Arrow batches of at most ``BATCH`` rows."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _put(made: str, root: str, folder: str, file: str) -> None:
    """Move a folder made with its file in it to its place under ``root``; where
    a folder of this name stands, the file into that."""
    try:
        os.rename(f"{made}/{folder}", f"{root}/{folder}")
    except OSError as e:
        if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
            raise
        # of another point of this name, or of this task's earlier attempt: the same file again
        os.replace(f"{made}/{folder}/{file}", f"{root}/{folder}/{file}")
        os.rmdir(f"{made}/{folder}")


def _write_files(root: str, header: str):
    """(station, line) in the order of stations -> a file for each run of lines
    of one folder, and one row (file, n) for it.  Lines are passed on one by one.

    Every attempt makes its folders, with their files, in a folder of its own and
    moves each to its place: one that all tasks make their folders in is locked
    while any of them does."""
    def run(batches):
        folder_of = functools.lru_cache(maxsize=2)(station_folder)
        rows = ((folder_of(s), line) for b in batches
                for s, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        task = TaskContext.get()
        made = f"{root}/{MADE}/{task.taskAttemptId()}"
        head = header.encode()

        def files():
            os.makedirs(made, exist_ok=True)
            for k, (folder, group) in enumerate(itertools.groupby(rows, operator.itemgetter(0))):
                os.mkdir(f"{made}/{folder}")
                file = f"part-{task.partitionId():05d}-{k:06d}.csv"
                n = 0
                with open(f"{made}/{folder}/{file}", "wb") as f:
                    f.write(head)
                    for _, line in group:
                        f.write(line.encode() + b"\n")
                        n += 1
                _put(made, root, folder, file)
                yield f"{folder}/{file}", n
        yield from _batches(files(), pa.schema([("file", pa.string()), ("n", pa.int64())]))
    return run


def write_station_files(rows: DataFrame, folder: str) -> None:
    """Write rows, sorted by station inside each partition, as one folder per
    station, in place of what ``folder`` holds.  All is written aside and the
    folder renamed at the end, so a run that fails leaves the old one."""
    ship_package(rows.sparkSession)
    cols = [c for c in rows.columns if c != "station"]
    header = io.StringIO()
    csv.writer(header, doublequote=False, escapechar="\\", lineterminator="\n").writerow(cols)
    parent, name = os.path.split(folder)
    aside, old = (os.path.join(parent, f"_{name}-{uuid.uuid4().hex}.{end}") for end in ("new", "old"))
    os.makedirs(aside)
    try:
        (rows.select(F.col("station").cast("string").alias("station"), F.to_csv(F.struct(*cols)).alias("line"))
             .mapInArrow(_write_files(aside, header.getvalue()), "file STRING, n BIGINT")
             .write.parquet(f"file:{aside}/{FILES}"))
        shutil.rmtree(f"{aside}/{MADE}", ignore_errors=True)    # empty, but for attempts that failed
        open(f"{aside}/_SUCCESS", "w").close()
        if os.path.lexists(folder):
            os.rename(folder, old)
        os.rename(aside, folder)
    except BaseException:
        shutil.rmtree(aside, ignore_errors=True)
        raise
    if os.path.lexists(old):
        shutil.rmtree(old) if os.path.isdir(old) else os.remove(old)


def drop_file_table(folder: str) -> None:
    """Forget the files noted, before others are added by Spark's writer; the
    folder is listed then."""
    if os.path.isdir(os.path.join(folder, FILES)):
        shutil.rmtree(os.path.join(folder, FILES))


def _read_lines(root: str):
    """Files -> (station, line) without the headers and blank lines."""
    def run(batches):
        def lines():
            for b in batches:
                for file in b.column(0).to_pylist():
                    station = station_of(file)
                    with open(f"{root}/{file}", encoding="utf-8") as f:
                        next(f, None)
                        for line in f:
                            if line.strip():
                                yield station, line.rstrip("\n")
        yield from _batches(lines(), pa.schema([("station", pa.string()), ("line", pa.string())]))
    return run


def read_station_files(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of every file that ``write_station_files`` noted, parsed by
    Spark as ``schema``."""
    ship_package(spark)
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "station")
    rows = (spark.read.parquet(f"file:{folder}/{FILES}").select("file")
            .mapInArrow(_read_lines(folder), "station STRING, line STRING")
            .select("station", F.from_csv("line", inner).alias("row")))
    return rows.select(*[F.col("station" if f.name == "station" else f"row.{f.name}").cast(f.dataType).alias(f.name)
                         for f in schema])
