"""Raster ingest and export as Spark jobs.

* ``decode_tiles``: ``binaryFile`` -> ``mapInPandas``; every task decodes the
  files of its split (one file per row) and emits pixel rows in chunks, so a
  task holds at most one tile in memory.  Pixels are placed on the global
  grid by their coordinates (the mosaic, J1); pixels where every band is
  no-data are dropped (absent = missing).
* ``write_tiles``: ``groupBy(date, tile).applyInPandas``; each group is one
  tile of one date (bounded by the tile size) and becomes one GeoTIFF in
  ``<root>/<YYYY-MM-DD>/<prefix>_<YYYYMMDD>_<tile>_<suffix>.tif``.  The root
  must be a folder every executor mounts (POSIX path).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.model import GridSpec
from gridfold.sources.geotiff import decode, encode
from gridfold.sources.store import date_dirs, parse_tile_name

ROWS_PER_CHUNK = 512
BAND_COLS = ("value", "qflag")
TILE_RE = r"(h\d+v\d+)"


def _posix(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def list_tile_files(spark: SparkSession, root: str, when=None) -> DataFrame:
    """(path, date, tile_key, length) of the tile files; no bytes read."""
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.tif")
             .load(root)
             .select("path", "length",
                     F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("dir"),
                     F.regexp_extract("path", r"([^/]+)$", 1).alias("file")))
    files = parse_tile_name(date_dirs(files, "dir"), "file").select("path", "date", "tile_key",
                                                                     "length")
    return files.where(when) if when is not None else files


def read_tile_files(spark: SparkSession, root: str, when=None,
                    max_bytes: int | None = None) -> DataFrame:
    """Dated tile files with their bytes: (path, date, tile_key, content).

    ``when`` (a Column over ``date``, e.g. ``select.in_range(...)``) chooses
    dates before any byte is read: the path-only listing is filtered, the
    chosen date folders (one path per composite date) are collected, and
    only they are opened.  Without it every file under ``root`` is read."""
    paths = [root]
    if when is not None:
        from gridfold.sources.store import scan_tiles
        listing = scan_tiles(spark, root).where(when)
        dirs = listing.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("d")).distinct()
        paths = [r["d"] for r in dirs.collect()]
        if not paths:
            return spark.createDataFrame([], "path STRING, date DATE, tile_key STRING, content BINARY")
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.tif")
             .load(paths if len(paths) > 1 else paths[0]))
    files = files.select(
        "path", "content", "length",
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    files = parse_tile_name(date_dirs(files, "dir"), "file")
    if max_bytes is not None:
        files = files.where(F.col("length") <= F.lit(max_bytes))
    out = files.select("path", "date", "tile_key", "content")
    return out.where(when) if when is not None else out


def _decode_partition(bands: tuple[str, ...]):
    def run(batches):
        for pdf in batches:
            for date, key, content in zip(pdf["date"], pdf["tile_key"], pdf["content"]):
                r = decode(bytes(content))
                data = r.bands.astype(np.float64)
                if r.nodata is not None and not np.isnan(r.nodata):
                    data[data == r.nodata] = np.nan
                nb, h, w = data.shape
                cols = np.arange(w)
                xs = r.x0 + (cols + 0.5) * r.dx
                for r0 in range(0, h, ROWS_PER_CHUNK):
                    rows = np.arange(r0, min(h, r0 + ROWS_PER_CHUNK))
                    block = data[:, rows, :].reshape(nb, -1)
                    keep = ~np.all(np.isnan(block), axis=0)
                    if not keep.any():
                        continue
                    out = {
                        "date": date, "tile_key": key,
                        "x": np.tile(xs, len(rows))[keep],
                        "y": np.repeat(r.y0 - (rows + 0.5) * r.dy, w)[keep],
                    }
                    for i, b in enumerate(bands):
                        out[b] = block[i][keep] if i < nb else np.full(keep.sum(), np.nan)
                    yield pd.DataFrame(out)
    return run


def decode_tiles(files: DataFrame, spec: GridSpec, bands: tuple[str, ...] = BAND_COLS) -> DataFrame:
    """Decode tile files (``read_tile_files``) into cells on ``spec``.

    Output: date, tile, iy, ix, y, x and one column per band (NaN -> NULL)."""
    schema = "date DATE, tile_key STRING, x DOUBLE, y DOUBLE, " + \
        ", ".join(f"{b} DOUBLE" for b in bands)
    px = files.select("date", "tile_key", "content").mapInPandas(_decode_partition(bands), schema)
    return _pixels_to_cells(px, spec, bands)


def _pixels_to_cells(px: DataFrame, spec: GridSpec, bands: tuple[str, ...]) -> DataFrame:
    """Pixel centres -> cells of ``spec`` (the mosaic by coordinates)."""
    cells = px.select(
        "date",
        F.coalesce(F.nullif(F.regexp_extract("tile_key", TILE_RE, 1), F.lit("")),
                   F.col("tile_key")).alias("tile"),
        spec.iy_of("y").alias("iy"), spec.ix_of("x").alias("ix"),
        *[F.when(~F.isnan(b), F.col(b)).alias(b) for b in bands])
    inside = F.col("iy").between(0, spec.ny - 1) & F.col("ix").between(0, spec.nx - 1)
    cells = cells.withColumn("iy", F.when(inside, F.col("iy")).otherwise(F.raise_error(F.concat(
        F.lit("a pixel of tile "), F.coalesce("tile", F.lit("?")), F.lit(" lies outside the grid")))))
    return spec.with_coords(cells).select("date", "tile", "iy", "ix", "y", "x", *bands)


# Files above this size are decoded block by block across tasks instead of
# whole in one task (a single file may hold much of a store).
SPLIT_BYTES = 256 << 20
BLOCKS_PER_TASK = 64


def _block_rows(batches):
    from gridfold.sources.geotiff import layout
    for pdf in batches:
        rows = []
        for path, date, key in zip(pdf["path"], pdf["date"], pdf["tile_key"]):
            with open(_posix(path), "rb") as f:
                lay = layout(f)
            spatial: dict = {}
            for p, r0, c0, bh, bw, off, cnt in lay.blocks:
                spatial.setdefault((r0, c0, bh, bw), []).append((p, off, cnt))
            for (r0, c0, bh, bw), parts in spatial.items():
                parts.sort()
                rows.append((path, date, key, r0, c0, bh, bw,
                             [o for _, o, _ in parts], [c for _, _, c in parts]))
        yield pd.DataFrame(rows, columns=["path", "date", "tile_key", "r0", "c0", "bh", "bw",
                                          "offs", "cnts"])


def _decode_block_rows(bands: tuple[str, ...]):
    from gridfold.sources.geotiff import decode_block, georef, layout

    def run(batches):
        layouts: dict = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with open(_posix(row.path), "rb") as f:
                    if row.path not in layouts:
                        layouts[row.path] = layout(f)
                    lay = layouts[row.path]
                    parts = []
                    for plane, (off, cnt) in enumerate(zip(row.offs, row.cnts)):
                        f.seek(int(off))
                        blk = (plane, row.r0, row.c0, row.bh, row.bw, int(off), int(cnt))
                        parts.append(decode_block(f.read(int(cnt)), lay, blk))
                data = np.concatenate(parts, axis=0).astype(np.float64)
                x0, y0, dx, dy, nodata, _ = georef(lay.tags)
                if nodata is not None and not np.isnan(nodata):
                    data[data == nodata] = np.nan
                nb, h, w = data.shape
                flat = data.reshape(nb, -1)
                keep = ~np.all(np.isnan(flat), axis=0)
                if not keep.any():
                    continue
                cols = row.c0 + np.arange(w)
                rows_ = row.r0 + np.arange(h)
                out = {"date": row.date, "tile_key": row.tile_key,
                       "x": np.tile(x0 + (cols + 0.5) * dx, h)[keep],
                       "y": np.repeat(y0 - (rows_ + 0.5) * dy, w)[keep]}
                for i, b in enumerate(bands):
                    out[b] = flat[i][keep] if i < nb else np.full(keep.sum(), np.nan)
                yield pd.DataFrame(out)
    return run


def decode_large_tiles(listing: DataFrame, spec: GridSpec,
                       bands: tuple[str, ...] = BAND_COLS) -> DataFrame:
    """Decode big files (``list_tile_files`` rows) block by block: the
    block list of every file is read from its header, the blocks are spread
    over tasks, and each task reads only its blocks' byte ranges.  Paths
    must be visible to the executors as files (POSIX)."""
    spark = listing.sparkSession
    blocks = listing.select("path", "date", "tile_key").mapInPandas(
        _block_rows, "path STRING, date DATE, tile_key STRING, r0 INT, c0 INT, bh INT, bw INT, "
                     "offs ARRAY<BIGINT>, cnts ARRAY<BIGINT>")
    n = max(spark.sparkContext.defaultParallelism,
            -(-blocks.count() // BLOCKS_PER_TASK))   # one small action: block count
    schema = "date DATE, tile_key STRING, x DOUBLE, y DOUBLE, " + \
        ", ".join(f"{b} DOUBLE" for b in bands)
    px = blocks.repartition(n).mapInPandas(_decode_block_rows(bands), schema)
    return _pixels_to_cells(px, spec, bands)


def decode_store(spark: SparkSession, root: str, spec: GridSpec, when=None,
                 split_bytes: int = SPLIT_BYTES, bands: tuple[str, ...] = BAND_COLS) -> DataFrame:
    """All (or the ``when``-selected) tiles of a store as cells: files up to
    ``split_bytes`` are decoded whole (one task per file), bigger ones block
    by block across tasks."""
    small = decode_tiles(read_tile_files(spark, root, when, max_bytes=split_bytes), spec, bands)
    big = list_tile_files(spark, root, when).where(F.col("length") > F.lit(split_bytes))
    if big.limit(1).count() == 0:
        return small
    return small.unionByName(decode_large_tiles(big, spec, bands))


def read_landcover(spark: SparkSession, path: str, spec: GridSpec, format: str = "auto") -> DataFrame:
    """A class raster (iy, ix, y, x, lc_code) on ``spec`` (S5): a tree of
    GeoTIFF files in one date folder, first band, or a Parquet table with iy, ix
    and lc_code.  Pixels without a class are absent."""
    if format == "geotiff" or (format == "auto" and not list_tile_files(spark, path).limit(1).isEmpty()):
        cells = decode_store(spark, path, spec, bands=("lc_code",))
    else:
        cells = spark.read.parquet(path)
    code = F.col("lc_code").cast("int")
    return spec.with_coords(cells.select("iy", "ix", code.alias("lc_code")).where(code.isNotNull())).select(
        "iy", "ix", "y", "x", "lc_code")


def tile_headers(files: DataFrame) -> DataFrame:
    """Georeference of every tile file: (path, x0, y0, dx, dy, width,
    height, epsg); pixels are not decoded."""
    from gridfold.sources.geotiff import header

    def run(batches):
        for pdf in batches:
            rows = [dict(path=p, **header(bytes(c))) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "x0", "y0", "dx", "dy", "width", "height",
                                              "epsg"])
    schema = ("path STRING, x0 DOUBLE, y0 DOUBLE, dx DOUBLE, dy DOUBLE, width INT, height INT, "
              "epsg INT")
    return files.select("path", "content").mapInPandas(run, schema)


def tile_overlaps(headers: DataFrame) -> DataFrame:
    """Pairs of tile files (a, b) of one date folder whose footprints share
    cells.  Tiles meet in blocks of the largest tile's size, at most four
    each, so a tile is compared with its neighbours only."""
    size = headers.agg(F.max(F.col("width") * F.col("dx")).alias("w"),
                       F.max(F.col("height") * F.col("dy")).alias("h"))
    w, h = size.select("w").scalar(), size.select("h").scalar()
    box = headers.select(
        "path", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("dir"),
        F.col("x0").alias("l"), (F.col("x0") + F.col("width") * F.col("dx")).alias("r"),
        (F.col("y0") - F.col("height") * F.col("dy")).alias("b"), F.col("y0").alias("t"),
        (F.least("dx", "dy") / 2).alias("eps")).withColumn("w", w).withColumn("h", h)
    for axis, lo, hi, step in (("bx", "l", "r", "w"), ("by", "b", "t", "h")):
        box = box.withColumn(axis, F.explode(F.sequence(
            F.floor((F.col(lo) + F.col("eps")) / F.col(step)), F.floor((F.col(hi) - F.col("eps")) / F.col(step)))))
    one, two = box.alias("one"), box.alias("two")
    cond = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in ("dir", "bx", "by")] + [
        F.col("one.path") < F.col("two.path"),
        F.col("one.l") < F.col("two.r") - F.col("one.eps"), F.col("two.l") < F.col("one.r") - F.col("one.eps"),
        F.col("one.b") < F.col("two.t") - F.col("one.eps"), F.col("two.b") < F.col("one.t") - F.col("one.eps")]
    return one.join(two, cond).select(F.col("one.path").alias("a"), F.col("two.path").alias("b")).distinct()


def tile_footprints(headers: DataFrame, spec: GridSpec) -> DataFrame:
    """(tile, iy_lo, iy_hi, ix_lo, ix_hi), inclusive, of every tile of a tree:
    the cells that its files cover, whether they hold data or not."""
    headers = parse_tile_name(headers.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)), "file")
    key = F.regexp_extract("tile_key", TILE_RE, 1)
    left, top = (F.col("x0") + F.col("dx") / 2), (F.col("y0") - F.col("dy") / 2)
    boxes = headers.select(
        F.when(key != "", key).otherwise(F.col("tile_key")).alias("tile"),
        spec.iy_of(top).alias("iy_lo"), (spec.iy_of(top) + F.col("height") - 1).alias("iy_hi"),
        spec.ix_of(left).alias("ix_lo"), (spec.ix_of(left) + F.col("width") - 1).alias("ix_hi"))
    return boxes.groupBy("tile").agg(*[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in boxes.columns[1:]])


def infer_spec(headers: DataFrame, crs: str | None = None) -> GridSpec:
    """The grid that holds all tiles: union of their bounds at their common
    cell size (one aggregate row reaches the driver)."""
    from gridfold.model import WGS84
    r = headers.agg(F.min("x0").alias("w"), F.max(F.col("x0") + F.col("width") * F.col("dx")).alias("e"),
                    F.max("y0").alias("n"), F.min(F.col("y0") - F.col("height") * F.col("dy")).alias("s"),
                    F.min("dx").alias("dx"), F.max("dx").alias("dx_hi"),
                    F.min("dy").alias("dy"), F.max("dy").alias("dy_hi"),
                    F.max("epsg").alias("epsg")).first()
    if r is None or r["dx"] is None:
        raise ValueError("no tiles to infer the grid from")
    if abs(r["dx_hi"] - r["dx"]) > 1e-9 * r["dx"] or abs(r["dy_hi"] - r["dy"]) > 1e-9 * r["dy"]:
        raise ValueError("tiles have different cell sizes")
    crs = crs or (WGS84 if r["epsg"] == 4326 else (f"EPSG:{r['epsg']}" if r["epsg"] else WGS84))
    return GridSpec(x0=r["w"], y0=r["n"], dx=r["dx"], dy=r["dy"],
                    nx=int(round((r["e"] - r["w"]) / r["dx"])),
                    ny=int(round((r["n"] - r["s"]) / r["dy"])), crs=crs)


def write_tiles(cells: DataFrame, root: str, spec: GridSpec, tile_h: int, tile_w: int,
                prefix: str = "PRD_GPP", suffix: str = "v02", compression: str = "deflate",
                predictor: int = 2) -> str:
    """Write a cell stack as one float32 GeoTIFF per (date, tile) (K1, .tif).

    Tiles are named ``hHHvVV`` (tile column HH, row VV) and cover
    ``tile_h`` x ``tile_w`` cells; absent cells are NaN (the no-data value)."""
    bands = [b for b in BAND_COLS if b in cells.columns]
    root = root[len("file:"):] if root.startswith("file:") else root
    epsg = int(spec.crs.split(":")[1]) if spec.crs.startswith("EPSG:") else None

    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        date, tile = pdf["date"].iloc[0], pdf["tile"].iloc[0]
        h = int(tile[1:tile.index("v")])
        v = int(tile[tile.index("v") + 1:])
        r0, c0 = v * tile_h, h * tile_w
        hh, ww = min(tile_h, spec.ny - r0), min(tile_w, spec.nx - c0)
        arr = np.full((len(bands), hh, ww), np.nan, dtype=np.float32)
        rr = pdf["iy"].to_numpy() - r0
        cc = pdf["ix"].to_numpy() - c0
        for i, b in enumerate(bands):
            arr[i, rr, cc] = pdf[b].to_numpy(dtype=np.float64, na_value=np.nan)
        buf = encode(arr, spec.x0 + c0 * spec.dx, spec.y0 - r0 * spec.dy, spec.dx, spec.dy,
                     compression=compression, predictor=predictor, epsg=epsg)
        folder = os.path.join(root, date.strftime("%Y-%m-%d"))
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{prefix}_{date.strftime('%Y%m%d')}_{tile}_{suffix}.tif")
        # a retried or speculative task rewrites the same deterministic bytes;
        # writing aside and renaming keeps readers from seeing a partial file
        tmp = f"{path}.{uuid.uuid4().hex}.part"
        with open(tmp, "wb") as f:
            f.write(buf)
        os.replace(tmp, path)
        return pd.DataFrame({"path": [path], "n": [len(pdf)]})

    done = (cells.select("date", "tile", "iy", "ix", *bands)
                 .groupBy("date", "tile").applyInPandas(one_tile, "path STRING, n BIGINT"))
    done.write.format("noop").mode("overwrite").save()
    return root
