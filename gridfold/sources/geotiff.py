"""A small GeoTIFF codec for gridded composites (numpy only).

Used inside Spark tasks: one call per file.  Reads classic TIFF and BigTIFF,
either byte order, strips or tiles, chunky or planar bands, 8-64 bit
integer or float samples, compression none / deflate / zstd, predictors
1 (none), 2 (horizontal differencing) and 3 (floating point).  Georeference
from ModelPixelScale + ModelTiepoint, no-data from the GDAL tag, the EPSG
code from the GeoKey directory.  Anything else raises.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np

try:
    import zstandard
except ImportError:  # pragma: no cover
    zstandard = None

# TIFF / GeoTIFF tag numbers, field types and codes.
IMAGE_WIDTH, IMAGE_LENGTH, BITS_PER_SAMPLE, COMPRESSION = 256, 257, 258, 259
PHOTOMETRIC, STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP = 262, 273, 277, 278
STRIP_BYTE_COUNTS, PLANAR_CONFIG, PREDICTOR = 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTE_COUNTS = 322, 323, 324, 325
SAMPLE_FORMAT = 339
MODEL_PIXEL_SCALE, MODEL_TIEPOINT, GEO_KEY_DIRECTORY, GDAL_NODATA = 33550, 33922, 34735, 42113
GEOGRAPHIC_TYPE_KEY, PROJECTED_CS_TYPE_KEY = 2048, 3072

TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i",
         10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8,
             16: 8, 17: 8, 18: 8}
CODEC_NONE, CODEC_DEFLATE, CODEC_ADOBE_DEFLATE, CODEC_ZSTD = 1, 8, 32946, 50000
CODECS = {"none": CODEC_NONE, "deflate": CODEC_DEFLATE, "zstd": CODEC_ZSTD}


@dataclass
class Raster:
    bands: np.ndarray          # (n_bands, height, width)
    x0: float                  # west edge
    y0: float                  # north edge
    dx: float
    dy: float
    nodata: float | None = None
    epsg: int | None = None


# -- reading -------------------------------------------------------------------
class _FileBytes:
    """Slice access to an open file, reading only the requested ranges."""

    def __init__(self, f):
        self.f = f

    def __getitem__(self, sl: slice) -> bytes:
        self.f.seek(sl.start or 0)
        return self.f.read(sl.stop - (sl.start or 0))
def _tags(buf) -> tuple[str, dict]:
    """Parse the first IFD.  ``buf`` is the file's bytes or a file object
    opened for binary reading (only the header and the IFD are read)."""
    if not isinstance(buf, (bytes, bytearray, memoryview)):
        buf = _FileBytes(buf)
    bo = {b"II": "<", b"MM": ">"}.get(bytes(buf[:2]))
    if bo is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack(bo + "H", buf[2:4])[0]
    if magic == 42:
        off = struct.unpack(bo + "I", buf[4:8])[0]
        n_fmt, n_size, ent, cnt_fmt, val_size = "H", 2, 12, "I", 4
    elif magic == 43:
        off = struct.unpack(bo + "Q", buf[8:16])[0]
        n_fmt, n_size, ent, cnt_fmt, val_size = "Q", 8, 20, "Q", 8
    else:
        raise ValueError("not a TIFF file")
    n = struct.unpack(bo + n_fmt, buf[off:off + n_size])[0]
    tags = {}
    for i in range(n):
        e = off + n_size + i * ent
        tag, typ = struct.unpack(bo + "HH", buf[e:e + 4])
        count = struct.unpack(bo + cnt_fmt, buf[e + 4:e + 4 + (ent - 4 - val_size)])[0]
        size = TYPE_SIZE.get(typ, 1) * count
        voff = e + ent - val_size
        if size > val_size:
            voff = struct.unpack(bo + ("I" if val_size == 4 else "Q"), buf[voff:voff + val_size])[0]
        raw = buf[voff:voff + size]
        if typ == 2:
            tags[tag] = raw.rstrip(b"\0").decode("ascii", "replace")
        else:
            fmt = TYPES.get(typ)
            if fmt is None:
                continue
            vals = struct.unpack(bo + fmt * count, raw) if fmt not in ("II", "ii") else \
                struct.unpack(bo + fmt[0] * (2 * count), raw)
            tags[tag] = vals
    return bo, tags


def _dtype(bo: str, bits: int, fmt: int) -> np.dtype:
    kind = {1: "u", 2: "i", 3: "f"}.get(fmt)
    if kind is None or bits not in (8, 16, 32, 64):
        raise NotImplementedError(f"sample format {fmt}/{bits} bits not supported")
    return np.dtype(f"{bo}{kind}{bits // 8}")


def _inflate(data: bytes, codec: int) -> bytes:
    if codec == CODEC_NONE:
        return data
    if codec in (CODEC_DEFLATE, CODEC_ADOBE_DEFLATE):
        return zlib.decompress(data)
    if codec == CODEC_ZSTD:
        if zstandard is None:
            raise NotImplementedError("zstd not available")
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    raise NotImplementedError(f"TIFF compression {codec} not supported")


def _unpredict(block: np.ndarray, predictor: int, dtype: np.dtype, spp: int) -> np.ndarray:
    """block: (rows, cols * spp) samples of ``dtype`` (raw bytes view)."""
    if predictor == 1:
        return block
    if predictor == 2:
        u = block.view(f"{dtype.byteorder}u{dtype.itemsize}")
        rows, n = u.shape
        u = u.astype(u.dtype.newbyteorder("="), copy=True).reshape(rows, n // spp, spp)
        np.cumsum(u, axis=1, dtype=u.dtype, out=u)
        return u.reshape(rows, n).view(np.dtype(dtype).newbyteorder("=")).astype(dtype.newbyteorder("="))
    if predictor == 3:
        rows, n = block.shape
        size = dtype.itemsize
        b = block.view(np.uint8).reshape(rows, n * size).copy()
        # undo byte differencing along the row (spp interleaved bytes)
        b = b.reshape(rows, -1, spp)
        np.cumsum(b, axis=1, dtype=np.uint8, out=b)
        b = b.reshape(rows, size, n)  # byte planes, most significant first
        out = np.ascontiguousarray(b.transpose(0, 2, 1))  # (rows, n, size) big-endian order
        return out.view(np.dtype(f">{dtype.kind}{size}")).reshape(rows, n).astype(
            dtype.newbyteorder("="))
    raise NotImplementedError(f"TIFF predictor {predictor} not supported")


def header(buf) -> dict:
    """Georeference and size without decoding pixels: x0, y0, dx, dy,
    width, height, epsg (``buf``: bytes or an open binary file)."""
    _, t = _tags(buf)
    x0, y0, dx, dy, _nodata, epsg = georef(t)
    return {"x0": x0, "y0": y0, "dx": dx, "dy": dy, "width": t[IMAGE_WIDTH][0],
            "height": t[IMAGE_LENGTH][0], "epsg": epsg}


@dataclass
class Layout:
    bo: str
    dtype: np.dtype
    width: int
    height: int
    spp: int
    planar: int
    codec: int
    predictor: int
    blocks: list          # (plane, row0, col0, rows, cols, offset, byte_count)
    tags: dict


def layout(buf) -> Layout:
    """Sample layout and the list of compressed blocks (strips or tiles)."""
    bo, t = _tags(buf)
    w, h = t[IMAGE_WIDTH][0], t[IMAGE_LENGTH][0]
    spp = t.get(SAMPLES_PER_PIXEL, (1,))[0]
    dtype = _dtype(bo, t.get(BITS_PER_SAMPLE, (1,))[0], t.get(SAMPLE_FORMAT, (1,))[0])
    planar = t.get(PLANAR_CONFIG, (1,))[0]
    planes = spp if planar == 2 else 1
    if TILE_WIDTH in t:
        bw, bh = t[TILE_WIDTH][0], t[TILE_LENGTH][0]
        offs, counts = t[TILE_OFFSETS], t[TILE_BYTE_COUNTS]
        across, down = math.ceil(w / bw), math.ceil(h / bh)
        geo = [(p, r * bh, c * bw, bh, bw) for p in range(planes)
               for r in range(down) for c in range(across)]
    else:
        rps = min(t.get(ROWS_PER_STRIP, (h,))[0], h)
        offs, counts = t[STRIP_OFFSETS], t[STRIP_BYTE_COUNTS]
        geo = [(p, s * rps, 0, min(rps, h - s * rps), w) for p in range(planes)
               for s in range(math.ceil(h / rps))]
    blocks = [g + (o, c) for g, o, c in zip(geo, offs, counts)]
    return Layout(bo, dtype, w, h, spp, planar, t.get(COMPRESSION, (1,))[0],
                  t.get(PREDICTOR, (1,))[0], blocks, t)


def decode_block(raw: bytes, lay: Layout, block) -> np.ndarray:
    """One compressed block -> (bands_in_block, rows, cols), cut to the image."""
    p, r0, c0, bh, bw, _off, _cnt = block
    per_block = 1 if lay.planar == 2 else lay.spp
    a = np.frombuffer(_inflate(raw, lay.codec), dtype=lay.dtype,
                      count=bh * bw * per_block).reshape(bh, bw * per_block)
    a = _unpredict(a, lay.predictor, lay.dtype, per_block).reshape(bh, bw, per_block)
    rh, rw = min(bh, lay.height - r0), min(bw, lay.width - c0)
    return np.moveaxis(a[:rh, :rw, :], 2, 0)


def georef(t: dict) -> tuple[float, float, float, float, float | None, int | None]:
    """(x0, y0, dx, dy, nodata, epsg) from the tags."""
    scale = t.get(MODEL_PIXEL_SCALE, (1.0, 1.0, 0.0))
    tie = t.get(MODEL_TIEPOINT, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    nodata = None
    if GDAL_NODATA in t:
        try:
            nodata = float(t[GDAL_NODATA].strip())
        except ValueError:
            nodata = None
    epsg = None
    gk = t.get(GEO_KEY_DIRECTORY)
    if gk:
        for i in range(gk[3]):
            key, loc, _cnt, val = gk[4 + 4 * i: 8 + 4 * i]
            if key in (GEOGRAPHIC_TYPE_KEY, PROJECTED_CS_TYPE_KEY) and loc == 0:
                epsg = val
    return (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1],
            nodata, epsg)


def decode(buf: bytes) -> Raster:
    """Decode a GeoTIFF held in memory."""
    lay = layout(buf)
    out = np.empty((lay.spp, lay.height, lay.width), dtype=lay.dtype.newbyteorder("="))
    for blk in lay.blocks:
        p, r0, c0, _bh, _bw, off, cnt = blk
        part = decode_block(buf[off:off + cnt], lay, blk)
        rh, rw = part.shape[1:]
        if lay.planar == 2:
            out[p, r0:r0 + rh, c0:c0 + rw] = part[0]
        else:
            out[:, r0:r0 + rh, c0:c0 + rw] = part
    x0, y0, dx, dy, nodata, epsg = georef(lay.tags)
    return Raster(out, x0, y0, dx, dy, nodata, epsg)


# -- writing -------------------------------------------------------------------
def _predict(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    if predictor == 2:
        u = block.view(f"u{block.dtype.itemsize}").copy()
        u[:, 1:] = u[:, 1:] - u[:, :-1]
        return u.view(block.dtype)
    if predictor == 3:
        rows, n = block.shape
        size = block.dtype.itemsize
        be = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, n, size)
        b = np.ascontiguousarray(be.transpose(0, 2, 1)).reshape(rows, n * size)
        d = b.copy()
        d[:, 1:] = b[:, 1:] - b[:, :-1]
        return d.view(np.uint8)
    raise NotImplementedError(f"TIFF predictor {predictor} not supported")


def encode(bands: np.ndarray, x0: float, y0: float, dx: float, dy: float,
           nodata: float | None = float("nan"), compression: str = "deflate",
           predictor: int = 2, block: int | None = None, rows_per_strip: int = 16,
           bigtiff: bool = False, epsg: int | None = None) -> bytes:
    """Encode (n_bands, h, w) samples as a little-endian planar GeoTIFF.

    ``block`` set -> square tiles of that size (a multiple of 16); else
    strips of ``rows_per_strip`` rows."""
    bands = np.ascontiguousarray(bands)
    if bands.ndim == 2:
        bands = bands[None]
    nb, h, w = bands.shape
    dt = bands.dtype.newbyteorder("<")
    bands = bands.astype(dt)
    codec = CODECS[compression]
    fmt = {"u": 1, "i": 2, "f": 3}[dt.kind]
    chunks = []
    if block:
        across, down = math.ceil(w / block), math.ceil(h / block)
        for p in range(nb):
            for r in range(down):
                for c in range(across):
                    a = np.zeros((block, block), dtype=dt)
                    part = bands[p, r * block:(r + 1) * block, c * block:(c + 1) * block]
                    a[:part.shape[0], :part.shape[1]] = part
                    chunks.append(a)
    else:
        for p in range(nb):
            for r in range(0, h, rows_per_strip):
                chunks.append(bands[p, r:r + rows_per_strip, :])
    payload = []
    for a in chunks:
        raw = _predict(np.ascontiguousarray(a), predictor).tobytes()
        if codec == CODEC_DEFLATE:
            raw = zlib.compress(raw, 6)
        elif codec == CODEC_ZSTD:
            raw = zstandard.ZstdCompressor(level=3).compress(raw)
        payload.append(raw)
    head = 16 if bigtiff else 8
    offsets, pos = [], head
    for raw in payload:
        offsets.append(pos)
        pos += len(raw)
    counts = [len(r) for r in payload]
    pad = b"\0" * (pos % 2)          # the IFD starts on a word boundary
    pos += len(pad)
    off_type = 16 if bigtiff else 4
    tags = [
        (IMAGE_WIDTH, 4, [w]), (IMAGE_LENGTH, 4, [h]), (BITS_PER_SAMPLE, 3, [dt.itemsize * 8] * nb),
        (COMPRESSION, 3, [codec]), (PHOTOMETRIC, 3, [1]), (SAMPLES_PER_PIXEL, 3, [nb]),
        (PLANAR_CONFIG, 3, [2]), (PREDICTOR, 3, [predictor]), (SAMPLE_FORMAT, 3, [fmt] * nb),
        (MODEL_PIXEL_SCALE, 12, [dx, dy, 0.0]), (MODEL_TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]),
    ]
    if block:
        tags += [(TILE_WIDTH, 3, [block]), (TILE_LENGTH, 3, [block]),
                 (TILE_OFFSETS, off_type, offsets), (TILE_BYTE_COUNTS, off_type, counts)]
    else:
        tags += [(STRIP_OFFSETS, off_type, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]),
                 (STRIP_BYTE_COUNTS, off_type, counts)]
    if epsg:
        key = GEOGRAPHIC_TYPE_KEY if epsg == 4326 else PROJECTED_CS_TYPE_KEY
        tags.append((GEO_KEY_DIRECTORY, 3, [1, 1, 0, 1, key, 0, 1, epsg]))
    if nodata is not None:
        tags.append((GDAL_NODATA, 2, list(repr(float(nodata)).encode() + b"\0")))
    tags.sort(key=lambda e: e[0])
    val_size = 8 if bigtiff else 4
    ent = 20 if bigtiff else 12
    ifd_off = pos
    n_fmt = "<Q" if bigtiff else "<H"
    ifd_size = struct.calcsize(n_fmt) + ent * len(tags) + val_size
    extra_pos = ifd_off + ifd_size
    entries, extra = [], b""
    for tag, typ, vals in tags:
        if typ == 2:
            data = bytes(vals)
        else:
            data = struct.pack("<" + TYPES[typ] * len(vals), *vals)
        cnt = len(vals)
        if len(data) <= val_size:
            field = data.ljust(val_size, b"\0")
        else:
            field = struct.pack("<Q" if bigtiff else "<I", extra_pos + len(extra))
            extra += data + (b"\0" if len(data) % 2 else b"")
        entries.append(struct.pack("<HH" + ("Q" if bigtiff else "I"), tag, typ, cnt) + field)
    ifd = struct.pack(n_fmt, len(tags)) + b"".join(entries) + b"\0" * val_size
    header = (b"II" + struct.pack("<HHHQ", 43, 8, 0, ifd_off)) if bigtiff else \
        (b"II" + struct.pack("<HI", 42, ifd_off))
    return header + b"".join(payload) + pad + ifd + extra
