"""GeoTIFF codec round trips (every layout, codec and predictor claimed)."""

import numpy as np
import pytest

from gridfold.sources.geotiff import decode, encode


@pytest.mark.parametrize("compression", ["none", "deflate", "zstd"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("block", [None, 16])
@pytest.mark.parametrize("bigtiff", [False, True])
def test_float_roundtrip(compression, predictor, block, bigtiff):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(2, 37, 51)).astype(np.float32)
    a[0, 3, 4] = np.nan
    r = decode(encode(a, 10.0, 61.0, 0.5, 0.25, compression=compression, predictor=predictor,
                      block=block, bigtiff=bigtiff, epsg=4326))
    assert np.array_equal(r.bands, a, equal_nan=True)
    assert (r.x0, r.y0, r.dx, r.dy, r.epsg) == (10.0, 61.0, 0.5, 0.25, 4326)


@pytest.mark.parametrize("predictor", [1, 2])
def test_int16_with_nodata(predictor):
    a = np.arange(660, dtype=np.int16).reshape(1, 20, 33)
    r = decode(encode(a, 0.0, 0.0, 1.0, 1.0, nodata=-1, predictor=predictor))
    assert np.array_equal(r.bands, a) and r.nodata == -1


def test_rejects_unknown():
    with pytest.raises(ValueError):
        decode(b"GIF89a" + b"\0" * 20)


def _big_endian_chunky(a: np.ndarray, deflate: bool, predictor: int) -> bytes:
    """A hand-built big-endian, band-interleaved (chunky), single-strip TIFF."""
    import struct
    import zlib
    nb, h, w = a.shape
    px = np.ascontiguousarray(np.moveaxis(a, 0, 2)).astype(">f4")      # (h, w, nb)
    if predictor == 2:
        u = px.view(">u4").astype(np.uint32).reshape(h, w * nb)
        d = u.copy()
        d[:, nb:] = u[:, nb:] - u[:, :-nb]
        raw = d.astype(">u4").tobytes()
    else:
        raw = px.tobytes()
    data = zlib.compress(raw) if deflate else raw
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32] * nb), (259, 3, [8 if deflate else 1]),
               (262, 3, [1]), (273, 4, [8]), (277, 3, [nb]), (278, 4, [h]), (279, 4, [len(data)]),
               (284, 3, [1]), (317, 3, [predictor]), (339, 3, [3] * nb),
               (33550, 12, [0.5, 0.25, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 61.0, 0.0])]
    ifd_off = 8 + len(data) + (len(data) % 2)
    extra_off = ifd_off + 2 + 12 * len(entries) + 4
    fmt = {3: "H", 4: "I", 12: "d"}
    body, extra = b"", b""
    for tag, typ, vals in entries:
        payload = struct.pack(">" + fmt[typ] * len(vals), *vals)
        if len(payload) <= 4:
            field = payload.ljust(4, b"\0")
        else:
            field = struct.pack(">I", extra_off + len(extra))
            extra += payload
        body += struct.pack(">HHI", tag, typ, len(vals)) + field
    return (b"MM" + struct.pack(">HI", 42, ifd_off) + data + b"\0" * (len(data) % 2)
            + struct.pack(">H", len(entries)) + body + b"\0\0\0\0" + extra)


@pytest.mark.parametrize("deflate,predictor", [(False, 1), (True, 1), (True, 2)])
def test_big_endian_chunky(deflate, predictor):
    a = np.random.default_rng(3).normal(size=(2, 9, 13)).astype(np.float32)
    r = decode(_big_endian_chunky(a, deflate, predictor))
    assert np.array_equal(r.bands, a)
    assert (r.x0, r.y0, r.dx, r.dy) == (10.0, 61.0, 0.5, 0.25)
