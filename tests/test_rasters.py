"""PNG masks and TIFF bands from files made by plain encoders."""

import struct
import zlib

import numpy as np
import pytest

from skylattice.plans import serving
from skylattice.sources import rasters as R


def png(values, colour, depth=8, filters=(0,), extra=()):
    """A PNG whose rows take the filters in turn."""
    height, width, samples = values.shape
    if depth == 16:
        rows = values.astype(">u2").view(np.uint8).reshape(height, -1)
    elif depth == 8:
        rows = values.astype(np.uint8).reshape(height, -1)
    else:
        flat = values.reshape(height, -1)
        rows = np.packbits(((flat[..., None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(height, -1).astype(np.uint8), axis=1)
    step, out, above = max(1, samples * depth // 8), b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows.astype(int)):
        left, corner = np.append(np.zeros(step, int), row[:-step] if step < len(row) else [])[: len(row)], np.append(np.zeros(step, int), above[:-step] if step < len(row) else [])[: len(row)]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][filters[y % len(filters)]]
        out += bytes([filters[y % len(filters)]]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + b"".join(part(k, v) for k, v in extra) + part(b"IDAT", packed[:7]) + part(b"IDAT", packed[7:]) + part(b"IEND", b"")


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
@pytest.mark.parametrize("colour, depth", [(6, 8), (4, 8), (6, 16), (2, 8), (0, 16), (3, 8), (3, 4), (0, 1)])
def test_png_samples_come_back(filters, colour, depth):
    rng = np.random.default_rng(depth)
    values = rng.integers(0, 2**depth, (7, 9, R.PNG_SAMPLES[colour]))
    got, kind, _ = R.png_samples(png(values, colour, depth, filters))
    assert kind == colour and (got == values).all()


def test_masks():
    rng = np.random.default_rng(1)
    rgba = rng.integers(0, 3, (6, 5, 4))
    assert (R.png_mask(png(rgba, 6)) == (rgba[..., 3] > 0)).all()
    assert (R.png_mask(png(rgba[..., :3], 2)) == 1).all()
    palette = rng.integers(0, 4, (6, 5, 1))
    assert (R.png_mask(png(palette, 3, extra=[(b"PLTE", b"abc" * 4), (b"tRNS", b"\xff\x00\x01")])) == (palette[..., 0] != 1)).all()
    assert (R.png_mask(png(rgba[..., :3], 2, extra=[(b"tRNS", struct.pack(">HHH", 1, 1, 1))])) == (rgba[..., :3] != 1).any(2)).all()
    rates = np.array([[0.0, 0.001, 0.01], [5.0, np.nan, -1.0]])
    assert R.png_mask(serving.png(rates)).tolist() == [[0, 0, 1], [1, 0, 0]]


def lzw(data):
    """Codes of growing width, with a table that is cleared when it is full."""
    table, bits, n, out = {bytes([i]): i for i in range(256)}, 9, 258, [(256, 9)]
    word = b""
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        out.append((table[word], bits))
        table[word + bytes([byte])] = n
        n += 1
        bits = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            out.append((256, bits))
            table, bits, n = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([byte])
    out += [(table[word], bits)] if word else []
    n += 1
    out.append((257, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12))
    text = "".join(format(c, f"0{b}b") for c, b in out)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100))}


def tiff(values, order="<", tile=None, rows=None, compression=1, predictor=1, planar=1):
    height, width, samples = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tall, wide = tile or (rows or height, width)
    parts = []
    for plane in [values] if planar == 1 else [values[..., k : k + 1] for k in range(samples)]:
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                part = plane[y : y + tall, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(values.dtype)
                raw = part.astype(values.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    planes = np.ascontiguousarray(part.astype(values.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(part), -1, values.dtype.itemsize).transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
                parts.append(PACK[compression](raw))
    data, starts = b"", []
    for p in parts:
        starts.append(8 + len(data))
        data += p + b"\0" * (len(p) % 2)
    tags = {R.WIDTH: [width], R.HEIGHT: [height], R.BITS: [values.dtype.itemsize * 8] * samples, R.COMPRESSION: [compression], R.SAMPLES: [samples], R.PLANAR: [planar], R.PREDICTOR: [predictor], R.FORMAT: [kind] * samples}
    tags |= {R.TILE_WIDTH: [wide], R.TILE_HEIGHT: [tall], R.TILES: starts, R.TILE_SIZES: [len(p) for p in parts]} if tile else {R.STRIP_ROWS: [tall], R.STRIPS: starts, R.STRIP_SIZES: [len(p) for p in parts]}
    at = 8 + len(data)
    more, entries, far = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        body = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
        entries += struct.pack(f"{order}HHI", tag, 4, len(tags[tag])) + (body if len(body) <= 4 else struct.pack(order + "I", far + len(more)))
        more += body if len(body) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + data + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + more


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("shape", [{}, {"rows": 3}, {"tile": (16, 16)}, {"planar": 2, "rows": 5}])
@pytest.mark.parametrize("compression", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("dtype, predictor", [("u1", 1), ("u2", 2), ("i4", 2), ("f4", 1), ("f4", 3), ("f8", 3)])
def test_tiff_bands(order, shape, compression, dtype, predictor):
    values = np.random.default_rng(3).integers(0, 200, (37, 29, 2)).astype(dtype)
    got = R.tiff_band(tiff(values, order, compression=compression, predictor=predictor, **shape))
    assert got.dtype == np.float32 and (got == values[..., 0].astype(np.float32)).all()


def test_long_lzw_tables_are_cleared():
    data = np.random.default_rng(4).integers(0, 255, 40_000).astype(np.uint8).tobytes()
    assert R._lzw(lzw(data)) == data


def test_bad_files_give_nulls(spark, tmp_path):
    good = tiff(np.arange(12, dtype="u2").reshape(3, 4, 1))
    for name, body in {"a.tif": good, "b.tif": good[:40], "c.tif": b"MM", "d.tif": b"II" + b"\0" * 50, "e.tif": good.replace(good[-60:-56], b"\xff\xff\xff\x7f")}.items():
        (tmp_path / name).write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rpartition("/")[2]: (r.height, r.width, r["values"]) for r in R.rasters(files).collect()}
    assert got["a.tif"] == (3, 4, [float(i) for i in range(12)]) and len(got) == 5
    assert all(got[n] == (None, None, None) for n in ("b.tif", "c.tif", "d.tif"))
    odd = spark.createDataFrame([("x", b""), ("y", None)], "path string, content binary")
    assert sorted(r.path for r in R.rasters(odd).where("values IS NULL").collect()) == ["x", "y"]
    assert R.rasters(files, R.png_mask).where("values IS NOT NULL").count() == 0
