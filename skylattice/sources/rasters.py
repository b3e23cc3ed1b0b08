"""Images of landed files as arrays: the transparency of PNG images and the first band of TIFF rasters.

Files come from Spark's binaryFile reader; one row in is one row out, and a file that can't be read has NULLs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the formats: samples a pixel by PNG colour type; bytes, numpy kind by TIFF field type; tags.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
TIFF_TYPES = {1: "u1", 2: "u1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339


# ---- PNG


def _unfiltered(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes with each row's filter (none, left, up, mean, Paeth) taken back; ``step`` bytes are a pixel."""
    lines = raw[: rows * (stride + 1)].reshape(rows, stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for k in range(step):  # a running sum of each sample
                out[y, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now, before = out[y], above.tolist()
            left, corner, done = [0] * step, [0] * step, []
            for i, v in enumerate(line.tolist()):
                a, b, c = left[i % step], before[i], corner[i % step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                v = (v + guess) & 255
                left[i % step], corner[i % step] = v, b
                done.append(v)
            now[:] = done
        else:
            raise ValueError("no such filter")
        above = out[y]
    return out


def png_samples(content: bytes) -> tuple[np.ndarray, int, dict[bytes, bytes]]:
    """Samples (height x width x samples), colour type and the other chunks of a PNG that is not interlaced."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, chunks = 8, [], {}
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is broken")
        if kind == b"IDAT":
            data.append(body)
        else:
            chunks[kind] = body
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if interlaced or colour not in PNG_SAMPLES:
        raise ValueError("interlaced, or no colour type")
    samples = PNG_SAMPLES[colour]
    stride = -(-width * samples * depth // 8)
    rows = _unfiltered(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), height, stride, max(1, samples * depth // 8))
    if depth == 16:
        values = rows.reshape(height, -1, 2).astype(np.uint16)
        values = values[..., 0] << 8 | values[..., 1]
    elif depth == 8:
        values = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)
    return values[:, : width * samples].reshape(height, width, samples), colour, chunks


def png_mask(content: bytes) -> np.ndarray:
    """1 where an image is not wholly transparent, else 0; an image without transparency is 1 everywhere."""
    values, colour, chunks = png_samples(content)
    if colour in (4, 6):
        return (values[..., -1] > 0).astype(np.float32)
    clear = chunks.get(b"tRNS")
    if clear is None:
        return np.ones(values.shape[:2], np.float32)
    if colour == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return (alpha[values[..., 0]] > 0).astype(np.float32)
    return (values != np.frombuffer(clear, ">u2")).any(2).astype(np.float32)


# ---- TIFF


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, held, bits, size = [], 0, 0, 9
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            size, last = 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _lzw, 8: zlib.decompress, 32773: _packbits, 32946: zlib.decompress}


def tiff_band(content: bytes) -> np.ndarray:
    """The first band of the first image of a TIFF, in strips or tiles, of either byte order."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    if struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict[int, np.ndarray] = {}
    for i in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(order + "HHII", content[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind in TIFF_TYPES:
            dtype = np.dtype(order + TIFF_TYPES[kind])
            place = at + 10 + 12 * i
            if n * dtype.itemsize > 4:
                place = struct.unpack(order + "I", content[place : place + 4])[0]
            tags[tag] = np.frombuffer(content, dtype, n, place)
    one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(bits // 8))
    if bits % 8:
        raise ValueError("samples of less than a byte")
    tiled = TILES in tags
    tall, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    across, down = -(-width // wide), -(-height // tall)
    inner = 1 if one(PLANAR, 1) == 2 else samples  # planes apart: those of the first band come first
    out = np.zeros((height, width), np.float32)
    starts, sizes = tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES]
    for i in range(across * down):
        y, x = i // across * tall, i % across * wide
        rows = tall if tiled else min(tall, height - y)
        raw = _UNPACK[one(COMPRESSION, 1)](content[int(starts[i]) : int(starts[i]) + int(sizes[i])])
        part = _predicted(raw, rows, wide, inner, dtype, one(PREDICTOR, 1))
        out[y : y + rows, x : x + wide] = part[: height - y, : width - x, 0]
    return out


def _predicted(raw: bytes, rows: int, wide: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """Samples of a strip or tile; predictor 2 gives differences along a row, 3 those of the bytes of floats, sorted by weight."""
    n = rows * wide * samples
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8, n * dtype.itemsize).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        heavy = planes.reshape(rows, dtype.itemsize, wide * samples).transpose(0, 2, 1)  # the heaviest byte first
        return np.ascontiguousarray(heavy).view(dtype.newbyteorder(">")).reshape(rows, wide, samples)
    values = np.frombuffer(raw, dtype, n).reshape(rows, wide, samples)
    return np.cumsum(values, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else values


# ---- tables


def rasters(files: DataFrame, read: Callable[[bytes], np.ndarray] = tiff_band) -> DataFrame:
    """path, height, width, values (row-major) of files (path, content); NULLs for a file that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = read(content.as_py())
                    row = [[found.shape[0]], [found.shape[1]], [found.ravel()]]
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
                    row = [[None]] * 3
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), *(pa.array(v, k) for v, k in zip(row, kinds, strict=True))], names=["path", "height", "width", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, height int, width int, values array<float>")
