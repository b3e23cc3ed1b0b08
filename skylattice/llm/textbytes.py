"""Whole texts as flat byte arrays.

Word rules shared by the text operators: A-Z are lower-cased, words are
``[^\\x20\\x09-\\x0D]+``.  Both touch ASCII bytes only, so they can be applied to
UTF-8 bytes directly; every pass below is a numpy pass over a slice of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are handled in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Ranges of up to so many steps are hashed side by side, longer ones one by one.
STEPS = 32
_FOLDS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))
_LOW_BYTES = np.append((np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def folded(value_at: Callable[[np.ndarray, int], np.ndarray], long: Callable[[int], bytes], steps: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each row's sequence of ``steps`` values: multiply and xor-shift after every value, which is no sum of powers.

    ``value_at(rows, j)`` gives the j-th values of rows; ``long(row)`` the bytes of a row of more than STEPS values,
    which get a keyed BLAKE2b.  The two families are independent of each other.
    """
    turn = _FOLDS[family]
    h = mix(steps.astype(np.uint64) + turn)
    far = np.flatnonzero(steps > STEPS)
    live = np.flatnonzero((steps > 0) & (steps <= STEPS))
    for j in range(STEPS):
        if not len(live):
            break
        x = (h[live] ^ value_at(live, j)) * turn
        h[live] = x ^ x >> np.uint64(32)
        live = live[steps[live] > j + 1]
    if len(far):
        key = bytes([family + 1]) * 8
        h[far] = np.frombuffer(b"".join(blake2b(long(i), digest_size=8, key=key).digest() for i in far), np.uint64)
    return mix(h)


def folded_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of 64-bit values, in their order."""
    return folded(lambda live, j: values[starts[live] + j], lambda i: values[starts[i] : ends[i]].tobytes(), ends - starts, family)


def folded_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of bytes, alike wherever they stand."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = folded(lambda live, j: eights[starts[live] + 8 * j] & _LOW_BYTES[np.minimum(size[live] - 8 * j, 8)], lambda i: data[starts[i] : ends[i]].tobytes(), -(-size // 8), family)
    return mix(h ^ size.astype(np.uint64) * _FOLDS[family])


class TextSlice:
    """Consecutive texts: ``data`` their bytes, ``offsets`` (one more than texts) into it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text (and the end) the index of its first word."""
        n = len(self.data)
        word = ~SPACE[self.data]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[self.offsets[:-1][self.offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte range, alike wherever the bytes stand."""
        return folded_bytes(LOWER[self.data] if lower else self.data, starts, ends, family)

    def text_of(self) -> np.ndarray:
        """For each byte the index of its text."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, TextSlice]]:
    """(first row, row after the last, texts) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, TextSlice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``make()`` runs once in a task and gives ``f(ids, texts) -> dict of columns or None``.

    ids is an Arrow array, texts a :class:`TextSlice`.  Other columns of df are not read.
    """
    bounded_batches(df.sparkSession)
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                out = f(batch.column(0).slice(at, to - at), texts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in zip(out, target, strict=True)], schema=target)

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in ddl.split(","))])


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and each row's length."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows)])
