"""Line dedup by winnowing over line hashes, extended to exact windows.

Lines with words are hashed by their words (A-Z lower-cased, any white space between).  A
window is a run of lines with at least ``min_words`` words that has fewer without its last
line, or fewer without its first.  Every line of a run of ``min_words`` words or more stands
in such a window inside the run, and where the run occurs the window does, so a line is in
a run that occurred before exactly if one of its windows did.

Each window selects its line with the smallest hash (the first of equal ones): a guaranteed
fingerprint, as equal windows select the same line.  Positions are joined by fingerprint; only where
one stands at two positions or more are the windows that selected it gone into, backwards and
forwards from it.  They are joined by two independent hashes of all their lines, 128 bits; the lines of every
occurrence but the first are deleted.

Documents come in the order of their ids; a repeated run within one document counts too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textbytes import TextSlice, bounded_batches, folded_ranges, list_array, slices

#: Deletions of up to so many documents are broadcast; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 200_000


def line_units(texts: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes, number of words and text of every line with words, in order."""
    starts, ends, first = texts.words()
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    breaks = np.flatnonzero(texts.data == 10)
    line = np.searchsorted(breaks, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(starts)) if len(at) else at
    h, check = (folded_ranges(texts.hashes(starts, ends, family=k), at, stop, k) for k in (0, 1))
    return h, check, stop - at, owner[at]


def winnowed(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The line with the smallest hash in each window, the first of equal ones."""
    where = low.copy()
    live, j = np.flatnonzero(low + 1 < high), 1
    while len(live):
        line = low[live] + j
        better = h[line] < h[where[live]]
        where[live[better]] = line[better]
        j += 1
        live = live[low[live] + j < high[live]]
    return where


def windows(h: np.ndarray, words: np.ndarray, owner: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last (places among all) and hash of every window, in the order of first lines."""
    total = np.append(0, np.cumsum(words))
    start, stop = np.searchsorted(owner, owner), np.searchsorted(owner, owner, "right")
    ahead = np.searchsorted(total, total[:-1] + min_words)  # after the last line of the window that begins at a line
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1  # first line of the window that ends with a line
    low, last = np.flatnonzero(ahead <= stop), np.flatnonzero(back >= start)
    last = last[ahead[back[last]] != last + 1]  # else it is the window from its first line on, too
    low, high = np.append(low, back[last]), np.append(ahead[low], last + 1)
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    return low, high, folded_ranges(h, low, high)


def merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs that ranges of lines make together; rows come in order."""
    apart = row.astype(np.int64) * (int(high.max(initial=0)) + 2)
    order = np.argsort(apart + low, kind="stable")
    row, apart, low = row[order], apart[order], low[order]
    reach = np.maximum.accumulate(apart + high[order])
    at = np.flatnonzero(np.append(True, apart[1:] + low[1:] > reach[:-1]))
    return row[at], low[at], reach[np.append(at[1:], len(reach)) - 1] - apart[at]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50) -> DataFrame:
    """id, digest (of the text), lows and highs: the lines with words to delete from each document."""
    key = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    # rows with the same id and text are one document
    named = key.select(F.coalesce("id", F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    spots = written(_keyed_windows(named, min_words), "windows")
    shared = spots.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    kept = spots.join(shared, "print").select("id", "digest", F.explode(F.arrays_zip("lows", "highs", "keys", "checks")).alias("w"))
    kept = kept.select("id", "digest", F.col("w.lows").alias("low"), F.col("w.highs").alias("high"), F.col("w.keys").alias("key"), F.col("w.checks").alias("check"))
    place = F.struct("id", "digest", "low")
    first = kept.groupBy("key", "check").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("key", "check", "f")
    later = kept.join(first, ["key", "check"]).where(place > F.col("f"))
    ranges = later.groupBy("id", "digest").agg(F.collect_set(F.struct("low", "high")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2)
            low, high = (x.to_numpy(zero_copy_only=False) for x in at.flatten().flatten())
            row, low, high = merged(np.repeat(np.arange(len(batch)), at.value_lengths().to_numpy(zero_copy_only=False)), low, high)
            each = np.bincount(row, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(low, each, pa.int32()), list_array(high, each, pa.int32())], names=["id", "digest", "lows", "highs"])

    return ranges.mapInArrow(run, "id long, digest long, lows array<int>, highs array<int>")


def _keyed_windows(named: DataFrame, min_words: int) -> DataFrame:
    """id, digest, print, lows, highs, keys, checks: a row for each fingerprint's position, with the windows that selected it."""
    bounded_batches(named.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(2)):
                h, check, words, owner = line_units(texts)
                low, high, key = windows(h, words, owner, min_words)
                if not len(low):
                    continue
                spot = winnowed(h, low, high)
                order = np.argsort(spot, kind="stable")
                low, high, key, spot = low[order], high[order], key[order], spot[order]
                keys = [key.view(np.int64), folded_ranges(check, low, high, 1).view(np.int64)]
                opening = np.searchsorted(owner, np.arange(len(texts)))[owner[low]]
                first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
                each, row = np.diff(np.append(first, len(spot))), pa.array(at + owner[spot[first]])
                lists = [list_array((low - opening).astype(np.int32), each, pa.int32()), list_array((high - opening).astype(np.int32), each, pa.int32()), *(list_array(x, each, pa.int64()) for x in keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h[spot[first]].view(np.int64)), *lists], names=["id", "digest", "print", "lows", "highs", "keys", "checks"])

    return named.select("id", "digest", "text").mapInArrow(run, "id long, digest long, print long, lows array<int>, highs array<int>, keys array<long>, checks array<long>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50, prefix: str = "") -> DataFrame:
    """docs with the text cleaned, and <prefix>lines_removed (those with words) and <prefix>words_removed.

    Deleted are later copies of equal runs of lines with at least ``min_words`` words; blank lines
    inside such a run go with it.  Null and empty texts stay as they are.  Rows with the same id and text
    are one document and come out alike; rows with the same id and other texts are told apart by the text.
    A null id comes before all others.  Columns of docs that bear the new names need another ``prefix``.
    """
    new = [prefix + x for x in ("lines_removed", "words_removed")]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    bounded_batches(docs.sparkSession)
    runs = written(repeated_runs(docs, id_col, text_col, min_words=min_words), "runs").toDF("_run_id", "_run_digest", "_lows", "_highs")
    if runs.count() <= BROADCAST_DOCUMENTS:
        runs = F.broadcast(runs)
    on = (F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))) == F.col("_run_id")) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("_run_digest"))
    marked = docs.join(runs, on, "left").select(*[docs[c] for c in docs.columns], "_lows", "_highs")
    place, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(new[0], T.IntegerType()), T.StructField(new[1], T.IntegerType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(width)]
            lines, words = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            hit = np.flatnonzero(batch.column(width).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts = columns[place].to_pylist()
                for i in hit:
                    texts[i], lines[i], words[i] = without(texts[i], batch.column(width)[i].as_py(), batch.column(width + 1)[i].as_py())
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(words)], names=schema.fieldNames())

    return marked.mapInArrow(rebuild, schema)


def without(text: str, lows: list[int], highs: list[int]) -> tuple[str, int, int]:
    """The text without the lines with words numbered low to high - 1, and how many lines and words went."""
    gone = {i for low, high in zip(lows, highs, strict=True) for i in range(low, high)}
    kept, at, words, last = [], 0, 0, False
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            last = at in gone
            words += n * last
            at += 1
        if not (n and last) and not (not n and last and at in gone):
            kept.append(line)
    return "\n".join(kept), len(gone), words
