"""Phrase collocations by vertical positional inverted lists.

Texts are taken in shards of a few MB.  A shard's inverted file holds for every word the ascending
list of its positions; between pieces a position is left out, so no phrase can cross.  Only what is frequent in all
shards together is extended: the list of a phrase is merge-joined with the lists of what stands one
position on, which gives the lists of the phrases that are one word longer.  A list's length is the phrase's exact
frequency in the shard; the sums over shards decide what is extended next.

Lists of rare words are left out by a join; which pairs and longer phrases are frequent is told to the shards by a table
of flags of one size.  A flag that another phrase shares costs work only, as sums decide.  Between levels the counts are
shuffled and nothing else; positions stay with their shard, and texts are never read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, written
from .textbytes import LOWER, TextSlice, bounded_batches, mix, slices

#: Texts of about so many bytes make a shard (a longer text is a shard of its own).
SHARD_BYTES = 8 << 20
#: Bits of the table of flags that tells most phrases that can't be frequent, 16 MB at any size of the input.
FLAG_BITS = 27
#: Parts in which a language's best phrases are cut before they are ranked.
PARTS = 16

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 32]] = True
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True


def positions(texts: TextSlice) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (A-Z lower-cased), the position and the text of each; positions leave one out between pieces."""
    solid = ~(_BLANK | _BREAK)[texts.data]
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.offsets] = True
    before = np.append(False, solid[:-1]) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.append(solid[1:], False) if len(solid) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    breaks = np.cumsum(_BREAK[texts.data])[starts] if len(starts) else starts
    fresh = np.append(True, (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])) if len(starts) else np.zeros(0, bool)
    at = np.arange(len(starts)) + np.cumsum(fresh)
    letters = LOWER[texts.data[solid]]
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    return words, at, owner


def packed_lists(number: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, bytes]:
    """Length of each of n lists, and all positions list after list (ascending within one) as differences."""
    order = np.argsort(number, kind="stable")
    return np.bincount(number, minlength=n), np.diff(at[order], prepend=0).astype(np.int32).tobytes()


def unpacked(lengths: np.ndarray, lists: bytes) -> tuple[np.ndarray, np.ndarray]:
    """List number and position of every occurrence."""
    return np.repeat(np.arange(len(lengths)), lengths), np.cumsum(np.frombuffer(lists, np.int32).astype(np.int64))


def _inverted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """shard, no, lang, word, n for every word of a shard and language, and one row (no -1) with lengths and lists."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 33, [], 0

        def inverted() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            table = pa.Table.from_batches(held).combine_chunks()
            langs = table.column(0).combine_chunks().dictionary_encode()
            for low, high, texts in slices(table.column(1), SHARD_BYTES):
                words, at, owner = positions(texts)
                if not len(words):
                    continue
                shard += 1
                coded = words.dictionary_encode()
                code = coded.indices.to_numpy() + len(coded.dictionary) * langs.indices.to_numpy()[low:high][owner].astype(np.int64)
                known, number = np.unique(code, return_inverse=True)
                n, lists = packed_lists(number, at, len(known))
                spell = coded.dictionary.take(pa.array(known % len(coded.dictionary))).cast(pa.string())
                lang = langs.dictionary.take(pa.array(known // len(coded.dictionary)))
                yield _batch(shard, np.arange(len(known)), [lang, spell], n, None)
                yield _batch(shard, np.array([-1]), [pa.nulls(1, pa.string())] * 2, np.array([len(at)]), [n.astype(np.int32).tobytes(), lists])

        def _batch(shard: int, no: np.ndarray, names: list, n: np.ndarray, lists: list | None) -> pa.RecordBatch:
            blobs = [pa.array([x], pa.binary()) for x in lists] if lists else [pa.nulls(len(no), pa.binary())] * 2
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(no), shard)), pa.array(no.astype(np.int32)), *names, pa.array(n.astype(np.int64)), *blobs], names=["shard", "no", "lang", "word", "n", "lengths", "lists"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                yield from inverted()
                held, size = [], 0
        if held:
            yield from inverted()

    return rows.mapInArrow(run, "shard long, no int, lang string, word string, n long, lengths binary, lists binary")


def _adjacent(at: np.ndarray, name: np.ndarray, size: int, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``size`` words that stand in a shard (numbers into its words, a row each) and the length of each one's list.

    at and name are the positions of frequent words, ascending.  The lists of phrases of one word less that may be frequent are
    merge-joined with what stands one position on.
    """
    start = np.flatnonzero(at[1:] == at[:-1] + 1)  # merge join of the words' lists: a word, and one at the next position
    for words in range(2, size):
        if flags is not None and words == size - 1:
            start = start[_flagged(flags, [name[start + k] for k in range(words)])]
        start = start[:-1][start[1:] == start[:-1] + 1] if len(start) else start
    if not len(start):
        return np.zeros((0, size), np.int64), np.zeros(0, np.int64)
    order = np.lexsort([name[start + k] for k in range(size - 1, -1, -1)])
    found = np.stack([name[start[order] + k] for k in range(size)], axis=1)
    new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]).any(1)))
    return found[new], np.diff(np.append(new, len(found)))


def _place(ids: list[np.ndarray]) -> np.ndarray:
    """Place of a phrase's flag, from the ids of its words."""
    h = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ x.view(np.uint64))
    return h >> np.uint64(64 - FLAG_BITS)


def _flagged(flags: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    at = _place(ids)
    return (flags[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _flags(level: DataFrame, size: int) -> np.ndarray:
    """One bit for each frequent phrase, 16 MB at any size: what has no bit is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = _place([batch.column(k).to_numpy() for k in range(size)])
                word, where = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    rows = level.select(*[f"w{k}" for k in range(size)]).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2^21 rows at most
    flags = np.zeros(1 << FLAG_BITS - 6, np.uint64)
    flags[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return flags


def _counts(size: int) -> str:
    return ", ".join([*(f"w{k} long" for k in range(size)), "n long"])


def _named(known: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each shard with the ids of its frequent words, their lists' lengths and lists; and w0, w1, n of its pairs of them.

    known has shard, no and id of frequent words, files shard, lengths and lists.
    """
    schema = pa.schema([("w0", pa.int64()), ("w1", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("lists", pa.binary())])

    def join(mine: pa.Table, file: pa.Table) -> pa.Table:
        if not len(mine) or not len(file):
            return schema.empty_table()
        lengths = np.frombuffer(file.column("lengths")[0].as_py(), np.int32)
        number, at = unpacked(lengths, file.column("lists")[0].as_py())
        mine = mine.sort_by("id")
        of = np.full(len(lengths), -1, np.int32)
        of[mine.column("no").to_numpy()] = np.arange(len(mine))
        ids = mine.column("id").to_numpy()
        number = of[number]
        at, number = at[number >= 0], number[number >= 0]
        order = np.argsort(at, kind="stable")
        found, n = _adjacent(at[order], number[order], 2, None)
        pairs = [*(pa.array(ids[found[:, k]]) for k in range(2)), pa.array(n.astype(np.int64)), *[pa.nulls(len(n), pa.binary())] * 3]
        kept, lists = packed_lists(number, at, len(ids))
        one = [[None], [None], [None], [ids.astype(np.int64).tobytes()], [kept.astype(np.int32).tobytes()], [lists]]
        return pa.concat_tables([pa.Table.from_arrays(pairs, schema=schema), pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(one, schema, strict=True)], schema=schema)])

    files = files.select(F.col("shard").alias("place"), "lengths", "lists")
    return known.groupBy("shard").cogroup(files.groupBy("place")).applyInArrow(join, "w0 long, w1 long, n long, ids binary, lengths binary, lists binary")


def _extended(shards: DataFrame, size: int, flags: np.ndarray) -> DataFrame:
    """w0, w1, .., n: phrases of ``size`` words of each shard, made of two that may be frequent a position apart."""
    sent = shards.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, lists in zip(*(batch.column(c) for c in range(3)), strict=True):
                ids = np.frombuffer(ids.as_py(), np.int64)
                number, at = unpacked(np.frombuffer(lengths.as_py(), np.int32), lists.as_py())
                order = np.argsort(at, kind="stable")
                found, n = _adjacent(at[order], ids[number[order]], size, sent.value)
                yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(size)), pa.array(n.astype(np.int64))], names=[*(f"w{k}" for k in range(size)), "n"])

    return shards.select("ids", "lengths", "lists").mapInArrow(run, _counts(size))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times in a language, and n, the words of each language.

    id (among phrases of as many words), lang, phrase, words, f, first, second (ids of the phrase without its last and its first word), heads and tails
    (frequencies of its first 1, 2, .. and last .., 2, 1 words).  Occurrences are contiguous within pieces and may overlap.
    """
    inverted = written(_inverted(docs, text_col, lang_col), "inverted")
    spelled = inverted.where("no >= 0")
    total = written(spelled.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = spelled.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    none = F.lit(None).cast("long")
    level = counted.select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f", none.alias("first"), none.alias("second"), F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"))
    level = written(level, "level")
    known = spelled.select("shard", "no", "lang", F.col("word").alias("phrase")).join(level.select("lang", "phrase", "id"), ["lang", "phrase"]).select("shard", "no", "id")
    named = written(_named(known, inverted.where("no < 0").select("shard", "lengths", "lists")), "named")
    drop_written(inverted)
    columns = level.columns
    level, found = level.withColumn("w0", F.col("id")), level
    for size in range(2, longest + 1):
        words = [f"w{k}" for k in range(size)]
        grown = named.where("ids IS NULL") if size == 2 else _extended(named.where("ids IS NOT NULL"), size, _flags(level, size - 1))
        counted = written(grown.groupBy(*words).agg(F.sum("n").alias("f")).where(F.col("f") >= least), "counted")
        head = level.select(*[F.col(f"w{k}") for k in range(size - 1)], F.col("id").alias("first"), "lang", "phrase", F.col("f").alias("f1"), F.col("heads").alias("h"))
        tail = level.select(*[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(size - 1)], F.col("id").alias("second"), F.element_at(F.split("phrase", " "), -1).alias("last"), F.col("f").alias("f2"), F.col("tails").alias("t"))
        joined = counted.join(head, words[:-1]).join(tail, words[1:])
        longer = joined.select(F.monotonically_increasing_id().alias("id"), "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.lit(size).alias("words"), "f", "first", "second", F.concat("h", F.array("f1")).alias("heads"), F.concat(F.array("f2"), F.col("t")).alias("tails"), *words)
        level = written(longer, "level")
        drop_written(counted)
        found = found.unionByName(level.select(columns))
    drop_written(named)
    return found, total


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 3, least: int = 10, covered: int = 50, most: int = 2_000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first ``most`` phrases of 2 words or more.

    score is floor(1000000 a^2 / (l r)) for the cut with the lowest one (of equal ones the earliest), with a, l and r the frequencies of
    the phrase and of its two parts; whole numbers throughout (exact up to frequencies of 10^15).  A phrase goes if a longer one
    that holds it, gone or not, has at least ``covered`` percent of its frequency.  Higher scores come first, then higher
    frequencies, then phrases in the order of their bytes.  A null text is empty, a null language ``und``; a table
    without frequent phrases gives no rows.
    """
    found, total = phrases(docs, text_col, lang_col, longest=longest, least=least)
    wide = lambda c: c.cast("decimal(19,0)")
    # a phrase of one word more that holds it has it as its first or second part; still longer ones are no more frequent
    longer = found.where("words > 2").select(F.explode(F.array("first", "second")).alias("id"), (F.col("words") - 1).alias("words"), "f").groupBy("id", "words").agg(F.max("f").alias("longer"))
    cuts = F.transform(F.arrays_zip("heads", "tails"), lambda z: F.struct(z["heads"].alias("l"), z["tails"].alias("r")))
    many = found.where("words > 1").join(longer, ["id", "words"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    cut = many.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(cuts).alias("k", "c"))
    # the score is at most 1000000, as no part is rarer than the phrase
    scored = cut.select("lang", "phrase", "a", "k", F.col("c.l").alias("l"), F.col("c.r").alias("r")).withColumns({"_a": wide(F.col("a")), "_l": wide(F.col("l")), "_r": wide(F.col("r"))})
    scored = scored.withColumn("score", F.expr("CAST((1000000 * _a * _a) div (_l * _r) AS BIGINT)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = _first_of(lowest.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score")), most)
    # cut again in parts, so that a language's last task gets PARTS * most rows, however many tasks there were
    best = _first_of(best.repartition("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), most)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(total) if total.count() <= 100_000 else total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first_of(rows: DataFrame, most: int) -> DataFrame:
    """Rows that can be among the first ``most`` of their language: those that are so within their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def cut() -> pa.Table:
            table = pa.concat_tables(held)
            code = table.column("phrase").cast(pa.binary())
            ordered = table.append_column("_p", code).sort_by([("lang", "ascending"), ("score", "descending"), ("a", "descending"), ("_p", "ascending")]).drop_columns(["_p"])
            lang = ordered.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
            start = np.flatnonzero(np.append(True, lang[1:] != lang[:-1]))
            return ordered.filter(pa.array(np.arange(len(lang)) - np.repeat(start, np.diff(np.append(start, len(lang)))) < most))

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size > 50_000 + 4 * most:
                held = [cut()]
                size = min(len(held[0]), 4 * most)
        if held and sum(map(len, held)):
            yield from cut().to_batches()

    return rows.mapInArrow(run, rows.schema)
