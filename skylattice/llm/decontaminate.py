"""Benchmark decontamination by template windows.

A text becomes a sequence of canonical tokens: words without ASCII marks at their ends,
A-Z lower-cased; a token with a digit is a number, a known unit after a number a unit, a
capitalised word inside a sentence a name.  These three are typed placeholders (slots).  A capitalised
word that opens a sentence may be a name or not: its windows are made both ways.
Windows of ``width`` canonical tokens are hashed and joined with those of the benchmark
items.  Matches of a document and an item on one diagonal must fill the slots alike: each
value of the item stands for one value of the document and the other way round.  Windows with
too few tokens that are no slots, and items too short for a window, are looked for
literally: by the tokens without placeholders.  A document leaks an item if the diagonals that
do so cover ``coverage`` of its windows, or of those that are no literal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textbytes import SPACE, TextSlice, binary_rows, folded_ranges, map_texts, slices

# Units that may follow a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit mph kph kmh hz khz mhz ghz w kw watt watts v volt volts j joule joules"
)

_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x11D0A1B2C3D4E5F7, 0x22E0B1C2D3E4F507, 0x33F0C1D2E3F40517))
_LITERAL = np.uint64(0x44E0D1E2F3051627)
#: Up to so many distinct windows of the benchmark are broadcast (8 bytes each) to pick the documents' windows for the
#: join; for more a table of 2**FILTER_BITS flags (16 MB) is, which lets some others pass to the join.
BLOCK, FILTER_BITS = 1_000_000, 27
#: Up to so many ids are broadcast to remove documents; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _hashes_of(words: str) -> np.ndarray:
    column = pa.array([words])
    (_, _, texts) = next(slices(column))
    starts, ends, _ = texts.words()
    return np.sort(texts.hashes(starts, ends))


_UNIT_HASHES = _hashes_of(UNITS)


def canonical(texts: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token its canonical hash, its slot value (0: none), its literal hash, its text, and whether it may be a name that opens a sentence."""
    starts, ends, first = texts.words()
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    solid = np.flatnonzero(~_MARK[texts.data] & ~SPACE[texts.data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = high >= low
    low, high = solid[low[some]], solid[high[some]] + 1
    value = texts.hashes(low, high)
    # a sentence begins at a text, after a stop and on a new line
    stopped = np.append(True, _STOP[texts.data[ends - 1]][:-1]) if len(ends) else np.zeros(0, bool)
    lines = np.cumsum(texts.data == 10)
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])) if len(starts) else np.zeros(0, bool)
    inner = ~(stopped | fresh)[some]
    owner = owner[some]
    digits = np.append(0, np.cumsum((texts.data >= 48) & (texts.data < 58)))
    number = digits[high] > digits[low]
    lead, second = texts.data[low], np.append(texts.data, 0)[low + 1]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    lower_next = np.append(texts.data, 0)[np.minimum(low + 1 + (lead == 0xC3), len(texts.data))]
    name = capital & ~number & (high - low > 1) & ~((lower_next >= 65) & (lower_next <= 90))
    opener, name = name & ~inner, name & inner
    after_number = np.append(False, number[:-1] & (owner[1:] == owner[:-1])) if len(number) else number
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = after_number & (_UNIT_HASHES[at] == value)
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return token, np.where(number | unit | name, value, np.uint64(0)), value, owner, opener & ~unit


def windows(token: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (among all tokens) and hash of every window."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[width - 1 :] == owner[:n])
    return at, folded_ranges(token, at, at + width)


class Wanted:
    """The windows that are looked for: all hashes of each (width, literal), sorted, or one table of flags for all."""

    def __init__(self, kinds: list[tuple[int, bool]], hashes: dict[tuple[int, bool], np.ndarray] | None = None, flags: np.ndarray | None = None):
        self.kinds, self.hashes, self.flags = kinds, hashes, flags

    def holds(self, kind: tuple[int, bool], h: np.ndarray) -> np.ndarray:
        if self.hashes is None:
            at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            return (self.flags[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        known = self.hashes[kind]
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h

    @classmethod
    def of(cls, items: DataFrame) -> Wanted:
        found = items.select("width", "literal", "hash").distinct()
        kinds = sorted((r.width, r.literal) for r in found.select("width", "literal").distinct().collect())  # two for each width at most
        if found.count() > BLOCK:
            bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
            words = found.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 AS INT))")).alias("bits")).toArrow()
            flags = np.zeros(1 << FILTER_BITS - 6, np.uint64)
            flags[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
            return cls(kinds, flags=flags)
        rows = found.toArrow()
        widths, literal, hashes = rows["width"].to_numpy(), rows["literal"].to_numpy().astype(bool), rows["hash"].to_numpy().astype(np.int64)
        return cls(kinds, {k: np.sort(hashes[(widths == k[0]) & (literal == k[1])].view(np.uint64)) for k in kinds})


def _scan(docs: DataFrame, id_col: str, text_col: str, width: int, shortest: int, literals: int, wanted: Callable[[], Wanted | None]) -> DataFrame:
    """id, width, literal, tokens (of the text), place, hash, slots: the windows, or only those in wanted().

    A window with too few tokens that are no slots is a literal one, without slots; wanted() literal
    windows are looked for everywhere.  A window that holds a capitalised word that opens a sentence is
    there twice, with that word and with a slot for it.
    """
    most = width
    kinds = [(w, literal) for w in range(1, most + 1) for literal in (False, True) if literal or w >= shortest]

    def make() -> Callable:
        look = wanted()

        def run(ids: pa.Array, texts: TextSlice):
            token, slot, value, owner, opener = canonical(texts)
            n = np.bincount(owner, minlength=len(texts))
            opening = np.append(0, np.cumsum(n))
            forms = [(token, slot, None)]
            if opener.any():
                forms.append((np.where(opener, _NAME, token), np.where(opener, value, slot), np.append(0, np.cumsum(opener))))
            found = []
            for form, (token, slot, openers) in enumerate(forms):
                plain = np.append(0, np.cumsum(slot == 0))
                for width, literal in look.kinds if look is not None else kinds:
                    if form and literal:
                        continue
                    at, h = windows(value ^ _LITERAL if literal else token, owner, width)
                    few = plain[at + width] - plain[at] < (min(literals, width - width // 3) if width >= shortest else width + 1)
                    keep = ~few | literal if look is not None else few == literal
                    if form:
                        keep &= openers[at + width] > openers[at]
                    if look is not None:
                        keep &= look.holds((width, literal), h)
                    elif width < most:  # a shorter window only where it is the whole item
                        keep &= n[owner[at]] == width
                    at, h = at[keep], h[keep]
                    if len(at):
                        values = np.zeros((len(at), most), np.uint64)
                        if not literal:
                            values[:, :width] = slot[at[:, None] + np.arange(width)]
                        found.append((owner[at], np.full(len(at), width), np.full(len(at), literal), n[owner[at]], at - opening[owner[at]], h, values))
            if not found:
                return None
            owner_, width_, literal_, n_, at_, h_, values_ = (np.concatenate(x) for x in zip(*found, strict=True))
            return ids.take(pa.array(owner_)), width_.astype(np.int32), literal_, n_.astype(np.int32), at_.astype(np.int32), h_.view(np.int64), binary_rows(values_)

        return run

    return map_texts(docs, id_col, text_col, make, "id long, width int, literal boolean, tokens int, place int, hash long, slots binary")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, width: int = 8, shortest: int = 4, literals: int = 4, coverage: float = 0.4) -> DataFrame:
    """doc_id, item_id, matched and windows (of the item), coverage, first_token, last_token, slots_differ.

    One row for each pair whose consistent matches cover at least ``coverage`` of the item's windows, or
    of those that are no literal ones (the larger share is given).  Items of less than ``width`` tokens have
    one window, the whole item.  Items of fewer than ``shortest`` tokens, and windows with fewer than
    ``literals`` tokens that are no slots, are found literally only; texts without a token never.  A null
    id is left out.  Rows that share an id count as one document; empty tables give no rows.  slots_differ tells re-parameterised
    copies from literal ones.
    """
    spark = docs.sparkSession
    items = written(_scan(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text, width, shortest, literals, lambda: None), "items")
    wanted = Wanted.of(items)
    if wanted.kinds:
        sent = spark.sparkContext.broadcast(wanted)
        hits = _scan(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, shortest, literals, lambda: sent.value)
    else:
        hits = items.limit(0)
    size = items.groupBy("id").agg(F.countDistinct("place").alias("all_windows"), F.countDistinct(F.when(~F.col("literal"), F.col("place"))).alias("typed_windows")).withColumnRenamed("id", "item_id")
    side = items.select(F.col("id").alias("item_id"), "hash", "width", "literal", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    pairs = written(hits.join(side, ["hash", "width", "literal"]).select("id", "item_id", "literal", "place", "item_place", "width", "slots", "item_slots", (F.col("place") - F.col("item_place")).alias("diagonal")), "matches")
    clash = _clashes(pairs)
    good = pairs.join(clash, ["id", "item_id", "diagonal"], "left").where("bad IS NULL OR slots = item_slots")
    each = good.groupBy("id", "item_id").agg(F.countDistinct("item_place").alias("all_matched"), F.countDistinct(F.when(~F.col("literal"), F.col("item_place"))).alias("typed_matched"), F.min("place").alias("first_token"), F.max(F.col("place") + F.col("width") - 1).alias("last_token"), F.max(F.col("slots") != F.col("item_slots")).alias("slots_differ"))
    both = each.join(size, "item_id").withColumns({"all": F.col("all_matched") / F.col("all_windows"), "typed": F.try_divide("typed_matched", "typed_windows")})
    more = F.coalesce(F.col("typed") >= F.col("all"), F.lit(False))
    chosen = {to: F.when(more, F.col(f"typed{of}")).otherwise(F.col(f"all{of}")) for to, of in (("matched", "_matched"), ("windows", "_windows"), ("coverage", ""))}
    share = both.withColumns(chosen).where(F.col("coverage") >= coverage)
    return share.select(F.col("id").alias("doc_id"), "item_id", "matched", "windows", "coverage", "first_token", "last_token", "slots_differ")


def _clashes(pairs: DataFrame) -> DataFrame:
    """id, item_id, diagonal, bad: diagonals on which one value of a slot stands for two of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(len(batch), -1) for c in (3, 4))
            row, place = np.nonzero((x != 0) | (y != 0))
            if len(row):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(x[row, place]), pa.array(y[row, place])], names=["id", "item_id", "diagonal", "mine", "theirs"])

    key = ["id", "item_id", "diagonal"]
    values = pairs.where("slots != item_slots").select(*key).distinct().join(pairs, key).select(*key, "slots", "item_slots")
    filled = values.mapInArrow(run, "id long, item_id long, diagonal int, mine long, theirs long").distinct()
    many = filled.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("mine").alias("m"), F.countDistinct("theirs").alias("t"))
    return many.where("n > m OR n > t").select(*key, F.lit(True).alias("bad"))


def remove_leaking(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that leak an item; rows with a null id stay."""
    ids = written(found.select(F.col("doc_id").alias("_leak")).distinct(), "leaking")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].cast("long") == F.col("_leak"), "left_anti")
