"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its bytes and an end mark.  Each symbol is a path of binary decisions in a
Huffman tree that the byte before it selects, so likely symbols take few decisions.
What the byte before tells is in the tree.  Predictors give the probability of each decision from
counts over all training texts in one hashed context: two bytes, four bytes, and the letters of
the word so far.  Their stretched probabilities are mixed by one of four sets of weights, chosen
by which of the two longest contexts are sure; the mix is refined by a correction that depends on
its own size.  Weights and correction learn online after every block of symbols (``blocks``), from
fixed values at the start of a text to its end.

The longest context is a whole line.  The number of times that each line of the training texts
occurs in all of them is an exact table that grows with the corpus.  A line's probability is
(1 - share) times that of its decisions plus share times c / L: c of all L training lines are alike,
and ``share`` of the training lines occur more than once.  A training text does not count its own
lines, so that it is scored by what other texts hold.  The sum of the lines' logarithms is the log
probability of the text.

Beside it stands the exact add-one unigram model over words.  Its counts grow with the
corpus; the most frequent words and lines (a fixed number) are broadcast, all others are joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textbytes import LOWER, SPACE, TextSlice, bounded_batches, folded_bytes, list_array, map_texts, mix, powers, slices

END = 256
SYMBOLS = 257
#: log2 of the number of slots of each hashed predictor (two bytes, four bytes, word so far), and of those in a line: a
#: context's decisions fall in one line, so that they are close to each other in memory.
SLOT_BITS, LINE_BITS = (21, 22, 22), (6, 5, 5)
#: Bytes that are hashed together, and bytes of texts that are scored side by side.
BATCH_BYTES, HELD_BYTES = 1 << 19, 1 << 23
#: Counts travel in pieces of so many slots; first so many tasks' pieces are added, then the sums.
PIECE_BITS, TOGETHER = 16, 64
#: So many of the most frequent words and of the most frequent lines are broadcast (16 bytes each).
HEAD_WORDS, HEAD_LINES = 400_000, 100_000
#: A text's first weights of the three predictors and the bias (the same in all four sets), and the rates of learning.
START = np.array([0.15, 0.5, 0.3, 0.0], np.float32)
GATES, CELLS = 4, 8
RATE, REFINE = np.float32(0.02), np.float32(0.02)

_ORDER1 = SYMBOLS * SYMBOLS
#: Place of each node in a line.
_PLACE = [((np.arange(SYMBOLS, dtype=np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) >> np.uint32(32 - b)).astype(np.int32) for b in LINE_BITS]
_SPREAD, _FOLD = np.uint32(0x85EBCA6B), np.uint64(0x9E3779B97F4A7C15)


_APART = np.append(SPACE, True)
_LETTER = np.append(mix(LOWER.astype(np.uint64) + np.uint64(77)), np.uint64(0))

# ---- binary decisions


@dataclass
class Code:
    """Paths of every symbol after every byte: ``size`` and ``start`` into ``node`` and ``bit``."""

    size: np.ndarray
    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def build(cls, pair_counts: np.ndarray) -> Code:
        """From counts of (byte before, symbol); every symbol gets a path after every byte."""
        size, nodes, bits = np.zeros(_ORDER1, np.int64), [], []
        start = np.zeros(_ORDER1, np.int64)
        at = 0
        overall = pair_counts.sum(0) + 1.0
        for before in range(SYMBOLS):
            weight = pair_counts[before] + overall / overall.sum()
            heap = [(float(w), s) for s, w in enumerate(weight)]
            heapq.heapify(heap)
            child: list[tuple[int, int]] = []
            while len(heap) > 1:
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (a + b, SYMBOLS + len(child)))
                child.append((x, y))
            todo = [(SYMBOLS + len(child) - 1, (), ())]
            while todo:
                x, path, turns = todo.pop()
                if x < SYMBOLS:
                    k = before * SYMBOLS + x
                    size[k], start[k] = len(path), at
                    at += len(path)
                    nodes += path
                    bits += turns
                else:
                    inner = x - SYMBOLS
                    for turn, y in enumerate(child[inner]):
                        todo.append((y, (*path, inner), (*turns, turn)))
        return cls(size, start, np.array(nodes, np.uint16), np.array(bits, np.uint8))


def symbols_of(texts: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols (bytes, and an end mark for each text), the place of each text's first one, and each one's text."""
    n = len(texts)
    size = np.diff(texts.offsets) + 1
    first = np.append(0, np.cumsum(size))
    owner = np.repeat(np.arange(n), size)
    symbol = np.full(first[-1], END, np.int64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    symbol[inside] = texts.data
    return symbol, first, owner


def previous(symbol: np.ndarray, first: np.ndarray, back: int) -> np.ndarray:
    """The symbol ``back`` places before each; before the start of a text the end mark."""
    out = np.full(len(symbol), END, np.int64)
    out[back:] = symbol[:-back] if back else symbol
    for i in range(back):
        at = first[:-1] + i
        out[at[at < first[1:]]] = END
    return out


def contexts(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The byte before each symbol and its three context hashes."""
    one = previous(symbol, first, 1)
    near = one | previous(symbol, first, 2) << 9
    two = near.astype(np.uint32)
    near |= previous(symbol, first, 3) << 18
    near |= previous(symbol, first, 4) << 27
    n = len(symbol)
    apart = _APART[symbol]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[symbol] * up[:n], out=sums[1:])
    opens = np.zeros(n, np.int64)
    opens[1:][apart[:-1]] = np.flatnonzero(apart[:-1]) + 1
    opens = np.maximum.accumulate(opens)
    word = sums[:-1] - sums[opens]
    word *= down[opens]
    word += (np.arange(3, n + 3) - opens).astype(np.uint64)
    return one, [two, *((h * _FOLD >> np.uint64(32)).astype(np.uint32) for h in (near.view(np.uint64), word))]


def lines_of(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every line, and its text; a line ends with its line feed or the end mark, which are alike."""
    closes = np.flatnonzero((symbol == 10) | (symbol == END))
    starts = np.append(0, closes[:-1] + 1)
    h = folded_bytes(symbol.astype(np.uint8), starts, closes)
    return starts, h, np.searchsorted(first, starts, "right") - 1


def decisions(code: Code, symbol: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every decision its symbol's place, its node and its outcome, in order."""
    key = one * SYMBOLS + symbol
    size = code.size[key]
    of = np.repeat(np.arange(len(symbol), dtype=np.int32), size)
    total = np.cumsum(size)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(code.start[key] - (total - size), size)
    return of, code.node[at], code.bit[at]


def lines(context: np.ndarray, k: int) -> np.ndarray:
    """First slot of the line of each context hash in the k-th table."""
    at = context * _SPREAD
    at ^= at >> np.uint32(15)
    at *= _SPREAD
    at >>= np.uint32(32 - SLOT_BITS[k] + LINE_BITS[k])
    at <<= np.uint32(LINE_BITS[k])
    return at.view(np.int32)


def slots(line: np.ndarray, of: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Slot of every decision: its symbol's line and the place of its node there."""
    at = line.take(of)
    at += _PLACE[k].take(node)
    return at


# ---- what is gathered from the training texts


def _gather(train: DataFrame) -> DataFrame:
    """kind, word, c: exact counts of words (kind 0) and lines (2) by hash, and of pairs of bytes (1)."""
    bounded_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_ORDER1, np.int64)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 2: []}
        size = dict.fromkeys(held, 0)

        def emit(kind: int, word: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), kind, np.int32)), pa.array(word.astype(np.uint64).view(np.int64)), pa.array(c.astype(np.int64))], names=["kind", "word", "c"])

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            word, inverse = np.unique(np.concatenate([h[0] for h in held[kind]]), return_inverse=True)
            return word, np.bincount(inverse, np.concatenate([h[1] for h in held[kind]]))

        for batch in batches:
            for _, _, texts in slices(batch.column(1)):
                symbol, first, _ = symbols_of(texts)
                pairs += np.bincount(previous(symbol, first, 1) * SYMBOLS + symbol, minlength=_ORDER1)
                starts, ends, _ = texts.words()
                for kind, h in ((0, texts.hashes(starts, ends)), (2, lines_of(symbol, first)[1])):
                    held[kind].append(np.unique(h, return_counts=True))
                    size[kind] += len(held[kind][-1][0])
                    if size[kind] > 1_500_000:
                        held[kind] = [merged(kind)]
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > 1_000_000:
                            yield emit(kind, *held[kind].pop())
                            size[kind] = 0
        for kind in held:
            if held[kind]:
                yield emit(kind, *merged(kind))
        some = np.flatnonzero(pairs)
        yield emit(1, some, pairs[some])

    return written(train.select("id", "text").mapInArrow(run, "kind int, word long, c long").groupBy("kind", "word").agg(F.sum("c").alias("c")), "words")


def stretched(counts: np.ndarray) -> np.ndarray:
    """ln(p / (1 - p)) times 2048 of pairs of counts (of 0, of 1), drawn to 0 where they are few."""
    n0, n1 = counts[0::2].astype(float), counts[1::2].astype(float)
    value = np.log((n1 + 0.15) / (n0 + 0.15)) * (n0 + n1 + 0.1) / (n0 + n1 + 0.6)
    return np.clip(value * 2048, -32767, 32767).astype(np.int16)


def _gather_decisions(train: DataFrame, code: Code) -> list[np.ndarray]:
    """Stretched probabilities of every slot of the hashed predictors; counts cover all training texts."""
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(code)
    sizes = [1 << b for b in SLOT_BITS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = sent.value, zstandard.ZstdCompressor(level=1)
        tables = [np.zeros(2 * n, np.int32) for n in sizes]
        for batch in batches:
            for _, _, texts in slices(batch.column(1)):
                symbol, first, _ = symbols_of(texts)
                one, hashed = contexts(symbol, first)
                of, node, bit = decisions(code, symbol, one)
                for k, table in enumerate(tables):
                    at = slots(lines(hashed[k], k), of, node, k)
                    at *= 2
                    at += bit
                    np.add.at(table, at, np.int32(1))
        step, group = 2 << PIECE_BITS, TaskContext.get().partitionId() // TOGETHER
        for k, table in enumerate(tables):
            for piece, at in enumerate(range(0, len(table), step)):
                part = table[at : at + step]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k << 20 | piece], pa.int32()), pa.array([group], pa.int32()), pa.array([packer.compress(part.astype(np.int64).tobytes())], pa.binary())], names=["piece", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        packer, unpacker, sums = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for piece, group, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, counts = (piece, 0 if last else group), np.frombuffer(unpacker.decompress(packed), np.int64)
                sums[key] = sums[key] + counts if key in sums else counts
        for (piece, group), total in sums.items():
            data = stretched(total).tobytes() if last else packer.compress(total.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([group], pa.int32()), pa.array([data], pa.binary())], names=["piece", "part", "counts"])

    schema = "piece int, part int, counts binary"
    counted = train.select("id", "text").mapInArrow(count, schema)
    summed = counted.repartition("piece", "part").mapInArrow(lambda batches: add(batches, False), schema)
    tables = [np.zeros(n, np.int16) for n in sizes]
    for row in summed.repartition("piece").mapInArrow(lambda batches: add(batches, True), schema).toLocalIterator():  # the tables have a fixed size, 18 MB together
        at = (row.piece & 0xFFFFF) << PIECE_BITS
        values = np.frombuffer(row["counts"], np.int16)
        tables[row.piece >> 20][at : at + len(values)] = values
    return tables


# ---- scoring


def blocks(longest: int) -> list[int]:
    """Bounds of the blocks of symbols after which weights learn: shorter ones while a text has taught little."""
    return [0, *(x for x in (*range(16, 513, 16), *range(576, 4097, 64), *range(4352, longest + 256, 256)) if x < longest), longest]


def log_probabilities(code: Code, tables: list[np.ndarray], parts: list[TextSlice]) -> np.ndarray:
    """log10 of every symbol's probability, over all parts.

    Texts are lanes side by side, the longest first; in a round each goes on by a block, with the weights it has.
    """
    held = []
    for texts in parts:
        symbol, first, _ = symbols_of(texts)
        held.append((symbol.astype(np.uint16), *(lines(h, k) for k, h in enumerate(contexts(symbol, first)[1])), np.diff(first)))
    symbol, *hashed, size = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    order = np.argsort(-size, kind="stable")
    n = len(size)
    start, size = (np.cumsum(size) - size)[order], size[order]
    weights, fixes = np.repeat(START[:, None], n * GATES, axis=1), np.zeros(n * CELLS, np.float32)
    out = np.empty(len(symbol), np.float32)
    bounds = blocks(int(size[0]) if n else 0)
    for low, high in zip(bounds, bounds[1:], strict=False):
        a = int(np.searchsorted(-size, -low))  # texts with symbols left
        each = np.minimum(size[:a], high) - low
        ends = np.cumsum(each)
        at = np.arange(ends[-1]) + np.repeat(start[:a] + low - (ends - each), each)
        one = symbol[at - 1].astype(np.int64)
        if not low:
            one[ends - each] = END
        out[at] = advance(code, tables, symbol[at].astype(np.int64), one, [h[at] for h in hashed], each, weights[:, : a * GATES], fixes[: a * CELLS])
    return out


def advance(code: Code, tables: list[np.ndarray], symbol: np.ndarray, one: np.ndarray, hashed: list[np.ndarray], each: np.ndarray, weights: np.ndarray, fixes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each symbol of the lanes (``each`` has how many); weights and fixes learn from them.

    ``hashed`` are the symbols' lines in the hashed tables.
    """
    of, node, bit = decisions(code, symbol, one)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    lane = np.repeat(np.arange(len(each), dtype=np.int32), each).take(of)
    x = [tables[k].take(slots(line, of, node, k)) * np.float32(1 / 2048) for k, line in enumerate(hashed)]
    row = lane * np.int32(GATES)
    row += np.abs(x[1]) > 1
    row += np.int32(2) * (np.abs(x[2]) > 1)
    s = weights[-1].take(row) * np.float32(0.3)
    for w, v in zip(weights, x, strict=False):
        s += w.take(row) * v
    cell = s + np.float32(CELLS / 2)
    np.clip(cell, 0, CELLS - 1, out=cell)
    cell = cell.astype(np.int32)
    cell += lane * np.int32(CELLS)
    s += fixes.take(cell)
    np.negative(s, out=s)
    np.exp(s, out=s)
    s += 1
    error = bit - 1 / s
    seen = RATE / np.sqrt(1 + np.bincount(row, minlength=weights.shape[1]) / 16)
    for w, v in zip(weights, x, strict=False):
        v *= error
        w += np.bincount(row, v, minlength=len(w)) * seen
    weights[-1] += np.bincount(row, error, minlength=weights.shape[1]) * (seen * np.float32(0.3))
    fixes += np.bincount(cell, error, minlength=len(fixes)) * (REFINE / np.sqrt(1 + np.bincount(cell, minlength=len(fixes)) / 16))
    np.abs(error, out=error)
    return np.add.reduceat(np.log10(np.clip(1 - error, 1e-5, 1 - 1e-5)), first)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, np.ndarray, TextSlice]]]:
    """ids, training flags and texts of slices, about ``HELD_BYTES`` at a time."""
    held, size = [], 0
    for batch in batches:
        train = batch.column(2).to_numpy(zero_copy_only=False)
        for at, to, part in slices(batch.column(1), BATCH_BYTES):
            held.append((batch.column(0).slice(at, to - at), train[at:to], part))
            size += len(part.data)
            if size >= HELD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _grouped(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by owner and key, and in that order the size of each one's group."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(key)))
    return order, np.repeat(size, size)


@dataclass
class Head:
    """Counts of the most frequent words or lines, by ascending hash; a fixed number at most."""

    key: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, most: int) -> Head:
        head = counts.orderBy(F.desc("c"), "word").limit(most).toArrow()
        key = head["word"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        return cls(key[order], head["c"].to_numpy()[order].astype(np.int64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 if it is not here."""
        if not len(self.key):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, self.c[at], 0)


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte.

    ``training`` tells which rows of docs are learned from.  A null text is empty; it has the end token
    alone.  Repeated ids give repeated rows; columns other than the two named are not read, except by
    ``training``.  With no training rows nothing is known and every text is scored by the starting values.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    train = texts.where("train")
    gathered = _gather(train)
    words, pairs, lines = (gathered.where(F.col("kind") == k).select("word", "c") for k in range(3))
    table = pairs.toArrow()  # 257 * 257 rows at most
    counts = np.zeros(_ORDER1)
    counts[table["word"].to_numpy()] = table["c"].to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS)
    ends = int(counts[:, END].sum())
    totals = {r.kind: r for r in gathered.where("kind != 1").groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("again")).collect()}
    total, distinct = (totals[0].c, totals[0].n) if 0 in totals else (0, 0)
    n_lines, again = (totals[2].c, totals[2].again) if 2 in totals else (0, 0)
    n_train, vocabulary = total + ends, distinct + (ends > 0)
    share = again / (n_lines + 1)
    code = Code.build(counts)
    sent = spark.sparkContext.broadcast((code, _gather_decisions(train, code), Head.of(words, HEAD_WORDS), Head.of(lines.where("c > 1"), HEAD_LINES)))
    end_log, lone = float(np.log10(ends + 1)), float(np.log10(1 - share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, head_words, head_lines = sent.value
        row = TaskContext.get().partitionId() << 33
        for held in _held(batches):
            logs = log_probabilities(code, tables, [part for *_, part in held])
            done = 0
            for ids, trained, part in held:
                n = len(part)
                symbol, opens, _ = symbols_of(part)
                at, line, line_owner = lines_of(symbol, opens)
                value = np.add.reduceat(logs[done : done + len(symbol)].astype(float), at)
                done += len(symbol)
                order, own = _grouped(line, line_owner)
                line, line_owner, value = line[order], line_owner[order], value[order]
                own = np.where(trained[line_owner], own, 0)
                score = np.bincount(line_owner, value + lone, minlength=n)
                c = head_lines.find(line)
                seen = c - own > 0
                score += np.bincount(line_owner[seen], np.log10((1 - share) * 10.0 ** value[seen] + share * (c - own)[seen] / max(n_lines, 1)) - value[seen] - lone, minlength=n)
                starts, ends, first = part.words()
                h = part.hashes(starts, ends)
                owner = np.repeat(np.arange(n), np.diff(first))
                often = head_words.find(h)
                known = often > 0
                base = np.bincount(owner[known], np.log10(often[known] + 1.0), minlength=n) + end_log
                rest, rest_owner = h[~known], owner[~known]
                order, size = _grouped(rest, rest_owner)
                rest, rest_owner = rest[order], rest_owner[order]
                one = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (rest_owner[1:] != rest_owner[:-1]))) if len(rest) else np.zeros(0, np.int64)
                # what is not in the broadcast heads: words with how often, lines with their logarithm
                left = np.flatnonzero((c == 0) & (share > 0))
                all_owner = np.append(rest_owner[one], line_owner[left])
                by = np.argsort(all_owner, kind="stable")
                each = np.bincount(all_owner, minlength=n)
                columns = (
                    (np.append(np.zeros(len(one), np.int32), np.full(len(left), 2, np.int32)), pa.int32()),
                    (np.append(rest[one], line[left]).view(np.int64), pa.int64()),
                    (np.append(size[one].astype(float), value[left]), pa.float64()),
                    (np.append(np.zeros(len(one), np.int32), own[left].astype(np.int32)), pa.int32()),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        ids,
                        pa.array(np.diff(first) + 1),
                        pa.array(np.bincount(owner[known], minlength=n) + (end_log > 0)),
                        pa.array(base),
                        pa.array(score),
                        pa.array(np.diff(part.offsets)),
                        *(list_array(x[by], each, kind) for x, kind in columns),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "bytes", "kind", "word", "value", "own"],
                )
                row += n

    scored = written(texts.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, bytes long, kind array<int>, word array<long>, value array<double>, own array<int>"), "scored")
    tail = scored.where(F.size("word") > 0).select("row", F.explode(F.arrays_zip("kind", "word", "value", "own")).alias("t")).select("row", "t.*")
    is_word, others = F.col("kind") == 0, F.col("c") - F.col("own")
    gain = F.log10((1 - share) * F.pow(F.lit(10.0), "value") + share * others / max(n_lines, 1)) - F.col("value") - lone
    more = tail.join(gathered, ["kind", "word"]).groupBy("row").agg(
        F.sum(F.when(is_word, F.col("value") * F.log10(F.col("c") + 1))).alias("more"),
        F.sum(F.when(is_word, F.col("value"))).cast("long").alias("found"),
        F.sum(F.when(~is_word & (others > 0), gain)).alias("gain"),
    )
    whole = scored.drop("kind", "word", "value", "own").join(more, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n_train + vocabulary + 1))
    score = F.col("score") + F.coalesce("gain", F.lit(0.0))
    bits = F.when(F.col("bytes") > 0, -score / float(np.log10(2)) / F.col("bytes"))
    return whole.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), "bytes", bits.alias("bits_per_byte"))
