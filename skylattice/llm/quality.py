"""Quality classifier by voting of nearest labelled latent-semantic vectors.

A text becomes three blocks of counts: its words, pairs of neighbouring byte classes, and word
shapes (first and last class, length, whether the word repeats the one before).
Each is weighted by sublinear TF-IDF and scaled to length one; joined, they are projected
on the leading singular vectors of a labelled sample.  The labelled vectors are
broadcast; they number at most ``max_examples``, so their size is fixed.  Each
slice of documents is multiplied with them block by block in double precision, and the ``k``
largest cosines (ties to the smaller example id) vote with weight cosine ** power.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample
from .textbytes import TextSlice, bounded_batches, list_array, map_texts, slices


def _byte_classes() -> tuple[np.ndarray, int]:
    """Letters a-z apart, A-Z together, digits together, ASCII marks apart, lead and inner UTF-8 bytes."""
    table = np.zeros(256, np.int32)
    names: dict[object, int] = {}
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            name: object = "lead"
        elif b >= 0x80:
            name = "inner"
        elif c.isupper():
            name = "upper"
        elif c.isdigit():
            name = "digit"
        elif b < 32 and b != 10:
            name = "control"
        else:
            name = c
        table[b] = names.setdefault(name, len(names))
    return table, len(names)


_CLASS, _CLASSES = _byte_classes()
_COARSE = np.full(256, 4, np.int32)
_COARSE[97:123] = 0
_COARSE[65:91] = 1
_COARSE[48:58] = 2
_COARSE[128:] = 3
_LENGTHS = 4
_PAIRS = _CLASSES * _CLASSES
_SHAPES = 5 * _CLASSES * _LENGTHS * 2
FEATURES = _PAIRS + _SHAPES


def counts(texts: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Two dense count blocks, a row for each text."""
    n = len(texts)
    data = texts.data
    owner = texts.text_of()
    kind = _CLASS[data]
    pairs = np.zeros(n * _PAIRS, np.int64)
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        at = owner[1:].astype(np.int64) * _PAIRS + kind[:-1] * _CLASSES + kind[1:]
        pairs = np.bincount(at[same], minlength=n * _PAIRS)
    starts, ends, first = texts.words()
    shapes = np.zeros(n * _SHAPES, np.int64)
    if len(starts):
        size = ends - starts
        bucket = np.minimum((size > 2).astype(np.int64) + (size > 6) + (size > 12), _LENGTHS - 1)
        hashes = texts.hashes(starts, ends)
        again = np.zeros(len(starts), np.int64)
        again[1:] = hashes[1:] == hashes[:-1]
        opening = first[:-1][first[:-1] < len(starts)]
        again[opening] = 0
        shape = ((_COARSE[data[starts]] * _CLASSES + kind[ends - 1]) * _LENGTHS + bucket) * 2 + again
        word_owner = np.repeat(np.arange(n), np.diff(first))
        shapes = np.bincount(word_owner * _SHAPES + shape, minlength=n * _SHAPES)
    return pairs.reshape(n, _PAIRS), shapes.reshape(n, _SHAPES)


def word_counts(texts: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, how often) of distinct words, ordered by text."""
    starts, ends, first = texts.words()
    h, owner = texts.hashes(starts, ends), np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _unit(block: np.ndarray) -> np.ndarray:
    norm = np.sqrt((block * block).sum(1, keepdims=True))
    return block / np.where(norm > 0, norm, 1)


def _fixed(pairs: np.ndarray, shapes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The two blocks of fixed features, weighted and each scaled to length one."""
    return np.concatenate([_unit(np.log1p(pairs) * weight[:_PAIRS]), _unit(np.log1p(shapes) * weight[_PAIRS:])], axis=1)


@dataclass
class LatentVoter:
    """A fitted classifier; examples stand in the order of their ids.  All arrays are bounded by what max_examples texts hold.

    ``weight`` and ``basis`` are those of the fixed features and then of the words in ``vocabulary`` (sorted hashes).
    """

    vocabulary: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    examples: np.ndarray
    labels: np.ndarray
    k: int
    power: float
    prior: float

    def latent(self, texts: TextSlice) -> np.ndarray:
        out = _fixed(*counts(texts), self.weight[:FEATURES]) @ self.basis[:FEATURES]
        row, word, often = word_counts(texts)
        if len(self.vocabulary) and len(row):
            at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == word
            row, column = row[known], FEATURES + at[known]
            value = np.log1p(often[known]) * self.weight[column]
            value /= np.sqrt(np.bincount(row, value * value, minlength=len(texts)))[row]
            for a in range(0, len(row), 1 << 14):
                np.add.at(out, row[a : a + (1 << 14)], value[a : a + (1 << 14), None] * self.basis[column[a : a + (1 << 14)]].astype(float))
        return _unit(out)

    def votes(self, vectors: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the largest cosine, of each row.  Cosines count to twelve digits, so equal examples tie."""
        n, k = len(vectors), min(self.k, len(self.labels))
        score, nearest = np.full(n, self.prior), np.zeros(n)
        if not k or not n:
            return score, nearest
        best, which = np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        for at in range(0, len(self.examples), block):
            cosine = np.round(vectors @ self.examples[at : at + block].T, 12)
            top = _largest(cosine, k)
            best = np.concatenate([best, np.take_along_axis(cosine, top, 1)], axis=1)
            which = np.concatenate([which, top + at], axis=1)
        top = np.argsort(-best, axis=1, kind="stable")[:, :k]
        cosine = np.clip(np.take_along_axis(best, top, 1), 0, 1)
        label = self.labels[np.take_along_axis(which, top, 1)]
        w = cosine**self.power
        total = w.sum(1)
        some = total > 0
        score[some] = (w * label).sum(1)[some] / total[some]
        nearest = cosine.max(1)
        return score, nearest


def _largest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest values in ascending order; of equal values the earlier columns."""
    if cosine.shape[1] <= k:
        return np.tile(np.arange(cosine.shape[1]), (len(cosine), 1))
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    floor = np.take_along_axis(cosine, top, 1).min(1)
    tied = np.flatnonzero((cosine >= floor[:, None]).sum(1) > k)
    if len(tied):
        top[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
    return np.sort(top, axis=1)


class _Rows:
    """A sparse matrix by row and by column; products are summed some entries at a time."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape, self.sides = shape, []
        for key, other in ((row, column), (column, row)):
            by = np.argsort(key, kind="stable")
            self.sides.append((key[by].astype(np.int32), other[by].astype(np.int32), value[by]))

    def _product(self, side: int, m: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        key, other, value = self.sides[side]
        out = np.zeros((self.shape[side], m.shape[1]), np.float32)
        for a in range(0, len(key), step):
            own = key[a : a + step]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[first]] += np.add.reduceat(value[a : a + step, None] * m[other[a : a + step]], first)
        return out

    def times(self, m: np.ndarray) -> np.ndarray:
        return self._product(0, m)

    def turned_times(self, m: np.ndarray) -> np.ndarray:
        return self._product(1, m)


def fit_voter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_examples: int = 3000, least_examples: int = 3, rank: int = 48, k: int = 9, power: float = 8.0) -> LatentVoter:
    """Fits on at most ``max_examples`` rows of ``labels`` (those with the smallest hashed id); only
    their ids and labels are broadcast, and only the sparse counts of their texts reach the driver.

    Words that at least ``least_examples`` of them hold enter the latent space.  Rows whose label or id
    is null are left out.  With no labelled row at all every text scores 0.5.
    """
    chosen = bounded_sample(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col), id_col, max_examples)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    packed = rows.select((F.col(id_col).cast("long") * 2 + F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("key"), text_col)

    def make() -> Callable:
        def run(ids: pa.Array, texts: TextSlice):
            both = np.concatenate(counts(texts), axis=1)
            row, column = np.nonzero(both)
            owner, word, often = word_counts(texts)
            n, m = np.bincount(row, minlength=len(texts)), np.bincount(owner, minlength=len(texts))
            return ids, list_array(column.astype(np.int32), n, pa.int32()), list_array(both[row, column].astype(np.int32), n, pa.int32()), list_array(word.view(np.int64), m, pa.int64()), list_array(often.astype(np.int32), m, pa.int32())

        return run

    found = map_texts(packed, "key", text_col, make, "key long, columns array<int>, counts array<int>, words array<long>, often array<int>").toArrow().combine_chunks()
    key = found["key"].to_numpy().astype(np.int64)
    if not len(key):
        return LatentVoter(np.zeros(0, np.uint64), np.ones(FEATURES), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1)), np.zeros(0), k, power, 0.5)
    order = np.argsort(key, kind="stable")
    place = np.empty(len(key), np.int32)
    place[order] = np.arange(len(key))
    labels = (key[order] & 1).astype(float)

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = found[name].combine_chunks()
        return np.repeat(place, lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)  # rows in the order of ids

    word_row, word = flat("words")
    vocabulary, inverse, held = np.unique(word.view(np.uint64), return_inverse=True, return_counts=True)
    fit = np.flatnonzero(held >= least_examples)
    to = np.full(len(vocabulary), -1, np.int32)
    to[fit] = FEATURES + np.arange(len(fit), dtype=np.int32)
    inverse = to[inverse]
    use = inverse >= 0
    vocabulary, word_row, word_column, word_often = vocabulary[fit], word_row[use], inverse[use], flat("often")[1][use]
    del word, inverse, use, held
    row, column = flat("columns")
    often = np.concatenate([flat("counts")[1], word_often])
    del found
    row, column = np.concatenate([row, word_row]), np.concatenate([column, word_column])
    del word_row, word_column, word_often
    width = FEATURES + len(fit)
    weight = np.log((1 + len(key)) / (1 + np.bincount(column, minlength=width))) + 1
    value = np.log1p(often) * weight[column]
    part = row * 3 + (column >= _PAIRS) + (column >= FEATURES)
    value = (value / np.sqrt(np.bincount(part, value * value, minlength=3 * len(key)))[part]).astype(np.float32)
    x = _Rows(row, column, value, (len(key), width))
    del row, column, often, value, part
    rank = min(rank, len(key), width)
    sketch = x.times(np.random.default_rng(7).standard_normal((width, min(rank + 12, len(key))), np.float32))
    for _ in range(3):
        sketch, _ = np.linalg.qr(x.times(x.turned_times(sketch)))
    # the leading singular vectors of the sketched rows, from their small matrix of products
    low = x.turned_times(sketch)
    size, turn = np.linalg.eigh((low.T @ low).astype(float))
    turn = turn[:, ::-1][:, :rank] / np.sqrt(np.maximum(size[::-1][:rank], 1e-12))
    basis = low @ turn.astype(np.float32)
    return LatentVoter(vocabulary, weight, basis, _unit(x.times(basis).astype(float)), labels, k, power, float(labels.mean()))


def score_quality(docs: DataFrame, voter: LatentVoter, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on), nearest cosine; empty and null texts are scored like any other.

    Repeated ids give repeated rows; columns other than the two named are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    def make() -> Callable:
        model = sent.value

        def run(ids: pa.Array, texts: TextSlice):
            score, nearest = model.votes(model.latent(texts))
            return ids, score, (score >= threshold).astype(np.int32), nearest

        return run

    return map_texts(docs, id_col, text_col, make, "doc_id long, score double, predicted int, nearest double")


def keep(docs: DataFrame, voter: LatentVoter, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least ``least``; null and empty texts are scored like any other.

    Repeated rows and ids stay or go each by their own text, ids may be null, and no column's name but
    ``text_col`` matters; an empty table stays one.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(voter)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            score = np.zeros(len(batch))
            for at, to, texts in slices(batch.column(place)):
                score[at:to] = model.votes(model.latent(texts))[0]
            yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
