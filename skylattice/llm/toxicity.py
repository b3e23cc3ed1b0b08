"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fitting is bounded by ``max_examples`` labelled rows; every term of theirs is indexed.  A
term's weight is (1 + ln tf) * ln(n / df), times ``floor`` plus its correlation with the label,
so that words that tell the labels apart lead to the neighbours; no term is cut.  The unit
vectors lie in an inverted index whose postings are cut into blocks of examples, with each
term's largest weight in each block.  A query sums those maxima into an upper bound for each
block, visits blocks from the largest bound down and stops once no block left can reach the
k-th cosine: the result is exact.  Many queries of a slice go through the index side by side.
Votes weighted by inverse distance are mapped to probabilities by a monotone fit to
the examples' own leave-one-out votes.  A text without any known term has no
direction; it gets the smoothed label rate of such examples.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample
from .textbytes import SPACE, TextSlice, list_array, map_texts, mix

#: ASCII marks and spaces stand between terms.
_MARK = SPACE.copy()
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Queries that go through the index side by side.
TOGETHER = 64


def term_counts(texts: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, how often) of distinct terms, ordered by text.

    A term is a run of bytes that are neither space nor ASCII mark; A-Z are lower-cased.
    """
    n = len(texts.data)
    part = ~_MARK[texts.data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = part[:-1], part[1:]
    opening, last = texts.offsets[:-1], texts.offsets[1:] - 1
    before[opening[opening < n]] = False
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1
    h, owner = texts.hashes(starts, ends), np.searchsorted(texts.offsets, starts, "right") - 1
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and each one's range."""
    size = end - start
    total = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(total[-1] if len(total) else 0) + (start - total + size)[of], of


@dataclass
class BlockMaxIndex:
    """Postings by block of ``width`` examples and term; terms that a large share of the examples hold are dense rows.

    ``column`` has each term's row in ``dense`` (-1: none), whose columns are the places.
    ``block`` has the block of every cell with postings (by block and term), ``start`` where its postings
    begin; ``listed`` are the cells of each term (from ``opens``), ``peak`` the largest weight of each cell.
    """

    ids: np.ndarray
    rows: np.ndarray
    terms: int
    width: int
    block: np.ndarray
    start: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    opens: np.ndarray
    listed: np.ndarray
    peak: np.ndarray
    column: np.ndarray
    dense: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, width: int = 256, common: float = 1 / 16) -> BlockMaxIndex:
        """Examples are put next to those with the same heaviest term, so that blocks hold what is alike."""
        lead = np.zeros(len(ids), np.int64)
        by = np.argsort(weight, kind="stable")
        lead[row[by]] = term[by]
        place = np.lexsort((ids, lead))
        to = np.empty(len(ids), np.int64)
        to[place] = np.arange(len(ids))
        entry = to[row]
        held = np.bincount(term, minlength=terms)
        often = np.flatnonzero((held > 0) & (held >= common * len(ids)))
        column = np.full(terms, -1, np.int32)
        column[often] = np.arange(len(often))
        dense = np.zeros((len(often), -(-len(ids) // width) * width))
        thick = column[term] >= 0
        dense[column[term[thick]], entry[thick]] = weight[thick]
        term, entry, weight = term[~thick], entry[~thick], weight[~thick]
        key = entry // width * terms + term
        order = np.argsort(key, kind="stable")
        key, entry, weight = key[order], entry[order].astype(np.int32), weight[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        cell = key[first]
        peak = np.maximum.reduceat(weight, first) if len(key) else np.zeros(0)
        of = cell % max(terms, 1)
        listed = np.argsort(of, kind="stable")
        opens = np.searchsorted(of[listed], np.arange(terms + 1))
        return cls(ids[place], place, terms, width, (cell // max(terms, 1)).astype(np.int32), np.append(first, len(key)).astype(np.int32), entry, weight, opens.astype(np.int32), listed.astype(np.int32), peak, column, dense)

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, cosine) of the k nearest of each of n queries, nearest first; ties to the smaller id.

        Rows ascend; ``skip`` has an id for each query that is left out.  Places are those of ``ids``.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, n, TOGETHER):
            b = min(a + TOGETHER, n)
            low, high = np.searchsorted(row, (a, b))
            if high > low:
                q, place, cosine = self._together(row[low:high] - a, term[low:high], weight[low:high], b - a, k, None if skip is None else skip[a:b])
                found.append((q + a, place, cosine))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _together(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = -(-len(self.ids) // self.width)
        column = self.column[term]
        thick = column >= 0
        asked = np.zeros((n, len(self.dense)))
        asked[row[thick], column[thick]] = weight[thick]
        part = asked @ self.dense
        if skip is not None:
            own = self.ids[None] == skip[:, None]
            part[:, : len(self.ids)][own] = 0
        part = part.reshape(n, blocks, self.width)
        row, term, weight = row[~thick], term[~thick], weight[~thick]
        at, of = spread(self.opens[term], self.opens[term + 1])
        cell = self.listed[at]
        pair = row[of] * blocks + self.block[cell]
        bound = np.bincount(pair, weight[of] * self.peak[cell], minlength=n * blocks).reshape(n, blocks) + part.max(2)
        turns = np.argsort(-bound, axis=1, kind="stable")
        turn_of = np.empty((n, blocks), np.uint16 if blocks < 1 << 16 else np.int64)
        np.put_along_axis(turn_of, turns, np.arange(blocks)[None], 1)
        turn_of = turn_of.ravel()[pair]
        order = np.argsort(turn_of, kind="stable")
        cut = np.append(0, np.cumsum(np.bincount(turn_of, minlength=blocks)))
        of, cell = of[order], cell[order]
        top, floor = np.zeros((n, k)), np.zeros(n)
        found, live = [], np.arange(n)
        for turn in range(blocks):
            b = turns[live, turn]
            go = (bound[live, b] > 0) & (bound[live, b] >= floor[live] - 1e-9)
            live, b = live[go], b[go]
            if not len(live):
                break
            slot_of = np.full(n, -1, np.int32)
            slot_of[live] = np.arange(len(live)) * self.width - b * self.width
            own, at = of[cut[turn] : cut[turn + 1]], cell[cut[turn] : cut[turn + 1]]
            alive = np.zeros(n, bool)
            alive[live] = True
            keep = alive[row[own]]
            own, at = own[keep], at[keep]
            start, size = self.start[at], self.start[at + 1] - self.start[at]
            total = np.cumsum(size, dtype=np.int32)
            posting = np.repeat(start + size - total, size)
            posting += np.arange(len(posting), dtype=np.int32)
            slot = np.repeat(slot_of[row[own]], size)
            slot += self.entry[posting]
            gain = np.repeat(weight[own], size)
            gain *= self.weight[posting]
            cosine = np.bincount(slot, gain, minlength=len(live) * self.width).reshape(len(live), self.width)
            cosine = np.round(cosine + part[live, b], 12)
            if skip is not None:
                place = np.minimum(b[:, None] * self.width + np.arange(self.width), len(self.ids) - 1)
                cosine[self.ids[place] == skip[live, None]] = 0
            q, e = np.nonzero((cosine > 0) & (cosine >= floor[live, None]))
            found.append((live[q], b[q] * self.width + e, cosine[q, e]))
            best = np.concatenate([top[live], cosine], axis=1)
            top[live] = -np.partition(-best, k - 1, axis=1)[:, :k]
            floor[live] = top[live].min(1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, place, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.ids[place], -cosine, q))
        q, place, cosine = q[order], place[order], cosine[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], place[keep], np.minimum(cosine[keep], 1.0)


@dataclass
class ToxicVoter:
    """A fitted scorer; everything in it is bounded by what max_examples texts hold.

    ``row`` (ascending), ``term`` and ``often`` are the examples' term counts, from which the index is built wherever the
    voter arrives; ``ids`` and ``labels`` go by row.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    term: np.ndarray
    often: np.ndarray
    k: int
    blank: float
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    @cached_property
    def index(self) -> BlockMaxIndex:
        row, term = self.row.astype(np.int64), self.term.astype(np.int64)
        weight = unit(row, (1 + np.log(self.often.astype(float))) * self.idf[term], len(self.ids))
        return BlockMaxIndex.build(self.ids, row, term, weight, len(self.vocabulary))

    def __reduce__(self):
        small = [x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x for x in (self.row, self.term, self.often)]
        fields = (self.vocabulary, self.idf, self.ids, self.labels, *small, self.k, self.blank, self.knots)
        return _arrived, (zstandard.compress(pickle.dumps(fields), 1),)

    def vectors(self, texts: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of unit vectors over the known terms, ordered by text."""
        row, h, often = term_counts(texts)
        if not len(self.vocabulary) or not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = (self.vocabulary[at] == h) & (self.idf[at] > 0)
        row, term = row[known], at[known]
        return row, term, unit(row, (1 + np.log(often[known])) * self.idf[term], len(texts))

    def votes(self, texts: TextSlice, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(raw vote of each text, NaN without neighbours), and (query, place, cosine) of the neighbours."""
        q, place, cosine = self.index.nearest(*self.vectors(texts), len(texts), self.k, skip)
        w = 1 / (0.05 + 1 - cosine)
        total = np.bincount(q, w, minlength=len(texts))
        raw = np.full(len(texts), np.nan)
        some = total > 0
        raw[some] = np.bincount(q, w * self.labels[self.index.rows[place]], minlength=len(texts))[some] / total[some]
        return raw, q, place, cosine

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(raw), self.blank, np.interp(np.nan_to_num(raw), *self.knots))


def unit(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    return weight / norm[row]


def monotone(x: np.ndarray, y: np.ndarray, bins: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over quantile bins of x, as knots for interpolation; rates are smoothed by half a case each way."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(bins, len(x))):
        pools.append([float(x[part].mean()), float(y[part].sum()), float(len(part))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), a[1] + b[1], a[2] + b[2]]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def _arrived(packed: bytes) -> ToxicVoter:
    return ToxicVoter(*pickle.loads(zstandard.decompress(packed)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_examples: int = 8000, floor: float = 0.02, k: int = 15) -> ToxicVoter:
    """Fits on at most ``max_examples`` rows of ``labels`` (those with the smallest hashed id); only
    their ids and labels are broadcast, and only the term counts of their texts reach the driver.

    Rows whose label or id is null are left out.  With no labelled rows every text scores 0.5.
    """
    chosen = bounded_sample(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, label_col), id_col, max_examples)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    packed = rows.select((F.col(id_col).cast("long") * 2 + F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("key"), text_col)

    def make() -> Callable:
        def run(ids: pa.Array, texts: TextSlice):
            row, term, often = term_counts(texts)
            each = np.bincount(row, minlength=len(texts))
            return ids, list_array(term.view(np.int64), each, pa.int64()), list_array(often.astype(np.int32), each, pa.int32())

        return run

    found = map_texts(packed, "key", text_col, make, "key long, terms array<long>, counts array<int>").toArrow().combine_chunks()
    key = found["key"].to_numpy().astype(np.int64)
    if not len(key):
        none = np.zeros(0, np.int64)
        return ToxicVoter(none.astype(np.uint64), np.zeros(0), none, np.zeros(0), none, none, none, k, 0.5)
    lists = found["terms"].combine_chunks()
    row = np.repeat(np.arange(len(key), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    often = found["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    del found
    vocabulary, term = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
    term = term.astype(np.int32)
    del lists
    ids, labels, n = key >> 1, (key & 1).astype(float), len(key)
    df = np.bincount(term, minlength=len(vocabulary))
    # near copies mostly share their smallest term hash; together they count as one example
    smallest = np.full(n, np.uint64(2**64 - 1))
    np.minimum.at(smallest, row, mix(vocabulary)[term])
    _, group, copies = np.unique(smallest, return_inverse=True, return_counts=True)
    share = 1 / copies[group]
    toxic, whole = (labels * share).sum(), share.sum()
    a = np.bincount(term, (labels * share)[row], minlength=len(vocabulary))
    b = np.bincount(term, share[row], minlength=len(vocabulary)) - a
    c, d = toxic - a, whole - toxic - b
    linked = np.abs(a * d - b * c) / np.sqrt(np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9))
    idf = np.log(n / df) * (floor + linked) if len(df) else np.zeros(0)
    use = idf[term] > 0
    row, term, often = row[use], term[use], often[use]
    filled = np.bincount(row, minlength=n) > 0
    voter = ToxicVoter(vocabulary, idf, ids, labels, row, term, often, k, float((labels[~filled].sum() + 0.5) / ((~filled).sum() + 1)))
    sent = docs.sparkSession.sparkContext.broadcast(voter)
    own = _scored(packed, sent, "key", text_col, of_example=True).select("doc_id", "raw").where("NOT isnan(raw)").toArrow()
    sent.unpersist()
    raw, truth = own["raw"].to_numpy(), own["doc_id"].to_numpy() & 1
    order = np.lexsort((own["doc_id"].to_numpy(), raw))
    voter.knots = monotone(raw[order], truth[order].astype(float))
    return voter


def _scored(docs: DataFrame, sent: Broadcast, id_col: str, text_col: str, of_example: bool = False) -> DataFrame:
    """doc_id, raw, score, predicted, nearest, cosines; ``of_example``: an id is twice an example's, which has no vote of its own."""

    def make() -> Callable:
        model = sent.value

        def run(ids: pa.Array, texts: TextSlice):
            skip = ids.to_numpy(zero_copy_only=False) >> 1 if of_example else None
            raw, q, place, cosine = model.votes(texts, skip)
            score = model.scores(raw)
            each = np.bincount(q, minlength=len(texts))
            return ids, raw, score, (score >= 0.5).astype(np.int32), list_array(model.index.ids[place], each, pa.int64()), list_array(cosine, each, pa.float64())

        return run

    return map_texts(docs, id_col, text_col, make, "doc_id long, raw double, score double, predicted int, nearest array<long>, cosines array<double>")


def score_toxicity(docs: DataFrame, voter: ToxicVoter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (score >= 0.5), nearest (ids of the voting examples), cosines.

    Null and empty texts, and texts without a term that an example has, get the blank rate and no neighbours.
    Repeated ids give repeated rows; columns other than the two named are not read.
    """
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(voter), id_col, text_col).drop("raw")
