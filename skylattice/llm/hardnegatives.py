"""Hard negatives by blocks of anchors against blocks of an index.

Vectors of whole numbers are stored under their nearest pivot, in blocks.  Equal vectors of a label are one entry with
their smallest ids, as many as can be returned.  The anchors, a small share of the rows, are dealt into few large groups;
a task holds one group and passes over its part of the index once, by matrix products.  For each anchor it keeps the
first rows of each range of scores asked for, all ranges in the same pass; the score that the k-th of them has is
what a later row must reach.  That score starts from a sample of the rows, and a block whose ball
cannot reach it is left out.  Scores are exact.

Pivots and first scores are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import _centroids
from .shared import bounded_sample, drop_written, written
from .textbytes import bounded_batches

#: Entries of a block.
BLOCK = 2048
#: Anchors that are multiplied with a block at once.
CHUNK = 512
#: Numbers that a task holds for its group of anchors: components and the rows kept.
GROUP = 1 << 25

_KIND = {2: "<i2", 4: "<i4", 8: "<i8"}
_NONE = -(2**62)  # below every score
_LAST = 2**63 - 1


def _width(largest: int) -> int:
    return next(w for w in (2, 4, 8) if largest < 2 ** (8 * w - 1))


class Geometry:
    """What holds for all vectors of a length: pivots, the width of a number, how products are exact, and a sample with distinct ids."""

    def __init__(self, dims: int, width: int, most: float, sample: np.ndarray, labels: np.ndarray, ids: np.ndarray, pivots: int):
        self.dims, self.width = dims, width
        # a sum of products never exceeds the largest square, so these kinds hold every partial sum exactly
        self.exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        self.slack = 1e-4 * (1 + most)
        self.pivots = _centroids(sample.astype(np.float64), pivots) if dims and len(sample) else np.zeros((1, dims))
        ids, at = np.unique(ids, return_index=True)
        self.sample, self.labels = sample[at].astype(_KIND[width]), labels[at]

    def rows(self, packed: bytes) -> np.ndarray:
        x = np.frombuffer(packed, _KIND[self.width]) if packed else np.zeros(0, _KIND[self.width])
        return x.reshape(-1, self.dims)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.pivots**2).sum(1)[None] - 2 * x.astype(np.float64) @ self.pivots.T).argmin(1)

    def floors(self, x: np.ndarray, label: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same_label: bool) -> np.ndarray:
        """A score that the first k of every range have: that of k others in the sample, or the lowest asked for."""
        out, below, y = least.min(1), most.min(1), self.sample.astype(self.exact).T
        if y.shape[1] > k:
            for a in range(0, len(x), 128):
                s = x[a : a + 128].astype(self.exact) @ y
                fits = ((self.labels[None] == label[a : a + 128, None]) == same_label) & (s <= below[a : a + 128, None])
                out[a : a + 128] = np.maximum(out[a : a + 128], np.partition(np.where(fits, s, self.exact(_NONE)), s.shape[1] - k - 1, axis=1)[:, -k - 1].astype(np.int64))
        return out


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a column of binary values, one value after the other."""
    cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[cut[0] : cut[-1]] if cut[-1] > cut[0] else np.zeros(0, np.uint8)


def _binary(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these sizes, from their bytes."""
    cut = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(rows))])


def _filled(lists: pa.Array, most: int) -> np.ndarray:
    """A row of ``most`` numbers for each list; its last one fills up."""
    size = pc.list_value_length(lists).to_numpy()
    return pc.list_flatten(lists).to_numpy()[np.minimum(np.arange(most)[None], size[:, None] - 1) + (np.cumsum(size) - size)[:, None]]


def _matrices(dims: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the packed vectors that have the same length and width."""
    if not len(column):
        return
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    for d, n in np.unique(np.stack([dims, size]), axis=1).T.tolist():
        at = np.flatnonzero((dims == d) & (size == n))
        packed = column if len(at) == len(column) else column.take(pa.array(at))
        yield d, at, _bytes(packed).view(_KIND[n // d] if d else "<i2").reshape(len(at), d)


def _usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, label, asked, dims, vector (packed whole numbers), square, largest of the rows that take part."""
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    v = vectors[vector_col] if kind in ("float", "double") else vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), v.alias("v"), F.coalesce(F.col("_asked"), F.lit(False)).alias("asked")).where("v IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            fine = np.bincount(row, weights=~np.isfinite(flat), minlength=len(size)) == 0
            if not fine.all():
                batch, flat, size = batch.filter(pa.array(fine)), flat[fine[row]], size[fine]
                row = np.repeat(np.arange(len(size)), size)
            flat = np.floor(flat * scale)
            largest = np.abs(flat).max(initial=0)
            if largest >= 2**62:
                raise ValueError("a component has no whole number of 64 bits")
            square = np.bincount(row, weights=flat * flat, minlength=len(size))
            if square.max(initial=0) >= 2**62:
                raise ValueError("a score has no whole number of 64 bits")
            width = _width(int(largest))
            vector = _binary(flat.astype(_KIND[width]), size * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(size.astype(np.int32)), vector, pa.array(square.astype(np.float64)), pa.array(np.full(len(size), int(largest), np.int64))], names=["id", "label", "asked", "dims", "vector", "square", "largest"])

    return rows.mapInArrow(pack, "id long, label long, asked boolean, dims int, vector binary, square double, largest long")


def _geometries(rows: DataFrame, sample: int, pivots: int) -> dict[int, Geometry]:
    found = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max("square").alias("most"), F.max("largest").alias("largest")).collect()  # a row for each length of vectors
    width, n = _width(max((r.largest for r in found), default=0)), sum(r.n for r in found)
    some = rows.select("id", "dims", "label", "vector")
    if n > 4 * sample:  # most of the others need not be sorted
        some = some.where(F.xxhash64("id", F.lit(17)) < -(2**63) + int(2**64 * (1.5 * sample / n)))
    drawn = bounded_sample(some, "id", sample).toArrow().combine_chunks()
    dims, labels, ids = (drawn[c].to_numpy() for c in ("dims", "label", "id"))
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for d, at, x in _matrices(dims, pa.concat_arrays(drawn["vector"].chunks) if drawn["vector"].num_chunks else pa.array([], pa.binary())):
        parts.setdefault(d, []).append((at, x.astype(np.int64)))
    out = {}
    for r in found:
        at, x = (np.concatenate(c) for c in zip(*parts.get(r.dims, [(np.zeros(0, np.int64), np.zeros((0, r.dims), np.int64))]), strict=True))
        out[r.dims] = Geometry(r.dims, width, r.most, x, labels[at], ids[at], int(min(pivots, max(1, r.n // (8 * BLOCK)))))
    return out


def _blocks(rows: DataFrame, geometries, keep: int) -> DataFrame:
    """block, dims, labels, counts, ids, vectors, ball: the index in blocks, an entry for each label and vector with its smallest ids."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d, at, x in _matrices(batch.column(2).to_numpy(), batch.column(3)):
                g, one, theirs = geometries.value[d], ids[at], label[at]
                x = x.astype(_KIND[g.width])
                mark = x.astype(np.int64) @ (np.arange(1, d + 1, dtype=np.int64) * 0x9E3779B97F4A7C1 | 1)
                order = np.lexsort((one, mark, theirs))
                x, one, theirs = x[order], one[order], theirs[order]
                if (mark[order[1:]] == mark[order[:-1]]).any():  # copies: what can't be returned goes before the shuffle
                    x, one, theirs, _ = _entries(x, one, theirs, keep)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(theirs), pa.array(np.full(len(one), d, np.int32)), pa.array(g.nearest(x).astype(np.int32)), _binary(x, np.full(len(one), d * g.width))], names=["id", "label", "dims", "pivot", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, held = TaskContext.get().partitionId() << 33, None, []

        def full(x: np.ndarray, ids: np.ndarray, label: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            y = x[start].astype(np.float64)
            centre = y.mean(0)
            ball = np.append(centre, np.sqrt(((y - centre) ** 2).sum(1).max()))
            one = [number, now[0], label[start].tobytes(), np.diff(np.append(start, len(ids))).astype(np.int32).tobytes(), ids.tobytes(), x[start].tobytes(), ball.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["block", "dims", "labels", "counts", "ids", "vectors", "ball"])

        def flush(over: bool) -> Iterator[pa.RecordBatch]:
            """Full blocks of what is held, all of it if nothing more can join; the rest is held on."""
            nonlocal held
            if not held:
                return
            x, ids, label, start = _entries(*(np.concatenate(c) for c in zip(*held, strict=True)), keep)
            at, ends = 0, np.append(start, len(ids))
            while at < len(start):
                to = min(at + BLOCK, len(start))
                turn = np.flatnonzero(np.diff(label[start[at:to]])) + 1  # an own block for a label with enough rows
                turn = turn[turn >= max(1, BLOCK // 4)]
                if len(turn):
                    to = at + int(turn[0])
                elif not over and to == len(start):
                    break
                a, b = ends[at], ends[to]
                yield full(x[a:b], ids[a:b], label[a:b], start[at:to] - a)
                at = to
            held = [(x[ends[at] :], ids[ends[at] :], label[ends[at] :])] if at < len(start) else []

        for batch in batches:
            pivot, ids, label = (batch.column(i).to_numpy() for i in (3, 0, 1))
            dims = batch.column(2).to_numpy()
            turn = np.flatnonzero((pivot[1:] != pivot[:-1]) | (dims[1:] != dims[:-1])) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(ids)], strict=True):
                if now != (int(dims[a]), int(pivot[a])):
                    yield from flush(True)
                    now = int(dims[a]), int(pivot[a])
                g = geometries.value[now[0]]
                held.append((g.rows(_bytes(batch.column(4).slice(a, b - a)).tobytes()) if now[0] else np.zeros((b - a, 0), _KIND[g.width]), ids[a:b], label[a:b]))
                if sum(len(h[1]) for h in held[1:]) > 2 * BLOCK:
                    yield from flush(False)
        yield from flush(True)

    order = ["dims", "pivot", "label", "digest"]
    placed = written(rows.select("id", "label", "dims", "vector").mapInArrow(place, "id long, label long, dims int, pivot int, vector binary"), "keyed")
    index = written(placed.withColumn("digest", F.xxhash64("vector")).repartitionByRange(*order).sortWithinPartitions(*order, "vector", "id").drop("digest").mapInArrow(cut, "block long, dims int, labels binary, counts binary, ids binary, vectors binary, ball binary"), "blocks")
    drop_written(placed)
    return index


def _entries(x: np.ndarray, ids: np.ndarray, label: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows without those beyond the first ``keep`` ids of a label and vector, and where each label and vector begins."""
    new = np.ones(len(ids), bool)
    new[1:] = (label[1:] != label[:-1]) | (x[1:] != x[:-1]).any(1)
    if not new.all():
        stays = new.copy()
        stays[1:] |= ids[1:] != ids[:-1]
        x, ids, label, new = x[stays], ids[stays], label[stays], new[stays]
        stays = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1] < keep
        x, ids, label, new = x[stays], ids[stays], label[stays], new[stays]
    return x, ids, label, np.flatnonzero(new)


def _ranked(row: np.ndarray, score: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray, k: int):
    """Sorted row, score and ids, each once; for each range the places of its first k; the score and id that a further row must reach."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    row, score, ids = row[once], score[once], ids[once]
    n = len(least)
    start = np.searchsorted(row, np.arange(n + 1))
    firsts, low, last = [], np.full(n, _LAST), np.full(n, -_LAST)
    for j in range(least.shape[1]):
        begin = start[:-1] + np.bincount(row, weights=score > most[row, j], minlength=n).astype(np.int64)
        at = np.arange(len(row)) - begin[row]
        firsts.append((at >= 0) & (at < k) & (score >= least[row, j]))
        kth = np.minimum(begin + k - 1, max(len(row) - 1, 0))
        full = (begin + k <= start[1:]) & (score[kth] >= least[:, j]) if len(row) else np.zeros(n, bool)
        t, name = (np.where(full, score[kth], least[:, j]), np.where(full, ids[kth], _LAST)) if len(row) else (least[:, j], np.full(n, _LAST))
        last = np.where(t < low, name, np.where(t == low, np.maximum(last, name), last))
        low = np.minimum(low, t)
    return row, score, ids, firsts, low, last


def _places(hit: np.ndarray) -> np.ndarray:
    """Places of the few true values, looked for eight by eight."""
    hit = hit.reshape(-1)
    if len(hit) % 8:
        return np.flatnonzero(hit)
    eight = np.flatnonzero(hit.view(np.uint64) != 0)
    one, at = np.nonzero(hit.reshape(-1, 8)[eight])
    return eight[one] * 8 + at


class _Group:
    """A group of anchors with what they have found so far."""

    def __init__(self, g: Geometry, packs: list[dict], k: int, same_label: bool):
        self.g, self.k, self.same = g, k, same_label
        self.q, self.own, self.label = (np.concatenate([np.frombuffer(p[c], np.int64) for p in packs]) for c in ("counts", "ids", "labels"))
        bounds = np.concatenate([np.frombuffer(p["ball"], np.int64).reshape(len(p["ids"]) // 8, -1) for p in packs])
        n, width = len(self.q), bounds.shape[1] // 2
        self.least, self.most = bounds[:, 1 : 1 + width], bounds[:, 1 + width :]
        self.x = np.concatenate([g.rows(p["vectors"]) if g.dims else np.zeros((len(p["ids"]) // 8, 0), np.int16) for p in packs]).astype(g.exact)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x, dtype=np.float64))
        self.low, self.last = bounds[:, 0].astype(g.exact), np.full(n, _LAST)
        self.top, self.below = self.most.max(1), self.most.min(1).astype(g.exact)
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.room = np.zeros(0, g.exact)
        self.waiting = 0

    def meet(self, block: dict) -> None:
        g, k = self.g, self.k
        labels, ids, counts = np.frombuffer(block["labels"], np.int64), np.frombuffer(block["ids"], np.int64), np.frombuffer(block["counts"], np.int32)
        m, start = len(labels), np.cumsum(counts) - counts
        first, single, alike = ids[start], len(ids) == m, bool((labels == labels[0]).all())
        y = (g.rows(block["vectors"]) if g.dims else np.zeros((m, 0), np.int16)).astype(g.exact).T
        ball = np.frombuffer(block["ball"])
        may = self.x @ ball[:-1].astype(g.exact if g.exact != np.int64 else np.float64) + self.norm * ball[-1] + g.slack >= self.low
        if alike:
            may &= (self.label == labels[0]) == self.same
        elif self.same:
            may &= np.isin(self.label, labels)
        live, distinct = np.flatnonzero(may), None
        if len(self.room) < CHUNK * m:
            self.room = np.empty(CHUNK * m, g.exact)
        for a in range(0, len(live), CHUNK):
            at = live[a : a + CHUNK]
            s = np.matmul(self.x[at], y, out=self.room[: len(at) * m].reshape(len(at), m))
            hit = _places(s >= self.low[at, None])
            if len(hit) > 16 * (k + 1) * len(at) and m > k:
                distinct = len(np.unique(first)) == m if distinct is None else distinct
                if distinct:  # the score of k others in this block
                    fits = s <= self.below[at, None]
                    if not alike:
                        fits &= (labels[None] == self.label[at, None]) == self.same
                    kth = np.partition(np.where(fits, s, g.exact(_NONE)), m - k - 1, axis=1)[:, m - k - 1]
                    self.last[at] = np.where(kth > self.low[at], _LAST, self.last[at])
                    self.low[at] = np.maximum(self.low[at], kth)
                    hit = _places(s >= self.low[at, None])
            if not len(hit):
                continue
            score, (row, col) = s.reshape(-1)[hit], np.divmod(hit, m)
            row = at[row]
            fits = (score > self.low[row]) | (first[col] <= self.last[row])
            score = score.astype(np.int64)
            fits &= score <= self.top[row]
            if not alike:
                fits &= (labels[col] == self.label[row]) == self.same
            row, col, score = row[fits], col[fits], score[fits]
            if single:
                found = first[col]
            else:  # all ids of an entry
                n = counts[col]
                row, score, found = np.repeat(row, n), np.repeat(score, n), ids[np.repeat(start[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            other = found != self.own[row]
            self.new.append((row[other], score[other], found[other]))
            self.waiting += len(self.new[-1][0])
            if self.waiting > max(1 << 18, len(self.kept[0])):
                self.settle()

    def settle(self) -> None:
        row, score, ids, firsts, low, last = _ranked(*(np.concatenate(c) for c in zip(self.kept, *self.new, strict=True)), self.least, self.most, self.k)
        stays = np.logical_or.reduce(firsts)
        self.kept, self.new, self.waiting = [row[stays], score[stays], ids[stays]], [], 0
        low = low.astype(self.g.exact)
        self.last = np.where(low > self.low, last, np.where(low == self.low, np.minimum(last, self.last), self.last))
        self.low = np.maximum(self.low, low)

    def found(self) -> Iterator[pa.RecordBatch]:
        """q, ids, scores of the anchors that found any."""
        self.settle()
        row, score, ids = self.kept
        has, start = np.unique(row, return_index=True)
        cut = np.append(start, len(row))
        for a in range(0, len(has), 4096):
            b = min(a + 4096, len(has))
            part, offsets = slice(cut[a], cut[b]), pa.array((cut[a : b + 1] - cut[a]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(self.q[has[a:b]]), pa.ListArray.from_arrays(offsets, pa.array(ids[part])), pa.ListArray.from_arrays(offsets, pa.array(score[part]))], names=["q", "ids", "scores"])


def _scan(queries: DataFrame, index: DataFrame, geometries, k: int, same_label: bool, ranges: int) -> DataFrame:
    """q, ids, scores: of each query the rows of each part of the index that can be among the first k of a range."""
    spark, together = index.sparkSession, lambda dims: max(1, GROUP // (dims + 8 * k * ranges))
    counts = queries.groupBy("dims").count().collect()  # a row for each length of vectors
    sizes = {r.dims: -(-r["count"] // together(r.dims)) for r in counts}
    begins = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    groups, tasks = max(1, sum(sizes.values())), max(32, 4 * spark.sparkContext.defaultParallelism)
    parts = max(1, min(-(-index.count() // 8), -(-tasks // groups)))  # a few blocks are not worth a task
    directory = spark.createDataFrame([(d, begins[d], n) for d, n in sizes.items()], "dims int, begin int, groups int")  # a row for each length of vectors

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy()
            dims, q, own, label = (batch.column(i).to_numpy() for i in range(1, 5))
            least, most = (_filled(batch.column(i), ranges) for i in (6, 7))
            for d, rows, x in _matrices(dims, batch.column(5)):
                g = geometries.value[d]
                floor = g.floors(x, label[rows], least[rows], most[rows], k, same_label)
                bounds, x = np.concatenate([floor[:, None], least[rows], most[rows]], axis=1), x.astype(_KIND[g.width])
                for one in np.unique(group[rows]):
                    here = np.flatnonzero(group[rows] == one)
                    at = rows[here]
                    values = [int(one), d, label[at].tobytes(), q[at].tobytes(), own[at].tobytes(), x[here].tobytes(), bounds[here].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["group", "dims", "labels", "counts", "ids", "vectors", "ball"])

    dealt = queries.join(F.broadcast(directory), "dims").select((F.col("begin") + F.pmod(F.xxhash64("q"), F.col("groups"))).cast("int").alias("group"), "dims", "q", "own", "label", "vector", "least", "most")
    packs = dealt.repartition(max(1, min(tasks, -(-sum(r["count"] for r in counts) // 256))), "q").sortWithinPartitions("group", "dims").mapInArrow(packed, "group int, dims int, labels binary, counts binary, ids binary, vectors binary, ball binary")
    columns = ["dims", "labels", "counts", "ids", "vectors", "ball"]
    asked = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select((F.col("group") * parts + F.col("part")).alias("slot"), F.lit(0).alias("kind"), *columns)
    each = F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("groups") - 1)).alias("group")
    stored = index.join(F.broadcast(directory), "dims").select("block", *columns, each).select((F.col("group") * parts + F.pmod(F.xxhash64("block"), F.lit(parts))).cast("int").alias("slot"), F.lit(1).alias("kind"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, packs, group = None, [], None
        for batch in batches:
            for one in batch.to_pylist():
                if one["slot"] != slot:
                    if group:
                        yield from group.found()
                    slot, packs, group = one["slot"], [], None
                if one["kind"] == 0:
                    packs.append(one)
                elif packs or group:
                    if not group:
                        group, packs = _Group(geometries.value[one["dims"]], packs, k, same_label), []
                    group.meet(one)
        if group:
            yield from group.found()

    return asked.unionByName(stored).repartitionById(groups * parts, F.col("slot")).sortWithinPartitions("slot", "kind").mapInArrow(run, "q long, ids array<long>, scores array<long>")


def search(queries: DataFrame, index: DataFrame, geometries, k: int, same_label: bool, ranges: int) -> DataFrame:
    """q, of, rank (from 1), id, score: the first k of each query and range of scores, exactly.

    queries has q, own, label, dims, vector and, for each of up to ``ranges`` ranges, of (its name), least and most.
    """
    found = written(_scan(queries, index, geometries, k, same_label, ranges), "found")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            asked = rows.filter(pc.is_valid(rows["of"])).combine_chunks()
            other = rows.filter(pc.is_valid(rows["ids"])).combine_chunks()
            if not len(asked) or not len(other):
                return
            size, q = pc.list_value_length(asked["of"]).to_numpy(), asked["q"].to_numpy()
            of, least, most = (_filled(asked[c], ranges) for c in ("of", "least", "most"))
            row = np.repeat(np.searchsorted(q, other["q"].to_numpy()), pc.list_value_length(other["ids"]).to_numpy())
            score, ids = (pc.list_flatten(other[c]).to_numpy() for c in ("scores", "ids"))
            row, score, ids, firsts, _, _ = _ranked(row, score, ids, least, most, k)
            for j, places in enumerate(firsts):
                hit = np.flatnonzero(places & (size[row] > j))
                if len(hit):
                    rank = np.arange(len(hit)) - np.searchsorted(row[hit], row[hit]) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(q[row[hit]]), pa.array(of[row[hit], j]), pa.array(rank.astype(np.int32)), pa.array(ids[hit]), pa.array(score[hit])], names=["q", "of", "rank", "id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            q = batch.column(0).to_numpy()
            if held and q[-1] != held[0].column(0)[0].as_py() and len(q):  # the last query may go on
                a = int(np.searchsorted(q, q[-1]))
                yield from first(pa.Table.from_batches([*held, batch.slice(0, a)]))
                held = [batch.slice(a)]
            else:
                held.append(batch)
        if held:
            yield from first(pa.Table.from_batches(held))

    none = F.lit(None).cast("array<long>")
    every = found.withColumns({"of": none, "least": none, "most": none}).unionByName(queries.select("q", none.alias("ids"), none.alias("scores"), "of", "least", "most"))
    best = written(every.repartition("q").sortWithinPartitions("q").mapInArrow(merged, "q long, of long, rank int, id long, score long"), "best")
    drop_written(found)
    return best


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *, scale: float = 1.0, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, of: int = 100, sample: int = 20_000, pivots: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Each component x counts as floor(scale * x); a score is the inner product of two rows.  The positives of an
    anchor are its first ``positives`` other rows of its label, the negatives of such a pair the first ``negatives`` rows of
    another label whose score s meets least * positive <= of * s <= most * positive; fewer are all returned.
    Higher scores come first, ties go to the smaller id.  Null ids, labels and vectors, and vectors with a
    null or non-finite component, take no part; vectors of different lengths never meet.  Rows that share the
    anchor's id are not its other rows; rows that share id and score count once.  Scores of 2**62 or more are an error.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    marked = vectors.select(vectors[id_col], vectors[label_col], vectors[vector_col], anchors.alias("_asked"))
    rows = written(_usable(marked, id_col, label_col, vector_col, scale), "vectors")
    geometries = spark.sparkContext.broadcast(_geometries(rows, sample, pivots))
    index = _blocks(rows, geometries, max(positives, negatives) + 1)
    low, high = F.lit(-(2**62)).cast("long"), F.lit(2**62).cast("long")
    asked = written(rows.where("asked").dropDuplicates(["id", "label", "dims", "vector"]).select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("own"), "label", "dims", "vector"), "anchors")
    drop_written(rows)
    first = search(asked.withColumns({"of": F.array(F.lit(0).cast("long")), "least": F.array(low), "most": F.array(high)}), index, geometries, positives, True, 1)
    pairs = first.select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = lambda n: f"({n} * positive_score - pmod({n} * positive_score, {of}L)) div {of}L"
    bounds = pairs.select("q", "positive_score").distinct().withColumns({"least": -F.expr(whole(-least)), "most": F.expr(whole(most))}).where("least <= most")
    ranges = bounds.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("positive_score", "least", "most")), False).alias("r"))
    wanted = written(asked.join(ranges, "q").select(*asked.columns, F.col("r.positive_score").alias("of"), F.col("r.least").alias("least"), F.col("r.most").alias("most")), "wanted")
    second = search(wanted, index, geometries, negatives, False, positives)
    for table in (index, wanted):
        drop_written(table)
    found = second.withColumnRenamed("of", "positive_score").join(pairs, ["q", "positive_score"]).join(asked.select("q", F.col("own").alias("anchor_id")), "q")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
