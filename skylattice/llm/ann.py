"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own centroids; a cell is a
pair of centroids.  A query walks over cells by the sum of its halves' distances with a
heap until the cells met hold a share of all vectors, and its candidates are ranked again by
the exact cosine in double precision on the original vectors.

Centroids are fitted on one half of at most ``sample`` distinct vectors; every vector is indexed.
The other half tells how far to walk: the share of vectors that have to be met to find so many of
the true neighbours among them as ``recall`` asks for.  Clustered vectors need a small share, vectors
without any clusters a large one.
Equal vectors are one entry that keeps the smallest ids, as many as an answer can use.
Cells are dealt out in blocks of about ``BLOCK`` entries, a larger cell in several, and the
queries that meet a block likewise, so that a crowded cell is many small groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Entries of a block, and queries of a block.
BLOCK = 2048


@dataclass
class MultiIndex:
    """Two sets of centroids and how many entries each cell has; bounded by the number of centroids."""

    first: np.ndarray
    second: np.ndarray
    held: np.ndarray

    def cells(self, unit: np.ndarray) -> np.ndarray:
        half = unit.shape[1] // 2
        return _nearest(unit[:, :half], self.first) * len(self.second) + _nearest(unit[:, half:], self.second)

    def walk(self, unit: np.ndarray, probe: int) -> np.ndarray:
        """Cells with entries, nearest pair of centroids first, until they hold ``probe`` entries."""
        half = len(unit) // 2
        a, b = ((self.first - unit[:half]) ** 2).sum(1), ((self.second - unit[half:]) ** 2).sum(1)
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[order_a].tolist(), b[order_b].tolist()
        order_a, order_b = (order_a * len(b)).tolist(), order_b.tolist()
        heap, found, total = [(a[0] + b[0], 0, 0)], [], 0
        reach = [0] * len(a)  # how far each row of pairs has been taken
        while heap and total < probe:
            _, i, j = heapq.heappop(heap)
            cell = order_a[i] + order_b[j]
            if self.held[cell]:
                found.append(cell)
                total += int(self.held[cell])
            reach[i] = j + 1
            # a pair waits until the pairs above and to the left of it have been taken
            if j + 1 < len(b) and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < len(a) and (j == 0 or reach[i + 1] == j):
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        return np.array(found, np.int64)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1)[None] - 2 * x @ centroids.T, axis=1)


def _centroids(x: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; an emptied centroid stays where it was."""
    k = max(1, min(k, len(x)))
    out = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        own = _nearest(x, out)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def _share(index: MultiIndex, unit: np.ndarray, k: int, recall: float, most: int = 500) -> float:
    """The share of ``unit`` that walks have to meet to find ``recall`` of the k nearest of its own first rows."""
    if len(unit) < 2:
        return 1.0
    half, needed = unit.shape[1] // 2, []
    a, b = _nearest(unit[:, :half], index.first), _nearest(unit[:, half:], index.second)
    for i, u in enumerate(unit[:most]):
        cosine = unit @ u
        cosine[i] = -2
        cost = ((index.first - u[:half]) ** 2).sum(1)[a] + ((index.second - u[half:]) ** 2).sum(1)[b]
        near = np.argpartition(-cosine, min(k, len(unit) - 1) - 1)[:k]
        needed.append(np.searchsorted(np.sort(cost), cost[near[near != i]], "right") / len(unit))
    return float(np.quantile(np.concatenate(needed), recall, method="higher"))


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed)).reshape(len(packed), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (packed doubles), dims of usable rows; -0.0 is packed as 0.0."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, cut = column.flatten().to_numpy() + 0.0, np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(np.diff(cut).astype(np.int32))], names=["id", "vector", "dims"])

    usable = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where(fine & F.col("id").isNotNull())
    return usable.mapInArrow(pack, "id long, vector binary, dims int")


def _entries(packed: DataFrame, keep: int) -> DataFrame:
    """vector, dims, ids (the ``keep`` smallest): a row for each distinct vector.

    The ids of equal vectors meet in parts first, so that a large group of copies is never held whole.
    """
    some = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)
    parts = packed.groupBy("vector", "dims", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")).agg(some(F.collect_list("id")).alias("ids"))
    return parts.groupBy("vector", "dims").agg(some(F.flatten(F.collect_list("ids"))).alias("ids"))


def nearest_neighbours(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, sample: int = 20_000, most_centroids: int = 512, recall: float = 0.95, share: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest found of each row that meets ``queries``.

    The query's own id is no candidate; ties go to the smaller id; fewer than k candidates are all
    returned.  Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take
    no part.  Vectors of different lengths are never compared.  Rows that share an id are candidates
    under that id each.  A walk goes on until it has met ``share`` of all entries, and k + 1 at least;
    without a share it is fitted so that a sample finds ``recall`` of its neighbours.
    """
    spark = vectors.sparkSession
    entries = written(_entries(_packed(vectors, id_col, vector_col), k + 1), "entries")
    asked = written(_packed(vectors.where(queries), id_col, vector_col), "asked")
    lengths = [r.dims for r in entries.select("dims").distinct().collect()]  # as many rows as there are vector lengths
    found = None
    for dims in sorted(lengths):
        one = _search(spark, entries.where(F.col("dims") == dims), asked.where(F.col("dims") == dims), k, sample, most_centroids, recall, share)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _search(spark, entries: DataFrame, asked: DataFrame, k: int, sample: int, most: int, recall: float, share: float | None) -> DataFrame:
    n = entries.count()
    drawn = [r.vector for r in entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toLocalIterator()]
    unit = _unit([bytes(x) for x in drawn])
    half = unit.shape[1] // 2
    size = int(min(most, max(4, n**0.5)))
    index = MultiIndex(_centroids(unit[::2, :half], size), _centroids(unit[::2, half:], size), np.zeros(0))
    if share is None:
        share = _share(index, unit[1::2], k, recall)
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell = sent.value.cells(_unit(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vector", "ids", "cell"])

    placed = written(entries.select("vector", "ids").mapInArrow(place, "vector binary, ids array<long>, cell long"), "placed")
    held = np.zeros(len(index.first) * len(index.second), np.int64)
    counts = placed.groupBy("cell").count().toArrow()  # a row for each cell at most
    held[counts["cell"].to_numpy()] = counts["count"].to_numpy()
    # neighbouring cells share a block until it is full; a cell above BLOCK entries is cut into parts
    block_of = (np.cumsum(held) - held) // BLOCK
    parts_of = np.ones(int(block_of[-1]) + 1, np.int64)
    np.maximum.at(parts_of, block_of, -(-held // BLOCK))
    walker = spark.sparkContext.broadcast((MultiIndex(index.first, index.second, held), block_of, parts_of))
    least = max(k + 1, int(np.ceil(share * n)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, block_of, parts_of = walker.value
        for batch in batches:
            packed = batch.column(0).to_pylist()
            vector, block, parts, cells = [], [], [], []
            for v, u in zip(packed, _unit(packed) if packed else (), strict=True):
                met = index.walk(u, least)
                met = met[np.argsort(block_of[met], kind="stable")]
                own, at = np.unique(block_of[met], return_index=True)
                vector += [v] * len(own)
                block.append(own)
                parts.append(parts_of[own])
                cells += np.split(met, at[1:])
            if vector:
                yield pa.RecordBatch.from_arrays([pa.array(vector, pa.binary()), pa.array(np.concatenate(block)), pa.array(np.concatenate(parts).astype(np.int32)), pa.array(cells, pa.list_(pa.int64()))], names=["vector", "block", "parts", "cells"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, block_of, parts_of = walker.value
        for batch in batches:
            block = block_of[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(parts_of[block].astype(np.int32))], names=["vector", "ids", "cell", "block", "parts"])

    wide = max(2, spark.sparkContext.defaultParallelism)  # a walk is long for its few bytes
    probes = written(asked.select("vector").distinct().repartition(wide, "vector").mapInArrow(walk, "vector binary, block long, parts int, cells array<long>"), "probes")
    # every part of a block meets every group of at most BLOCK of its queries
    crowd = probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.mapInArrow(locate, "vector binary, ids array<long>, cell long, block long, parts int").join(crowd, "block")
    left = left.select("block", F.pmod(F.xxhash64("vector"), "parts").cast("int").alias("part"), spread(F.col("groups")).alias("group"), "vector", "ids", "cell")
    right = probes.join(crowd, "block").select("block", "parts", F.pmod(F.xxhash64("vector", F.lit(5)), "groups").cast("int").alias("group"), "vector", "cells")
    right = right.select("block", spread(F.col("parts")).alias("part"), "group", "vector", "cells")
    schema = T.StructType([T.StructField("vector", T.BinaryType()), T.StructField("best", T.ArrayType(T.StructType([T.StructField("far", T.DoubleType()), T.StructField("id", T.LongType())])))])

    def rank(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"vector": [], "best": []})
        x, y = (np.frombuffer(b"".join(f["vector"])).reshape(len(f), -1) for f in (theirs, mine))
        own, cell = mine["ids"].tolist(), mine["cell"].to_numpy()
        low = int(cell.min())
        norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        met = np.zeros(int(cell.max()) - low + 1, bool)
        best = []
        for at in range(0, len(x), 256):
            cosine = (x[at : at + 256] @ y.T) / (norm_x[at : at + 256, None] * norm_y)
            for row, cells in zip(cosine, theirs["cells"].iloc[at : at + 256], strict=True):
                met[:] = False
                places = np.asarray(cells) - low
                met[places[(places >= 0) & (places < len(met))]] = True
                row = np.where(met[cell - low], row, -3.0)
                cut = max(np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else -2.0, -2.0)
                top = [(-float(row[e]), int(i)) for e in np.flatnonzero(row >= cut) for i in own[e]]
                best.append([{"far": f, "id": i} for f, i in sorted(top)[: k + 1]])
        return pd.DataFrame({"vector": theirs["vector"], "best": best})

    ranked = left.groupBy("block", "part", "group").cogroup(right.groupBy("block", "part", "group")).applyInPandas(rank, schema)
    top = ranked.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    answers = asked.select(F.col("id").alias("query_id"), "vector").join(top, "vector").select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))

