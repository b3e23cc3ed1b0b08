"""Exact search for the nearest cell: runs of places meet the runs of cells that can hold their nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folders import written
from ..functions.scalars import square_distance

_SIDES = {"south": F.min, "north": F.max, "west": F.min, "east": F.max}
_SLACK = 1 + 1e-9  # for the rounding of bounds
_LEVELS = (12, 6, 0)  # runs of cells are looked through in groups of 4,096 and of 64 before one by one


def _box(of: dict[str, str]) -> list[Column]:
    return [f(of[side]).alias(side) for side, f in _SIDES.items()]


def _interleaved(rows: DataFrame) -> DataFrame:
    """rows with _z, the bits of _a and _b (below 2^31) by turns: what is near in the order of _z is near in both.

    Step by step, so that no step holds the one before it twice.
    """
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        rows = rows.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask)) for c in ("_a", "_b")})
    return rows.withColumn("_z", F.shiftleft("_a", 1).bitwiseOR(F.col("_b"))).drop("_a", "_b")


def _runs(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, run, south, north, west, east, boxes, rows: rows with lat and lon in runs of up to ``size`` that lie along a Morton curve.

    Partitions are ranges of the curve and runs are cut within them, so no task counts through a whole key.  boxes are those of
    sixteenths of a run.
    """
    ends = rows.agg(*[F.percentile_approx(c, [0.001, 0.999]) for c in ("lat", "lon")]).first()

    def grade(c: str, of: list[float] | None) -> Column:
        low, high = of or (0.0, 0.0)
        width = (high - low) or 1.0
        share = (F.col(c) - (low - width)) / (3 * width)  # single far-off rows stay at the ends and do not coarsen the rest
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (2**31 - 1))

    held = [c for c in rows.columns if c not in keys]
    graded = rows.withColumns({"_a": grade("lat", ends[0]), "_b": grade("lon", ends[1])})
    along = _interleaved(graded).repartitionByRange(*keys, "_z").sortWithinPartitions(*keys, "_z", "lat", "lon")
    bits = max(size.bit_length() - 1, 0)
    part = min(bits, 4)
    parts = along.select(*keys, F.monotonically_increasing_id().alias("_n"), *held).groupBy(*keys, F.shiftright("_n", bits - part).alias("_part"))
    parts = parts.agg(*_box({"south": "lat", "north": "lat", "west": "lon", "east": "lon"}), F.collect_list(F.struct(*held)).alias("_rows"))
    runs = parts.groupBy(*keys, F.shiftright("_part", part).alias("run"))
    return runs.agg(*_box({s: s for s in _SIDES}), F.collect_list(F.struct(*_SIDES)).alias("boxes"), F.sort_array(F.flatten(F.collect_list("_rows"))).alias("rows"))


def _apart(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Square of the smallest distance of two boxes."""
    gap = lambda low, high: F.greatest(F.lit(0.0), b[low] - a[high], a[low] - b[high])
    dy, dx = gap("south", "north"), gap("west", "east")
    return dy * dy + dx * dx


def _reach(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Square of the largest distance of two boxes."""
    far = lambda low, high: F.greatest(b[high] - a[low], a[high] - b[low])
    return square_distance(far("south", "north"), far("west", "east"), F.lit(0.0), F.lit(0.0))


def _candidates(places: DataFrame, cells: DataFrame, own: list[str], theirs: list[str], ring: int) -> DataFrame:
    """own, p, met: for each run of places the runs of cells (apart, theirs, run) that can hold the nearest of one of them, nearest first.

    Groups of runs that are farther off than the farthest corner of another are left out with all that is in them, so a run of places
    meets few runs.
    """
    pairs = places.select(*own, F.col("run").alias("p"), *[F.col(s).alias(f"p_{s}") for s in _SIDES])
    for o, c in zip(own, theirs, strict=True):
        pairs = pairs.withColumn(c, F.explode(F.sequence(F.col(o) - ring, F.col(o) + ring))) if ring else pairs.withColumn(c, F.col(o))
    mine, box = {s: F.col(f"p_{s}") for s in _SIDES}, {s: F.col(s) for s in _SIDES}
    held, up = [*own, "p", *[f"p_{s}" for s in _SIDES], *theirs], None
    for level in _LEVELS:
        if level:
            nodes = cells.groupBy(*theirs, F.shiftright("run", level).alias("node")).agg(*_box({s: s for s in _SIDES}))
        else:
            nodes = cells.select(*theirs, F.col("run").alias("node"), *_SIDES, "boxes")
        if up is None:
            met = pairs.join(nodes, theirs) if theirs else pairs.crossJoin(nodes)
        else:
            met = pairs.join(nodes.withColumn("up", F.shiftright("node", up - level)), [*theirs, "up"])
        reach = _reach(mine, box) if level else F.array_min(F.transform("boxes", lambda b: _reach(mine, {s: b[s] for s in _SIDES})))
        met = met.select(*held, "node", _apart(mine, box).alias("apart"), reach.alias("reach"))
        sure = F.min("reach").over(Window.partitionBy(*own, "p"))
        pairs = met.withColumn("sure", sure).where(F.col("apart") <= F.col("sure") * _SLACK).select(*held, F.col("node").alias("up"), "apart")
        up = level
    return pairs.groupBy(*own, "p").agg(F.sort_array(F.collect_list(F.struct("apart", *theirs, F.col("up").alias("run")))).alias("met"))


def nearest_of(places: DataFrame, cells: DataFrame, keys: list[str], ring: int = 0, together: int = 256) -> DataFrame:
    """keys, lat, lon, d2, cell: for each different place the nearest cell with equal keys (each up to ``ring`` off), ties to the smaller cell.

    places have keys, lat and lon, cells also cell; coordinates are finite, and places without a cell are left out.  Both are
    cut into runs of up to ``together`` that lie near each other, and whole runs meet as arrays.
    """
    own, theirs = [f"k{i}" for i in range(len(keys))], [f"c{i}" for i in range(len(keys))]
    named = lambda df, names: df.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    once = cells.groupBy(*keys, "lat", "lon").agg(F.min("cell").alias("cell")).select(*keys, "cell", "lat", "lon")
    mine = written(_runs(named(places.select(*keys, "lat", "lon").distinct(), own), own, together), "places")
    others = written(_runs(named(once, theirs), theirs, together), "cells")
    met = _candidates(mine, others, own, theirs, ring)
    pairs = met.join(mine.select(*own, F.col("run").alias("p"), F.col("rows").alias("places")), [*own, "p"]).select(*own, "p", "places", F.explode("met").alias("m"))
    pairs = pairs.select(*own, "p", "places", "m.apart", *[F.col(f"m.{c}").alias(c) for c in theirs], F.col("m.run").alias("run"))
    pairs = pairs.join(others.select(*theirs, "run", F.col("rows").alias("cells")), [*theirs, "run"]).select(*own, "p", "apart", "places", "cells")
    n = len(own)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = None, None
        for batch in batches:
            ids, apart = list(zip(*[batch.column(i).to_pylist() for i in range(n + 1)], strict=True)), batch.column(n + 1).to_numpy()
            line, lat, lon, near, cell = [], [], [], [], []
            for i, this in enumerate(ids):
                if this != held:
                    held = this
                    ys, xs = (f.to_numpy(zero_copy_only=False) for f in batch.column(n + 2)[i].values.flatten())
                    best = np.full(len(ys), np.inf)
                if apart[i] > best.max() * _SLACK:
                    continue
                names, cy, cx = batch.column(n + 3)[i].values.flatten()
                cy, cx = cy.to_numpy(zero_copy_only=False), cx.to_numpy(zero_copy_only=False)
                oy, ox = (np.maximum(np.maximum(c.min() - v, v - c.max()), 0) for c, v in ((cy, ys), (cx, xs)))
                some = np.flatnonzero(oy * oy + ox * ox <= best * _SLACK)  # the others are farther from this run than from a cell they have met
                dy, dx = ys[some, None] - cy, xs[some, None] - cx
                d2 = dy * dy + dx * dx
                at = d2.argmin(1)  # cells are in their order, so the first is the smallest
                d2 = d2[np.arange(len(at)), at]
                new = d2 <= best[some]
                if new.any():
                    some, at, d2 = some[new], at[new], d2[new]
                    best[some] = d2
                    line.append(np.full(len(some), i))
                    lat.append(ys[some])
                    lon.append(xs[some])
                    near.append(d2)
                    cell.append(names.take(pa.array(at)))
            if line:
                by = pa.array(np.concatenate(line))
                columns = [*[batch.column(i).take(by) for i in range(n)], *[pa.array(np.concatenate(c)) for c in (lat, lon, near)], pa.concat_arrays(cell)]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, "lat", "lon", "d2", "cell"])

    double = T.DoubleType()
    schema = T.StructType([*[mine.schema[o] for o in own], *[T.StructField(c, double) for c in ("lat", "lon", "d2")], T.StructField("cell", cells.schema["cell"].dataType)])
    found = pairs.mapInArrow(search, schema).groupBy(*own, "lat", "lon").agg(F.min(F.struct("d2", "cell")).alias("b"))
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "lat", "lon", "b.d2", "b.cell")
