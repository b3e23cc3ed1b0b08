"""Grids as long tables (y, x, value): reshaping, regridding and neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import axis, idw_weight, is_finite, km_pitch, square_distance
from .nearest import nearest_of


def melt(rows: DataFrame, keys: list[str], array: str, width: int) -> DataFrame:
    """keys, y, x, value of row-major arrays."""
    long = rows.select(*keys, F.posexplode(array).alias("_i", "value"))
    return long.select(*keys, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"), "value")


def stack(cells: DataFrame, keys: list[str], width: int, value: str = "value") -> DataFrame:
    """keys, values: the cells of each key as one row-major array (a grid is of bounded size)."""
    packed = F.array_sort(F.collect_list(F.struct((F.col("y") * width + F.col("x")).alias("i"), F.col(value).alias("v"))))
    return cells.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.transform("_p", lambda p: p["v"]).alias("values"))


def regular_grid(spark, height: int, width: int, west: float, east: float, south: float, north: float) -> DataFrame:
    """y, x, lat, lon; row 0 is the north, both ends of each axis included."""
    n = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return n.select("y", "x", axis(F.col("y"), north, south, height).alias("lat"), axis(F.col("x"), west, east, width).alias("lon"))


def idw(stations: DataFrame, grid: DataFrame, keys: list[str], value: str = "value", power: float = 2.0, most_cells: int = 250_000) -> DataFrame:
    """keys, y, x, value: inverse-distance mean of all stations of a key at every cell.

    Every cell needs every station.  A grid of up to ``most_cells`` cells is broadcast; a larger one is cut into
    as many blocks of about that size as it takes, which meet the stations by an equi-join.  Sums are partly
    made before the shuffle.
    """
    used = stations.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col(value).alias("_v"))
    blocks = -(-grid.count() // most_cells)
    if blocks <= 1:
        met = used.join(F.broadcast(grid))
    else:
        placed = grid.withColumn("_block", F.pmod(F.xxhash64("y", "x"), F.lit(blocks)))
        met = used.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(placed, "_block")
    w = idw_weight(square_distance(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), power)
    return met.groupBy(*keys, "y", "x").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("value"))


def bilinear(raster: DataFrame, points: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """points (with fy and fx in pixels) with the value between the four pixels around.

    NaN outside the raster and where one of the four pixels is missing; NULL where fy or fx is.  Equal points are
    asked for once and given as often as they are there.  Each becomes its four corners with their weights;
    one equi-join fetches the pixels.
    """
    fy, fx = F.col("fy"), F.col("fx")
    inside = (fy >= 0) & (fy <= height - 1) & (fx >= 0) & (fx <= width - 1)
    y0, x0 = F.least(F.floor(fy), F.lit(height - 2)), F.least(F.floor(fx), F.lit(width - 2))
    dy, dx = fy - y0, fx - x0
    corner = lambda i, j: F.struct((y0 + i).cast("int").alias("y"), (x0 + j).cast("int").alias("x"), ((dy if i else 1 - dy) * (dx if j else 1 - dx)).alias("w"))
    named = points.columns
    asked = points.groupBy(*named).agg(F.count("*").cast("int").alias("_n"))
    corners = F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])
    spread = asked.where(inside).select(*named, "_n", F.explode(corners).alias("_c"))
    at = spread.select(*named, "_n", F.col("_c.y").alias("y"), F.col("_c.x").alias("x"), F.col("_c.w").alias("_w")).join(raster.select(*keys, "y", "x", "value"), [*keys, "y", "x"], "left")
    found = at.groupBy(*named, "_n").agg(F.sum(F.col("_w") * F.coalesce("value", F.lit(float("nan")))).alias("value"))
    beyond = asked.where(~inside | inside.isNull()).withColumn("value", F.when(inside.isNotNull(), F.lit(float("nan"))))
    return found.unionByName(beyond).select(*named, "value", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_i")).drop("_i")


def nearest_pixel(raster: DataFrame, points: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """points with the value of the pixel nearest to (fy, fx), clipped to the raster."""
    pick = lambda c, n: F.least(F.greatest(F.bround(c, 0), F.lit(0)), F.lit(n - 1)).cast("int")
    at = points.withColumns({"y": pick("fy", height), "x": pick("fx", width)})
    return at.join(raster.select(*keys, "y", "x", "value"), [*keys, "y", "x"])


def block_mean(cells: DataFrame, keys: list[str], height: int, width: int, rows: int, columns: int) -> DataFrame:
    """Means of blocks on a rows x columns grid, cells beyond whole blocks cut off; a NaN makes its block NaN."""
    bh, bw = height // rows, width // columns
    kept = cells.where((F.col("y") < rows * bh) & (F.col("x") < columns * bw))
    return kept.groupBy(*keys, F.floor(F.col("y") / bh).cast("int").alias("y"), F.floor(F.col("x") / bw).cast("int").alias("x")).agg(F.avg("value").alias("value"))


def max_pool(cells: DataFrame, keys: list[str], height: int, width: int, radius: int, wrap: bool = True) -> DataFrame:
    """Largest value within ``radius`` rows and columns of each cell, over the edges if ``wrap``; one axis after the other.

    Each axis is one window along the lines of the other; over the edges only cells near them are there twice.
    """

    def along(df: DataFrame, axis_: str, other: str, n: int) -> DataFrame:
        place = F.col(axis_)
        if wrap:
            turns = F.array(*[F.lit(k * n) for k in range(-(-radius // n) * -1, -(-radius // n) + 1)])
            df = df.select("*", F.explode(F.filter(turns, lambda s: (place + s >= -radius) & (place + s < n + radius))).alias("_s"))
        else:
            df = df.withColumn("_s", F.lit(0))
        w = Window.partitionBy(*keys, other).orderBy((place + F.col("_s")).cast("long")).rangeBetween(-radius, radius)
        return df.withColumn("value", F.max("value").over(w)).where("_s = 0").drop("_s")

    return along(along(cells.select(*keys, "y", "x", "value"), "y", "x", height), "x", "y", width)


def lower_envelope(x: np.ndarray, height: np.ndarray) -> np.ndarray:
    """For each place of x (ascending) the place whose parabola (x - place)^2 + height is lowest there, in one pass each way.

    Infinite heights have no parabola; without any the answer is -1.
    """
    sites = np.flatnonzero(np.isfinite(height))
    if not len(sites):
        return np.full(len(x), -1)
    xs, base = x[sites].tolist(), (height[sites] + x[sites] ** 2).tolist()
    kept, since = [0], [-math.inf]  # parabolas of the envelope, and from where each is lowest
    for i in range(1, len(xs)):
        while True:
            j = kept[-1]
            cross = (base[i] - base[j]) / (2 * (xs[i] - xs[j]))
            if cross > since[-1]:
                break
            kept.pop()
            since.pop()
        kept.append(i)
        since.append(cross)
    return sites[np.array(kept)[np.searchsorted(since, x, "left") - 1]]


_ROWS = 4096


def distance_to_zero(cells: DataFrame, keys: list[str], pitch_y: float, pitch_x: float) -> DataFrame:
    """Exact distance of each cell to the nearest cell of value 0 of its key; NULL if there is none.

    A key's cells are a whole grid.  First, within columns, the nearest zero row above or below: running extremes within blocks of
    rows, and those of the blocks before and behind.  Then each row is one array, on which the lower envelope of the columns'
    parabolas gives the nearest column: steps in proportion to the cells, and a row's array or a block of a column is all
    that a task holds.
    """
    column = [*keys, "x"]
    placed = cells.select(*keys, "y", "x", F.floor(F.col("y") / _ROWS).alias("_block"), F.when(F.col("value") == 0, F.col("y")).alias("_zero"))
    # both ways a frame grows with its row: one that ends at the last row is summed anew for every row
    grown = lambda order: Window.partitionBy(*column, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({"_up": F.max("_zero").over(grown(F.asc("y"))), "_down": F.min("_zero").over(grown(F.desc("y")))})
    past = lambda order: Window.partitionBy(*column).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*column, "_block").agg(F.max("_zero").alias("_high"), F.min("_zero").alias("_low"))
    beyond = blocks.select(*[F.col(c).alias(f"_of_{c}") for c in (*column, "_block")], F.max("_high").over(past(F.asc("_block"))).alias("_before"), F.min("_low").over(past(F.desc("_block"))).alias("_behind"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*column, "_block")])
    up, down = F.coalesce("_up", "_before"), F.coalesce("_down", "_behind")
    vertical = inside.join(beyond, same, "left").select(*keys, "y", F.struct("x", F.least(F.col("y") - up, down - F.col("y")).cast("double").alias("dy")).alias("_c"))
    rows = vertical.groupBy(*keys, "y").agg(F.sort_array(F.collect_list("_c")).alias("_c"))
    n = len(rows.columns) - 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(n)
            flat_x, flat_dy = (f.to_numpy(zero_copy_only=False).astype(float) for f in held.flatten().flatten())
            far, at = np.full(len(flat_x), np.nan), 0
            for size in held.value_lengths().to_numpy(zero_copy_only=False):
                x, dy = flat_x[at : at + size] * pitch_x, flat_dy[at : at + size] * pitch_y
                to = lower_envelope(x, np.where(np.isnan(dy), np.inf, dy * dy))
                if size and to[0] >= 0:
                    dx = (flat_x[at : at + size] - flat_x[at + to]) * pitch_x
                    far[at : at + size] = np.sqrt(dy[to] * dy[to] + dx * dx)
                at += size
            lists = pa.ListArray.from_arrays(held.offsets.cast(pa.int32()) if not held.offset else pa.array(np.append(0, np.cumsum(held.value_lengths())), pa.int32()), pa.array(far, pa.float64(), mask=np.isnan(far)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_d"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_d", T.ArrayType(T.DoubleType()))])
    found = rows.mapInArrow(nearest, schema).select(*keys, "y", F.explode(F.arrays_zip(F.col("_c.x").alias("x"), F.col("_d").alias("d"))).alias("_z"))
    return found.select(*keys, "y", F.col("_z.x").alias("x"), F.col("_z.d").alias("distance"))


def grid_pitch(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute difference of neighbouring values along rows and along columns."""
    along_x, along_y = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    gaps = cells.withColumns({"_gx": F.abs(F.col("value") - F.lag("value").over(along_x)), "_gy": F.abs(F.col("value") - F.lag("value").over(along_y))})
    return gaps.groupBy(*keys).agg(F.avg("_gx").alias("pitch_x"), F.avg("_gy").alias("pitch_y"))


def grid_pitch_km(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pitch_y_km, pitch_x_km: mean distance of neighbouring rows and columns of y, x, lat, lon, along the mean parallel."""
    down, across = Window.partitionBy(*keys, "x").orderBy("y"), Window.partitionBy(*keys, "y").orderBy("x")
    gaps = grid.withColumns({"_dy": F.abs(F.col("lat") - F.lag("lat").over(down)), "_dx": F.abs(F.col("lon") - F.lag("lon").over(across))})
    return gaps.groupBy(*keys).agg(km_pitch(F.avg("_dy")).alias("pitch_y_km"), km_pitch(F.avg("_dx"), F.avg("lat")).alias("pitch_x_km"))


def wet_fraction(cells: DataFrame, keys: list[str], value: str = "rate", wet: float = 0.1) -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg((~F.isnan(value) & (F.col(value) >= wet)).cast("double")).alias("wet_fraction"))


def nearest_cell(points: DataFrame, cells: DataFrame, bucket: list[str], lat: str = "lat", lon: str = "lon", ring: int = 0, together: int = 256) -> DataFrame:
    """points with the nearest cell of their bucket (with ``ring`` 1 also of the eight around), ties to the smaller cell.

    cells has bucket, cell, lat, lon; points has bucket, lat and lon.  A point without a cell in reach has
    NULL, as has one without finite coordinates; equal points stay as many as they are.  Where no bucket holds more than a
    few cells, a point meets the array of its bucket; else places and cells meet in runs (see nearest_of).
    """
    usable = cells.where(is_finite(lat) & is_finite(lon) & F.col("cell").isNotNull()).select(*bucket, "cell", F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    usable = usable.dropna(subset=bucket)
    most = usable.groupBy(*bucket).count().agg(F.max("count")).first()[0] or 0
    if most <= min(_FEW, together):
        arrays = usable.groupBy(*bucket).agg(F.collect_list(F.struct("cell", "lat", "lon")).alias("_cells"))
        near = lambda y, x: F.when(is_finite(y) & is_finite(x), F.array_min(F.transform("_cells", lambda c: F.struct(square_distance(y, x, c["lat"], c["lon"]).alias("d2"), c["cell"].alias("cell")))))
        if not ring:
            best = points.join(arrays, bucket, "left").withColumn("_b", near(F.col(lat), F.col(lon)))
            return best.select(*points.columns, F.col("_b.cell").alias("cell"), F.col("_b.d2").alias("d2"))
        side = points.groupBy(*points.columns).agg(F.count("*").cast("int").alias("_n")).select(F.struct(*points.columns).alias("_row"), "_n", *bucket)
        around = F.sequence(F.lit(-ring), F.lit(ring))
        for b in bucket:
            side = side.withColumn("_d", F.explode(around)).withColumn(b, F.col(b) + F.col("_d")).drop("_d")
        # the arrays end here, before the grouping sorts its rows
        met = side.join(arrays, bucket, "left").select("_row", "_n", near(F.col(f"_row.{lat}"), F.col(f"_row.{lon}")).alias("_b"))
        best = met.groupBy("_row", "_n").agg(F.min("_b").alias("_b"))
        return best.select("_row.*", F.col("_b.cell").alias("cell"), F.col("_b.d2").alias("d2"), F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_i")).drop("_i")
    return _with_nearest(points, usable, bucket, lat, lon, ring, together)


_FEW = 16


def _with_nearest(points: DataFrame, usable: DataFrame, keys: list[str], lat: str, lon: str, ring: int, together: int) -> DataFrame:
    """points with cell and d2 of nearest_of their places, NULL where there is none."""
    places = points.where(is_finite(lat) & is_finite(lon))
    places = places.dropna(subset=keys) if keys else places
    found = nearest_of(places.select(*keys, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")), usable, keys, ring, together)
    mine = [f"_k{i}" for i in range(len(keys))]
    found = found.select(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "cell", "d2")
    same = (F.col(f"_p.{lat}").cast("double") == F.col("_lat")) & (F.col(f"_p.{lon}").cast("double") == F.col("_lon"))
    for k, m in zip(keys, mine, strict=True):
        same = same & (F.col(f"_p.{k}") == F.col(m))
    return points.select(F.struct(*points.columns).alias("_p")).join(found, same, "left").select("_p.*", "cell", "d2")


def nearest_anywhere(points: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon", *, step: float = 0.1, together: int = 256) -> DataFrame:
    """points with the nearest of all cells and its squared distance, ties to the smaller cell; no bucket has to hold one.

    cells has cell, lat, lon.  Places and cells meet in runs (see nearest_of), which follow how close the cells lie, so ``step``, the
    width of the former buckets, no longer matters.  Equal places are searched once.  NULL coordinates, and a table without
    cells, give NULL.
    """
    usable = cells.where(is_finite(lat) & is_finite(lon) & F.col("cell").isNotNull()).select("cell", F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return _with_nearest(points, usable, [], lat, lon, 0, together)
