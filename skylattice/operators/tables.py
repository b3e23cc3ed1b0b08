"""Small operations on whole tables: windows of time, caps and pages, batches, channels and counters."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite


def around_now(rows: DataFrame, time: str, now: Column, before: str = "1 hour", ahead: str = "24 hours") -> DataFrame:
    """now - before <= time <= now + ahead, both ends included."""
    return rows.where(F.col(time).between(now - F.expr(f"INTERVAL {before}"), now + F.expr(f"INTERVAL {ahead}")))


def half_open(rows: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    """start <= time < end; a NULL bound is no bound."""
    t = F.col(time)
    return rows.where((start.isNull() | (t >= start)) & (end.isNull() | (t < end)))


def head(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first n rows of an order (a top-k, without a full sort)."""
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 500) -> DataFrame:
    """A page (from 0) of an order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_after(rows: DataFrame, keys: list[str], after: list[Column] | None, size: int = 500) -> DataFrame:
    """The page of an ascending order that follows a key (the first page without one): a deep page costs what the first does.

    The condition on the first key reaches the scan, and every task keeps ``size`` rows at most.  Rows with a NULL key are on no page.
    """
    rows = rows.na.drop(subset=keys)
    if after is not None:
        beyond = F.lit(False)
        for k, v in reversed(list(zip(keys, after, strict=True))):
            beyond = (F.col(k) > v) | ((F.col(k) == v) & beyond)
        rows = rows.where((F.col(keys[0]) >= after[0]) & beyond)
    return rows.orderBy(*keys).limit(size)


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows, and a warning if that leaves some out: a server's answer of limited size."""
    if rows.limit(most + 1).count() > most:
        warnings.warn(f"more than {most} rows: the answer is cut", stacklevel=2)
    return head(rows, order, most)


def batches(rows: DataFrame, keys: list[str], size: int, seed: int = 0) -> DataFrame:
    """rows with ``batch`` and ``place``: shuffled by a hash of seed and keys (ties by keys), ``size`` rows a batch.

    Rows are numbered within 4,096 ranges of the hash, whose counts are added up first, so that no task sorts all.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
    hashed = hashed.withColumn("_r", F.substring("_h", 1, 3))
    n = hashed.groupBy("_r").agg(F.count("*").alias("_n"))
    before = n.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", *keys)) - 1
    return hashed.join(F.broadcast(before), "_r").withColumn("place", place.cast("long")).withColumn("batch", F.floor(F.col("place") / size)).drop("_h", "_r", "_before")


def merged_channel(table: DataFrame, channel: DataFrame, on: list[str], name: str, missing: float = 0.0) -> DataFrame:
    """table with the column ``name`` of ``channel``: in its old place if it was there, else last; again gives the same.

    Rows that the channel does not have get ``missing``; rows that only the channel has are left out.
    """
    order = table.columns if name in table.columns else [*table.columns, name]
    return table.drop(name).join(channel.select(*on, name), on, "left").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(missing))).select(*order)


def counters(rows: DataFrame, keys: list[str], **what: Column) -> DataFrame:
    """How many rows of each key there are, and for how many each condition holds."""
    return rows.groupBy(*keys).agg(F.count("*").alias("considered"), *[F.count_if(c).alias(name) for name, c in what.items()])


def enough_stations(rows: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """rows with ``value`` NaN where fewer than ``least`` rows of the key have a finite one (a key is one moment's stations)."""
    n = F.count_if(is_finite(value)).over(Window.partitionBy(*keys))
    return rows.withColumn(value, F.when(n >= least, F.col(value)).otherwise(F.lit(float("nan"))))
