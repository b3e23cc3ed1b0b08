"""Joins and windows along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds


def asof_backward(left: DataFrame, right: DataFrame, time: str, keys: list[str], values: list[str], tolerance_seconds: float | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """left with ``right_<time>`` and right's values at the last time not after its own, within the tolerance (inclusive).

    Of equal right times the row with the greatest values wins; a NULL key meets nothing.  Both sides are laid in one stream of
    (keys, time) and the last right row is carried along: a shuffle and a sort, no pairs.  With
    ``bucket_seconds`` (and a tolerance) keys are cut into buckets of time as well, and each right row is
    also laid in the next bucket, so that a single key, or none, is many partitions.
    """
    if bucket_seconds is not None and (tolerance_seconds is None or bucket_seconds < tolerance_seconds):
        raise ValueError("buckets need a tolerance that is not longer than they are")
    packed = F.struct(F.col(time).alias("t"), *values)
    plain = [F.col(c) for c in left.columns]
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*plain).alias("_left"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_right"))
    for k in keys:
        right = right.where(F.col(k).isNotNull())
    b = right.where(F.col(time).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), packed.alias("_right"))
    by = [f"_k{i}" for i in range(len(keys))]
    if bucket_seconds is not None:
        bucket = F.floor(epoch_seconds("_t") / bucket_seconds)
        a = a.withColumn("_b", bucket)
        b = b.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
        by.append("_b")
    stream = a.unionByName(b)
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("_r", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance_seconds is not None:
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        near = micros("_t") - micros("_r.t") <= round(tolerance_seconds * 1_000_000)
        found = found.withColumn("_r", F.when(near, F.col("_r")))
    return found.select("_left.*", F.col("_r.t").alias(f"right_{time}"), *[F.col(f"_r.{v}").alias(v if v not in left.columns else f"right_{v}") for v in values])


def asof_set(left: DataFrame, right: DataFrame, time: str, keys: list[str], values: list[str], tolerance_seconds: int) -> DataFrame:
    """left joined with all right rows at the chosen time: as-of on distinct times, then an equi-join."""
    times = right.select(*keys, time).distinct()
    chosen = asof_backward(left, times, time, keys, [], tolerance_seconds)
    rows = right.select(*keys, F.col(time).alias(f"right_{time}"), *values)
    return chosen.join(rows, [*keys, f"right_{time}"])


def nearest_in_time(left: DataFrame, right: DataFrame, time: str, keys: list[str], position: str, bucket_seconds: int | None = None) -> DataFrame:
    """left with the position and time of the right row nearest in time on either side; ties go to the smaller position.

    With ``bucket_seconds`` a key is cut into buckets of time, so that one key, or none, is many partitions: a row looks within its bucket,
    and beyond it at the last right row of the buckets before and the first of those after, which come from a row for each bucket.
    """
    by = [f"_k{i}" for i in range(len(keys))]
    for k in keys:
        right = right.where(F.col(k).isNotNull())
    kind = right.select(F.struct(F.col(time).alias("t"), F.col(position).alias("p")).alias("s")).schema["s"].dataType
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    least = right.groupBy(*keys, time).agg(F.min(position).alias(position))
    b = least.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(F.col(time).alias("t"), F.col(position).alias("p")).alias("_right"))
    stream = a.unionByName(b)
    far: dict[str, Column] = {}
    if bucket_seconds is not None:
        stream = stream.withColumn("_b", F.floor(epoch_seconds("_t") / bucket_seconds))
        ends = stream.groupBy(*by, "_b").agg(F.min("_right").alias("_low"), F.max("_right").alias("_high"))
        buckets = Window.partitionBy(*by).orderBy("_b")  # a row for each bucket
        ends = ends.withColumns({"_past": F.last("_high", ignorenulls=True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.first("_low", ignorenulls=True).over(buckets.rowsBetween(1, Window.unboundedFollowing))})
        named = [F.col(k).alias(f"_e{k}") for k in [*by, "_b"]]
        ends = ends.select(*named, "_past", "_next")
        on = F.lit(True)
        for k in [*by, "_b"]:
            on = on & F.col(k).eqNullSafe(F.col(f"_e{k}"))
        stream = stream.join(ends, on, "left").drop(*[f"_e{k}" for k in [*by, "_b"]])
        by = [*by, "_b"]
        far = {"before": F.col("_past"), "after": F.col("_next")}
    order = Window.partitionBy(*by).orderBy("_t", "_side")
    before = F.coalesce(F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), far.get("before", F.lit(None)))
    after = F.coalesce(F.first("_right", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), far.get("after", F.lit(None)))
    both = stream.withColumns({"_before": before, "_after": after}).where("_side = 1 AND (_before IS NOT NULL OR _after IS NOT NULL)")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    db, da = micros("_t") - micros("_before.t"), micros("_after.t") - micros("_t")
    pick = F.when(F.col("_after").isNull() | (db < da) | ((db == da) & (F.col("_before.p") <= F.col("_after.p"))), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn("_n", pick).select("_left.*", F.col("_n.p").alias(f"nearest_{position}"), F.col("_n.t").alias(f"nearest_{time}"))


def lagged_history(rows: DataFrame, keys: list[str], time: str, step_seconds: int, frames: int) -> DataFrame:
    """keys, time, history (times, oldest first) of rows that have all ``frames`` contiguous steps up to their own."""
    t = epoch_seconds(time)
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-step_seconds * (frames - 1), 0)
    on_grid = F.filter(F.collect_list(F.col(time)).over(w), lambda x: F.pmod(t - F.unix_seconds(x.cast("timestamp")), F.lit(step_seconds)) == 0)
    return rows.select(*keys, time).distinct().withColumn("history", on_grid).where(F.size("history") == frames)


def samples(rows: DataFrame, keys: list[str], time: str, step_seconds: int, frames: int, lead_seconds: list[int]) -> DataFrame:
    """History and target for each time and lead: the history must be whole and the target present."""
    history = lagged_history(rows, keys, time, step_seconds, frames)
    asked = history.select("*", F.explode(F.array(*[F.lit(x) for x in lead_seconds])).alias("lead_s"))
    asked = asked.withColumn("target_time", F.timestamp_seconds(epoch_seconds(time) + F.col("lead_s")).cast("timestamp_ntz"))
    target = rows.select(*keys, F.col(time).alias("target_time")).distinct()
    return asked.join(target, [*keys, "target_time"])


def time_split(rows: DataFrame, time: str, share: float) -> DataFrame:
    """rows with ``part``: 'train' before the time at the split of the distinct times, 'val' from it on.

    The cut is clamp(int(n * (1 - share)), 1, n - 1).  Distinct times are numbered by range-partitioned
    ranks: counts of day buckets come first, so that no single task sorts all times.
    """
    times = rows.select(time).where(F.col(time).isNotNull()).distinct().withColumn("_d", F.to_date(time))
    days = times.groupBy("_d").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_d", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))  # a row for each day
    ranked = times.join(days, "_d").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_d").orderBy(time)) - 1)
    n = times.agg(F.count("*").alias("_n"))
    cut = F.least(F.greatest(F.floor(F.col("_n") * (1 - share)), F.lit(1)), F.col("_n") - 1)
    edge = ranked.join(F.broadcast(n)).where(F.col("_i") == cut).select(F.col(time).alias("_cut"))
    return rows.join(F.broadcast(edge), how="left").withColumn("part", F.when(F.col(time) < F.col("_cut"), "train").otherwise("val")).drop("_cut")


def early_stopping(rows: DataFrame, keys: list[str], epoch: str, loss: str, patience: int) -> DataFrame:
    """rows with best (before this epoch), improved, stale (epochs since the last improvement) and stopped."""
    w = Window.partitionBy(*keys).orderBy(epoch) if keys else Window.orderBy(epoch)
    out = rows.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("improved", F.col("best").isNull() | (F.col(loss) < F.col("best")))
    out = out.withColumn("_at", F.row_number().over(w)).withColumn("_last", F.max(F.when(F.col("improved"), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stale = F.col("_at") - F.col("_last")
    return out.withColumn("stale", stale.cast("long")).withColumn("stopped", F.max(stale >= patience).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_last")


def first_future(rows: DataFrame, keys: list[str], time: str, reference: str, value: str) -> DataFrame:
    """By key: whether any value above 0 lies ahead (time >= reference), the first such time and whole minutes until it, NULL without one."""
    rain = (F.col(time) >= F.col(reference)) & (F.col(value) > 0)
    seconds = epoch_seconds("first_time") - epoch_seconds(reference)
    out = rows.groupBy(*keys, reference).agg(F.coalesce(F.bool_or(rain), F.lit(False)).alias("rain_ahead"), F.min(F.when(rain, F.col(time))).alias("first_time"))
    return out.withColumn("minutes", F.when(F.col("first_time").isNotNull(), F.greatest(F.floor(seconds / 60), F.lit(0))).cast("long"))


def thinned(rows: DataFrame, keys: list[str], time: str, ticks: int = 5) -> DataFrame:
    """Every ceil(n / ticks)-th row of each key, from the first."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.ceil(F.count("*").over(w) / ticks), F.lit(1))
    return rows.withColumn("_i", F.row_number().over(w.orderBy(time)) - 1).withColumn("_step", step).where(F.col("_i") % F.col("_step") == 0).drop("_i", "_step")


def future_index(rows: DataFrame, keys: list[str], time: str, reference: Column) -> DataFrame:
    """Rows at or after the reference with their place among them (from 0), and whether they lie after it."""
    w = Window.partitionBy(*keys).orderBy(time)
    return rows.where(F.col(time) >= reference).withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("kind", F.when(F.col(time) > reference, "forecast").otherwise("observation"))
