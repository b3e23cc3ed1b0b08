"""Training features from aligned sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_cycle


def channels(samples: DataFrame, cells: DataFrame, keys: list[str], time: str, value: str, lead_scale: float = 7200.0) -> DataFrame:
    """Long features (keys, time, lead_s, channel, value): the frames of the history, the lead plane and the day cycle.

    samples has keys, time, history, lead_s and target_time, as made by temporal.samples().
    """
    head = [*keys, time, "lead_s"]
    frames = samples.select(*head, F.posexplode("history").alias("_c", "_t")).join(cells.select(*keys, F.col(time).alias("_t"), F.col(value).alias("value")), [*keys, "_t"])
    frames = frames.select(*head, F.concat(F.lit("frame_"), F.col("_c").cast("string")).alias("channel"), F.col("value").cast("double"))
    s, c = day_cycle(time)
    planes = F.explode(F.array(F.struct(F.lit("lead").alias("channel"), (F.col("lead_s") / lead_scale).alias("value")), F.struct(F.lit("day_sin").alias("channel"), s.alias("value")), F.struct(F.lit("day_cos").alias("channel"), c.alias("value"))))
    return frames.unionByName(samples.select(*head, planes.alias("_p")).select(*head, "_p.channel", "_p.value"))


def packed(features: DataFrame, head: list[str]) -> DataFrame:
    """One row for each sample: its channels by name as a map (their number is fixed)."""
    return features.groupBy(*head).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "value")))).alias("features"))


def with_static(rows: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """Static channels of a grid joined to every row; Spark broadcasts them as long as they are small."""
    return rows.join(static, on, "left")


def filled(rows: DataFrame, columns: list[str], missing: float = float("nan")) -> DataFrame:
    """Channels that an outer join left NULL get the marker."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns})


def normalised(rows: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """(value - centre) / scale of each named column."""
    return rows.withColumns({c: (F.col(c) - centre) / scale for c, (centre, scale) in scales.items() if scale and math.isfinite(scale)})


def scored(rows: DataFrame, infer, schema: str) -> DataFrame:
    """Model scoring: ``infer`` maps an iterator of pandas frames to one; it runs beside the data, batch by batch."""
    return rows.mapInPandas(infer, schema)
