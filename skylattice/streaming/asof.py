"""As-of join of two streams with freshness."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Timestamps without a zone keep their microseconds in state.
_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_OUT = "row string, right_us long, right string"


class _NewestRight(StatefulProcessor):
    """Holds the left rows of a group of keys until the watermark has passed them, and the right rows that they or later ones can use.

    A left row is answered when no earlier right row can come any more.  Of a key's right rows, those after the watermark are
    kept and the newest before it; a timer removes that one when it is older than the tolerance.
    """

    def __init__(self, values: list[str], tolerance_us: int):
        self.values, self.tolerance = values, tolerance_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "k string, t long, row string")
        self.known = handle.getListState("known", "k string, t long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left, right = [], []
        for frame in rows:
            for k, side, t, body in zip(*(frame[c].tolist() for c in ("k", "side", "us", "body")), strict=True):
                (left if side else right).append((k, int(t), body))
        if left:
            self.waiting.appendList(left)
        if right:
            self.known.appendList(right)  # older ones go when the waiting rows have been answered
        self._wake([t for rows in (left, right) for _, t, _ in rows], timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = self._greatest()
        times = {k: sorted(at) for k, at in known.items()}
        found, later = [], []
        for k, t, row in self.waiting.get():
            if t >= passed:
                later.append((k, t, row))
                continue
            mine = times.get(k, ())
            at = bisect_right(mine, t) - 1
            fresh = at >= 0 and t - mine[at] <= self.tolerance
            found.append((row, mine[at] if fresh else None, known[k][mine[at]] if fresh else None))
        if found:
            self.waiting.put(later) if later else self.waiting.clear()
        kept = self._keep(known, times, passed)
        self._wake([*(t for _, t, _ in later), *(t if t >= passed else t + self.tolerance for _, t, _ in kept)], passed // 1000)
        if found:
            rows, us, values = zip(*found, strict=True)
            yield pd.DataFrame({"row": rows, "right_us": pd.array(us, dtype="Int64"), "right": values})

    def close(self) -> None:
        pass

    def _rank(self, value: str) -> tuple:
        """Order of values as in a struct: nulls first."""
        held = json.loads(value)
        return tuple((v is not None, v if v is not None else 0) for v in (held.get(c) for c in self.values))

    def _greatest(self) -> dict[str, dict[int, str]]:
        """Of the right rows the greatest of each key and time."""
        best: dict[str, dict[int, str]] = {}
        for k, t, v in self.known.get():
            at = best.setdefault(k, {})
            if t not in at or (v != at[t] and self._rank(v) > self._rank(at[t])):
                at[t] = v
        return best

    def _keep(self, known: dict[str, dict[int, str]], times: dict[str, list[int]], passed: int) -> list[tuple[str, int, str]]:
        """Stores what can still be used: of each key nothing before the newest row that the watermark has passed."""
        kept = []
        for k, mine in times.items():
            first = bisect_left(mine, passed)
            if first and mine[first - 1] + self.tolerance >= passed:
                first -= 1
            kept += [(k, t, known[k][t]) for t in mine[first:]]
        self.known.put(kept) if kept else self.known.clear()
        return kept

    def _wake(self, times: list[int], watermark_ms: int) -> None:
        """One timer a group: just after its earliest row, or when its newest right row has become too old."""
        before = [t for t in self.handle.listTimers() if t > watermark_ms]  # one that fires now is over
        if times:
            first = min(times) // 1000 + 1
            if not before or first < min(before):
                for timer in before:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)


def asof_stream(left: DataFrame, right: DataFrame, time: str, keys: list[str], values: list[str], tolerance_seconds: float, late: str = "0 seconds", groups: int = 4096) -> DataFrame:
    """operators.temporal.asof_backward for two streams: each left row once, when the watermark has passed it.

    Rows that come later than ``late`` are dropped; so are right rows without a key or a time and left rows without a
    time.  A left row without a key, or with none but right rows past the tolerance, has NULLs.  State is the left rows that
    wait and at most one right row a key beside those after the watermark.  It is held by ``groups`` groups of keys, since calls and
    frames for each key would cost far more than its rows; the number is fixed when a stream starts.  Needs the RocksDB state store, in
    spark.sql.streaming.stateStore.providerClass.
    """
    sides = {}  # names without an underscore in front: frames are made from named tuples
    for side, rows, body in ((1, left, left.columns), (0, right, values)):
        at = F.col(time).cast("timestamp")
        named = rows.where(F.col(time).isNotNull())
        for k in keys if not side else ():
            named = named.where(F.col(k).isNotNull())
        text = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
        named_keys = [F.pmod(F.xxhash64(*text), F.lit(groups)).alias("g"), F.to_json(F.struct(*text)).alias("k")] if keys else [F.lit(0).cast("long").alias("g"), F.lit("").alias("k")]
        sides[side] = named.select(*named_keys, at.alias("at"), F.unix_micros(at).alias("us"), F.lit(side).alias("side"), F.to_json(F.struct(*body), _JSON).alias("body"))
    stream = sides[1].unionByName(sides[0]).withWatermark("at", late)
    out = stream.groupBy("g").transformWithStateInPandas(_NewestRight(values, round(tolerance_seconds * 1_000_000)), _OUT, "append", "EventTime")
    row = F.from_json("row", left.schema, _JSON)
    kind = right.select(*values).schema
    found = out.select(row.alias("l"), F.timestamp_micros("right_us").cast(right.schema[time].dataType).alias("t"), F.from_json("right", kind, _JSON).alias("r"))
    return found.select("l.*", F.col("t").alias(f"right_{time}"), *[F.col(f"r.{v}").alias(v if v not in left.columns else f"right_{v}") for v in values])
