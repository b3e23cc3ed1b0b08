"""Stated times: cron fields, which of them have passed, and streams that run a body at them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.folders import exists, replace
from ..streaming.ticks import tick

# When feeds are pulled and archives rotated (UTC).
FEEDS = {"radar": "*/30 * * * *", "stations": "*/10 * * * *", "satellite": "*/30 * * * *", "model": "30 0,6,12,18 * * *", "rotate": "30 3 * * *"}

_BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


@dataclass(frozen=True)
class Cron:
    """minute, hour, day of month, month, day of week (0 and 7 are Sunday): stars, numbers, ranges, lists and steps."""

    text: str

    def _fields(self) -> list[set[int]]:
        parts = self.text.split()
        if len(parts) != 5:
            raise ValueError(f"{self.text!r} has not five fields")
        out = []
        for part, (low, high) in zip(parts, _BOUNDS, strict=True):
            found: set[int] = set()
            for one in part.split(","):
                span, _, step = one.partition("/")
                first, _, last = span.partition("-")
                a, b = (low, high) if span == "*" else (int(first), int(last or (high if step else first)))
                if not low <= a <= b <= high or (step and int(step) < 1):
                    raise ValueError(f"{one!r} is out of bounds")
                found |= set(range(a, b + 1, int(step or 1)))
            out.append(found)
        out[4] = {d % 7 for d in out[4]}
        return out

    def _on(self, day: date, fields: list[set[int]]) -> bool:
        """Of two limited day fields either one is enough."""
        stars = [self.text.split()[i].startswith("*") for i in (2, 4)]
        by_month, by_week = day.day in fields[2], (day.weekday() + 1) % 7 in fields[4]
        return day.month in fields[3] and (by_month and by_week if any(stars) else by_month or by_week)

    def latest(self, now: datetime, days: int = 1500) -> datetime | None:
        """The last stated time not after ``now``, in its zone."""
        fields = self._fields()
        times = sorted((h, m) for h in fields[1] for m in fields[0])
        for back in range(days):
            day = now.date() - timedelta(days=back)
            if self._on(day, fields):
                found = [t for t in times if back or t <= (now.hour, now.minute)]
                if found:
                    return datetime(day.year, day.month, day.day, *found[-1], tzinfo=now.tzinfo)
        return None

    def due(self, last: datetime | None, now: datetime) -> bool:
        """Whether a stated time lies after ``last`` and not after ``now``; without a last one, whether there was any."""
        at = self.latest(now)
        return at is not None and (last is None or at > last)


class Runs:
    """When each job last ran, in small files that are replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def last(self, job: str) -> datetime | None:
        path = f"{self.root}/{job}.json"
        if not exists(self.spark, path):
            return None
        return datetime.fromisoformat(json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))["at"])

    def ran(self, job: str, at: datetime) -> None:
        files = self.spark._jvm.org.apache.hadoop.fs
        part = files.Path(f"{self.root}/.{job}.json")
        out = part.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(part, True)
        out.write(bytearray(json.dumps({"at": at.isoformat()}).encode()))
        out.close()
        replace(self.spark, f"{self.root}/.{job}.json", f"{self.root}/{job}.json")


def at_times(feed: DataFrame, checkpoint: str, job: str, cron: Cron, runs: Runs, body: Callable[[], bool | None], every: str | None = "15 seconds", clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> StreamingQuery:
    """A stream that runs ``body`` once for each stated time; times that passed while it was down count as one.

    ``feed`` is a clock, such as Spark's rate source.  A body that gives False leaves the time open, so the next turn tries it again;
    one that raises ends the stream.
    """

    def turn(batch: DataFrame, n: int) -> None:
        now = clock()
        if cron.due(runs.last(job), now):
            if body() is not False:
                runs.ran(job, now)

    return tick(feed, checkpoint, turn, every=every)
