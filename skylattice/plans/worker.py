"""Ticks: infer a band, publish it, prune; on the command line, or each band on its own schedule.

    python -m skylattice.plans.worker tick --band nowcast --payloads landed.parquet --root store
    python -m skylattice.plans.worker schedule --payloads landed.parquet --root store
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grids import idw, regular_grid
from ..sources.ingest import POINT_FORECAST, hourly_value
from ..functions.scalars import lenient_double
from .schedules import Cron, Runs, at_times
from .serving import BANDS, Band, Grid, SnapshotStore

LOG = logging.getLogger(__name__)

#: What makes a band's cells (lead_min, y, x, rate): a model, or the stand-ins below.
BandInference = Callable[[DataFrame, Band, Grid], DataFrame]


def _cells(spark: SparkSession, grid: Grid) -> DataFrame:
    return regular_grid(spark, grid.height, grid.width, grid.west, grid.east, grid.south, grid.north)


def nearest_frames(payloads: DataFrame, leads: list[int]) -> DataFrame:
    """lead_min, location, lat, lon, value: for each place and lead the rate of the frame nearest to the first frame's time plus the lead.

    Of frames as near the earlier in the payload counts; a place without timed frames gives no rows.
    """
    frames = F.from_json("body", POINT_FORECAST)["animation"]["sequence"]
    timed = payloads.select("location", "lat", "lon", F.filter(F.transform(frames, lambda f, i: F.struct(i.alias("i"), F.unix_micros(F.try_to_timestamp(f["time"])).alias("t"), (lenient_double(f["value"]) * 6).alias("v"))), lambda f: f["t"].isNotNull()).alias("_f"))
    asked = timed.where(F.size("_f") > 0).select("*", F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead_min"))
    gap = lambda f: F.struct(F.abs(f["t"] - F.get("_f", 0)["t"] - F.col("lead_min") * F.lit(60_000_000).cast("long")).alias("gap"), f["i"].alias("i"), f["v"].alias("v"))
    return asked.select("lead_min", "location", "lat", "lon", F.array_min(F.transform("_f", gap))["v"].alias("value"))


def newest_polls(payloads: DataFrame) -> DataFrame:
    """location, lat, lon, body: the newest poll (by poll_ts, where there is one) of each location; of equal ones the greatest body."""
    when = [F.col("poll_ts")] if "poll_ts" in payloads.columns else []
    newest = F.max_by(F.struct("lat", "lon", "body"), F.struct(*when, "body", "lat", "lon"))
    return payloads.groupBy("location").agg(newest.alias("_p")).select("location", "_p.*")


def stand_in(payloads: DataFrame, band: Band, grid: Grid, centre: str = "brussels") -> DataFrame:
    """lead_min, y, x, rate from landed point forecasts (location, lat, lon, body), in place of a model.

    Of a place's polls the newest counts.
    The first band spreads the nearest frame of each place over the grid by inverse distance; the others are flat,
    the hourly value of one place.  Where nothing is known the rate is 0.  Without any payload it fails.
    """
    if payloads.limit(1).count() == 0:
        raise RuntimeError("no payload has landed")
    payloads = newest_polls(payloads)
    leads = band.leads()
    cells = _cells(payloads.sparkSession, grid)
    every = cells.select("y", "x", F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead_min"))
    if band.name == BANDS[0].name:
        field = idw(nearest_frames(payloads, leads), cells, ["lead_min"])
        return every.join(field, ["lead_min", "y", "x"], "left").select("lead_min", "y", "x", F.coalesce("value", F.lit(0.0)).alias("rate"))
    one = payloads.where(F.col("location") == centre).select("body")
    values = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("lead_min"), hourly_value(F.col("body"), F.lit(x)).alias("rate")) for x in leads])).alias("v")).select("v.*")
    return every.join(values, "lead_min", "left").select("lead_min", "y", "x", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def run_tick(store: SnapshotStore, payloads: DataFrame, band: str, now: datetime, infer: BandInference = stand_in, keep: int = 24, model_version: str = "stub-0.1") -> dict:
    """One refresh of a band: infer, publish into the snapshot of its five minutes, prune. Gives a summary."""
    spec = next((b for b in BANDS if b.name == band), None)
    if spec is None:
        raise ValueError(f"no band {band}")
    cells = infer(payloads, spec, store.grid)
    name = store.publish(now, band, cells, model_version=model_version, bucket_seconds=BANDS[0].refresh_seconds)
    largest = store.tensors(name).where(F.col("band") == band).agg(F.max(F.array_max("rates"))).first()[0]
    return {"snapshot": name, "band": band, "n_leads": len(spec.leads()), "max_mm_per_h": float(largest), "pruned": store.prune(keep)}


def run_all(store: SnapshotStore, payloads: DataFrame, now: datetime, bands: list[str] | None = None, infer: BandInference = stand_in) -> dict[str, dict | Exception]:
    """Every known band once; a band that fails leaves the others alone. Gives each one's summary or error."""
    out: dict[str, dict | Exception] = {}
    for band in bands or [b.name for b in BANDS]:
        if band not in {b.name for b in BANDS}:
            LOG.warning("no band %s", band)
            continue
        try:
            out[band] = run_tick(store, payloads, band, now, infer)
        except Exception as error:  # noqa: BLE001 - bands are refreshed apart from each other
            LOG.exception("tick of %s failed", band)
            out[band] = error
    return out


def schedule(store: SnapshotStore, read: Callable[[], DataFrame], checkpoint: str, infer: BandInference = stand_in) -> list[StreamingQuery]:
    """Four streaming queries, one a band, each at its own stated times; a failed tick is logged and tried again at the next turn."""
    runs = Runs(store.spark, f"{store.root}/ticks")

    def body(band: str) -> Callable[[], bool]:
        return lambda: not isinstance(run_all(store, read(), datetime.now(UTC), [band], infer)[band], Exception)

    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return [at_times(clock, f"{checkpoint}/{b.name}", b.name, Cron(b.cron), runs, body(b.name)) for b in BANDS]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=("tick", "schedule"))
    parser.add_argument("--band", choices=[b.name for b in BANDS])
    parser.add_argument("--payloads", required=True, help="Parquet of location, lat, lon, body")
    parser.add_argument("--root", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = SnapshotStore(spark, args.root)
    read = lambda: spark.read.parquet(args.payloads)
    if args.command == "tick":
        if not args.band:
            parser.error("tick needs a band")
        print(run_tick(store, read(), args.band, datetime.now(UTC)))
        return 0
    run_all(store, read(), datetime.now(UTC))
    schedule(store, read, f"{args.root}/_checkpoints")
    spark.streams.awaitAnyTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
