"""Commands over Parquet folders.

    python -m skylattice verify --forecasts F --observations O --output report.md --threshold 0.1 [--states S]
    python -m skylattice evaluate --operational F --model M --observations O --threshold 1 --sample-cells 2000
    python -m skylattice build-store --radar R --stations A --satellite M --static S --grid G --output P --start T --end T
    python -m skylattice list --url U --prefix P --start yyyyMMddHHmm --end yyyyMMddHHmm --output P
    python -m skylattice features --url U --typename N --start T --end T --output P
    python -m skylattice polls --url U --salt S --output P
    python -m skylattice maps --url U --layer L --start T --end T --minutes 15 --output P
    python -m skylattice rotate --files GLOB --month-pattern RE --output P [--mirror P] [--dry-run]

Ticks and their schedule are commands of skylattice.plans.worker.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.folders import exists
from .operators import verification as V
from .plans import tars, training
from .sources import fetch, ingest, listing


def verify(spark: SparkSession, a: argparse.Namespace) -> str:
    """The report by lead; with --states only runs that the store does not have are paired, and the report is of all of its runs."""
    forecasts, observations = spark.read.parquet(a.forecasts), spark.read.parquet(a.observations)
    if a.states:
        if exists(spark, a.states):
            known = V.stored_states(spark, a.states).select("issue_time").distinct()
            forecasts = forecasts.join(known, "issue_time", "left_anti")
        V.add_runs(spark, V.pair(forecasts, observations), [a.threshold], a.states)
        states = V.stored_states(spark, a.states)
        continuous, categorical = V.merged_continuous(states), V.merged_categorical(states).where(F.col("threshold") == a.threshold)
    else:
        pairs = V.pair(forecasts, observations)
        continuous, categorical = V.continuous(pairs), V.categorical(pairs, a.threshold)
    text = V.report(continuous, categorical)
    with open(a.output, "w") as out:
        out.write(text + "\n")
    return text


def evaluate(spark: SparkSession, a: argparse.Namespace) -> str:
    """Operational and model forecasts side by side on the same sampled cells of each run."""
    observations = spark.read.parquet(a.observations)
    pairs = {n: V.pair(spark.read.parquet(p), observations) for n, p in (("op", a.operational), ("model", a.model))}
    both = pairs["op"].select("issue_time", "y", "x").intersect(pairs["model"].select("issue_time", "y", "x"))
    cells = V.sampled(both, a.sample_cells, ["issue_time"], ["issue_time", "y", "x"])
    measured = {n: V.continuous(p.join(cells, ["issue_time", "y", "x"])).join(V.categorical(p.join(cells, ["issue_time", "y", "x"]), a.threshold), "lead_min").select("lead_min", "rmse", "csi", "bias") for n, p in pairs.items()}
    table = V.side_by_side(measured["op"], measured["model"])
    number = lambda x, form: "-" if x is None else format(x, form)
    lines = ["| lead | RMSE op | RMSE model | CSI op | CSI model | bias op | bias model |", "|---|---|---|---|---|---|---|"]
    for r in table.orderBy("lead_min").collect():  # a row for each lead
        lines.append(f"| {r.lead_min} | " + " | ".join(number(r[f"{c}_{n}"], "+.3f" if c == "bias" else ".3f") for c in ("rmse", "csi", "bias") for n in ("op", "model")) + " |")
    wins = V.win_rates(table).first()
    if wins.leads:
        lines.append(f"\nThe model has the lower RMSE at {wins.rmse_wins:.0%} of leads and the higher CSI at {wins.csi_wins:.0%}.")
    return "\n".join(lines)


def build_store(spark: SparkSession, a: argparse.Namespace) -> str:
    read = spark.read.parquet
    radar = read(a.radar).where(F.col("issue_time").between(F.lit(a.start).cast("timestamp_ntz"), F.lit(a.end).cast("timestamp_ntz")))
    satellite = read(a.satellite)
    shape = satellite.agg(F.max("y"), F.max("x")).first()
    store = training.aligned_store(radar, read(a.stations), satellite, read(a.static), read(a.grid), tuple(a.box), (shape[0] + 1, shape[1] + 1), station_seconds=a.station_minutes * 60, satellite_seconds=a.satellite_minutes * 60)
    training.write_store(store, a.output)
    return f"written to {a.output}"


def list_files(spark: SparkSession, a: argparse.Namespace) -> str:
    spark.dataSource.register(listing.KeyListingSource)
    options = {"url": a.url, "prefix": a.prefix, "start": a.start, "end": a.end, "cadence": str(a.cadence)} | dict(h.split("=", 1) for h in a.option)
    found = spark.read.format("key_listing").options(**options).load()
    if exists(spark, a.output):
        found = ingest.not_yet_present(found, spark.read.parquet(a.output), ["name"])
    found.write.mode("append").parquet(a.output)
    return f"listed in {a.output}"


def features(spark: SparkSession, a: argparse.Namespace) -> str:
    """Station rows of a span, each (timestamp, code) once: what comes again replaces what is there."""
    spark.dataSource.register(fetch.FeatureSource)
    rows = spark.read.format("wfs_features").options(url=a.url, typename=a.typename, start=a.start, end=a.end, count=str(a.count)).load()
    new = ingest.station_rows(rows).withColumn("fetched", F.lit(datetime.now(UTC)))
    old = spark.read.parquet(a.output) if exists(spark, a.output) else new.limit(0)
    training.replace_table(ingest.upsert_keep_last(old, new, ["timestamp", "code"], "fetched").orderBy("timestamp", "code"), a.output)
    return f"stations in {a.output}"


def polls(spark: SparkSession, a: argparse.Namespace) -> str:
    fetch.polled(ingest.places(spark), a.url, a.salt, datetime.now(UTC)).withColumn("date", F.to_date("poll_ts")).write.mode("append").partitionBy("date").parquet(a.output)
    return f"polls in {a.output}"


def maps(spark: SparkSession, a: argparse.Namespace) -> str:
    spark.dataSource.register(listing.LandingSource)
    times = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{datetime.fromisoformat(a.start)}', TIMESTAMP_NTZ '{datetime.fromisoformat(a.end)}', INTERVAL {int(a.minutes)} MINUTE)) AS time")
    asked = fetch.map_requests(times, a.url, a.layer, tuple(a.box), tuple(a.size))
    asked.select("name", "url", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("digest")).write.format("landing").option("path", a.output).mode("append").save()
    return f"maps in {a.output}"


def rotate(spark: SparkSession, a: argparse.Namespace) -> str:
    found = spark.read.format("binaryFile").load(a.files)
    members = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    current = datetime.now(UTC).strftime("%Y%m")
    made = tars.month_tars(members, F.regexp_extract("name", a.month_pattern, 1), current, a.output, dry_run=a.dry_run)
    for month in [] if a.dry_run or not a.mirror else made:
        tars.mirror(spark, f"{a.output}/{month}.tar", f"{a.mirror}/{month}.tar")
    return "\n".join(f"{month}: {n} files" for month, n in made.items())


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skylattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable[[SparkSession, argparse.Namespace], str], *needed: str, **given) -> None:
        one = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        one.set_defaults(run=run)
        for n in needed:
            one.add_argument(f"--{n}", required=True)
        for n, (kind, default, many) in given.items():
            one.add_argument(f"--{n.replace('_', '-')}", type=kind, default=default, nargs=many)

    box = (float, [2.5, 49.4, 6.5, 51.6], 4)
    command("verify", verify, "forecasts", "observations", "output", threshold=(float, 0.1, None), states=(str, None, None))
    command("evaluate", evaluate, "operational", "model", "observations", threshold=(float, 1.0, None), sample_cells=(int, 2000, None))
    command("build-store", build_store, "radar", "stations", "satellite", "static", "grid", "output", "start", "end", box=box, station_minutes=(int, 30, None), satellite_minutes=(int, 60, None))
    command("list", list_files, "url", "prefix", "start", "end", "output", cadence=(int, 5, None), option=(str, [], "*"))
    command("features", features, "url", "typename", "start", "end", "output", count=(int, 200_000, None))
    command("polls", polls, "url", "salt", "output")
    command("maps", maps, "url", "layer", "start", "end", "output", minutes=(int, 15, None), box=box, size=(int, [256, 256], 2))
    command("rotate", rotate, "files", "month-pattern", "output", mirror=(str, None, None))
    commands.choices["rotate"].add_argument("--dry-run", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    print(args.run(SparkSession.builder.getOrCreate(), args))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
