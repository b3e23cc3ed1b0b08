"""Stated times, the stream that keeps them, and the commands."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylattice import __main__ as commands
from skylattice.plans import schedules, serving, tars
from skylattice.plans.schedules import Cron

T0 = datetime(2024, 5, 1)


def brute(cron, now):
    for back in range(60 * 24 * 40):
        t = now.replace(second=0, microsecond=0) - timedelta(minutes=back)
        if cron(t):
            return t


@pytest.mark.parametrize("text, wanted", [
    ("*/5 * * * *", lambda t: t.minute % 5 == 0),
    ("0 */3 * * *", lambda t: t.minute == 0 and t.hour % 3 == 0),
    ("30 0,6,12,18 * * *", lambda t: t.minute == 30 and t.hour in (0, 6, 12, 18)),
    ("0 */12 * * *", lambda t: t.minute == 0 and t.hour in (0, 12)),
    ("15 10-12 1 * *", lambda t: t.minute == 15 and t.hour in (10, 11, 12) and t.day == 1),
    ("0 8 * * 1-5", lambda t: t.minute == 0 and t.hour == 8 and t.weekday() < 5),
    ("0 8 3 * 7", lambda t: t.minute == 0 and t.hour == 8 and (t.day == 3 or t.weekday() == 6)),
    ("20/20 4 * * *", lambda t: t.minute in (20, 40) and t.hour == 4),
])
def test_latest_is_brute_force(text, wanted):
    for k in range(40):
        now = T0 + timedelta(minutes=37 * k * k, seconds=11)
        assert Cron(text).latest(now) == brute(wanted, now)


def test_odd_fields():
    for text in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            Cron(text).latest(T0)
    assert Cron("0 0 31 2 *").latest(T0) is None
    assert Cron("0 0 29 2 *").latest(datetime(2027, 1, 1)) == datetime(2024, 2, 29)
    assert all(Cron(t).latest(T0) for t in schedules.FEEDS.values()) and all(Cron(b.cron).latest(T0) for b in serving.BANDS)
    assert Cron("0 * * * *").due(T0 - timedelta(minutes=1), T0) and not Cron("0 * * * *").due(T0, T0 + timedelta(minutes=59)) and Cron("0 * * * *").due(None, T0)


def test_a_stated_time_runs_once_and_failed_ones_again(spark, tmp_path):
    runs, now, done, good = schedules.Runs(spark, str(tmp_path / "ticks")), [T0.replace(tzinfo=UTC)], [], [True]
    schema = "v int"

    def turn():
        spark.createDataFrame([(1,)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        schedules.at_times(feed, str(tmp_path / "state"), "hourly", Cron("0 * * * *"), runs, lambda: done.append(now[0]) or good[0], every=None, clock=lambda: now[0]).awaitTermination()

    for minutes, ok in ((0, True), (10, True), (61, False), (62, True), (63, True), (400, True)):
        now[0], good[0] = (T0 + timedelta(minutes=minutes)).replace(tzinfo=UTC), ok
        turn()
    assert [(t - T0.replace(tzinfo=UTC)).total_seconds() / 60 for t in done] == [0, 61, 62, 400]
    assert runs.last("hourly") == now[0] and runs.last("other") is None


def field(spark, factor):
    k = F.col("id")
    return spark.range(4 * 6 * 20).select((F.lit(T0) + F.make_interval(mins=(F.floor(k / 120) * 5).cast("int"))).cast("timestamp_ntz").alias("issue_time"), (F.floor(k % 120 / 20) * 5).cast("int").alias("lead_min"), (k % 20 / 5).cast("int").alias("y"), (k % 5).cast("int").alias("x"), (k % 7 * factor).cast("double").alias("rate"))


def test_commands(spark, tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    fc = field(spark, 1.0)
    fc.write.parquet(p("fc"))
    field(spark, 0.9).write.parquet(p("model"))
    fc.select((F.col("issue_time") + F.make_interval(mins="lead_min")).cast("timestamp_ntz").alias("valid_time"), "y", "x", (F.col("rate") + 0.5).alias("rate")).dropDuplicates(["valid_time", "y", "x"]).write.parquet(p("obs"))
    run = lambda *a: commands.main(list(a)) == 0 and capsys.readouterr().out
    whole = run("verify", "--forecasts", p("fc"), "--observations", p("obs"), "--output", p("a.md"), "--threshold", "2")
    assert whole.count("| +") == 6 and open(p("a.md")).read() == whole
    fc.where(F.col("issue_time") < T0 + timedelta(minutes=10)).write.parquet(p("early"))
    run("verify", "--forecasts", p("early"), "--observations", p("obs"), "--output", p("b.md"), "--threshold", "2", "--states", p("states"))
    assert run("verify", "--forecasts", p("fc"), "--observations", p("obs"), "--output", p("b.md"), "--threshold", "2", "--states", p("states")) == whole
    side = run("evaluate", "--operational", p("fc"), "--model", p("model"), "--observations", p("obs"), "--threshold", "2", "--sample-cells", "9")
    assert side.count("\n| ") == 6 and "of leads" in side
    os.makedirs(p("files"))
    for m, d in ((1, 1), (1, 2), (2, 1)):
        with open(p(f"files/RAD_20240{m}{d:02d}0000.h5"), "wb") as f:
            f.write(bytes([m, d]) * 99)
    said = run("rotate", "--files", p("files/*.h5"), "--month-pattern", r"_(\d{6})", "--output", p("tars"), "--dry-run")
    assert said == "202401: 2 files\n202402: 1 files\n" and not os.path.exists(p("tars"))
    run("rotate", "--files", p("files/*.h5"), "--month-pattern", r"_(\d{6})", "--output", p("tars"), "--mirror", p("nas"))
    assert tars.read_index(spark, p("nas/202401.tar")).count() == 2
    with pytest.raises(SystemExit):
        commands.main(["verify"])
