"""Edge cases and properties of the operators."""

import json
import math
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.functions import scalars as S
from skylattice.operators import features as X
from skylattice.operators import grids as G
from skylattice.operators import temporal as T
from skylattice.operators import verification as V
from skylattice.operators import tables
from skylattice.plans import archive, serving, training, worker
from skylattice.sources import ingest as I
from skylattice.streaming import ticks

T0 = datetime(2024, 5, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_level_boundaries(spark):
    rows = [(0.0, "none"), (-1.0, "none"), (2.49, "light"), (2.5, "moderate"), (7.49, "moderate"), (7.5, "heavy"), (49.9, "heavy"), (50.0, "violent"), (float("nan"), "none")]
    df = spark.createDataFrame(rows, "r double, want string").withColumn("got", S.rain_level("r"))
    assert all(r.got == r.want for r in df.collect())


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.1, 0.5, 60.0, float("nan"))], "v double")
    got = [r.b for r in df.select(S.cut("v", [0, 0.1, 0.5, float("inf")], ["a", "b", "c"]).alias("b")).collect()]
    assert got == [None, None, "a", "b", "c", None]
    low = [r.b for r in df.select(S.cut("v", [0, 0.1], ["a"], include_lowest=True).alias("b")).collect()]
    assert low[1] == "a"


def test_zero_denominators_give_null(spark):
    pairs = spark.createDataFrame([(T0, 0, 0, 0, 0.0, 0.0)], "issue_time timestamp_ntz, lead_min int, y int, x int, forecast double, observed double")
    row = V.categorical(pairs, 1.0).first()
    assert row.correct_negatives == 1 and row.pod is None and row.hss is None
    assert V.skill(pairs).first().skill is None


def test_nan_is_never_above_a_threshold(spark):
    assert one(spark, S.at_least(F.lit(float("nan")), 1.0)) is False
    fc = spark.createDataFrame([(T0, 0, 0, 0, float("nan")), (T0, 0, 0, 1, 2.0)], "issue_time timestamp_ntz, lead_min int, y int, x int, rate double")
    obs = spark.createDataFrame([(T0, 0, 0, 1.0), (T0, 0, 1, 1.0)], "valid_time timestamp_ntz, y int, x int, rate double")
    assert V.pair(fc, obs).count() == 1


def test_contingency_adds_up_and_persistence_is_the_self_join(spark):
    fc, obs = I.synthetic_runs(spark, runs=3, height=8, width=8, leads=5)
    pairs = V.pair(fc, obs)
    row = V.categorical(pairs, 0.1).agg(F.sum(F.col("hits") + F.col("misses") + F.col("false_alarms") + F.col("correct_negatives")).alias("n")).first()
    assert row.n == pairs.count() == 3 * 5 * 64
    start = pairs.where("lead_min = 0").select("issue_time", "y", "x", F.col("observed").alias("s"))
    want = {r.lead_min: r.v for r in pairs.join(start, ["issue_time", "y", "x"]).groupBy("lead_min").agg(F.sqrt(F.avg((F.col("s") - F.col("observed")) ** 2)).alias("v")).collect()}
    for r in V.persistence(pairs).collect():
        assert math.isclose(r.rmse_persistence, want[r.lead_min], abs_tol=1e-9)
    assert "| +0 |" in V.report(V.continuous(pairs), V.categorical(pairs, 0.1))


def test_sampling_is_stable(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("g"), "id")
    a = V.sampled(df, 7, ["g"], ["g", "id"]).collect()
    b = V.sampled(df.repartition(7), 7, ["g"], ["g", "id"]).collect()
    assert sorted(a) == sorted(b) and len(a) == 70


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(left=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=25), right=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), max_size=25), bucketed=st.booleans())
def test_asof_is_brute_force(spark, left, right, bucketed):
    a = spark.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(left)], "id int, k int, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(m), float(m)) for k, m in right], "k int, t timestamp_ntz, v double")
    got = {r.id: r.v for r in T.asof_backward(a, b, "t", ["k"], ["v"], 600, bucket_seconds=900 if bucketed else None).collect()}
    for i, (k, m) in enumerate(left):
        near = [x for kk, x in right if kk == k and m - 10 <= x <= m]
        assert got[i] == (float(max(near)) if near else None)


def test_asof_without_keys_and_clashing_names(spark):
    a = spark.createDataFrame([(at(5), 1.0)], "t timestamp_ntz, v double")
    b = spark.createDataFrame([(at(5), 2.0), (None, 3.0)], "t timestamp_ntz, v double")
    row = T.asof_backward(a, b, "t", [], ["v"], 60).first()
    assert (row.v, row.right_v, row.right_t) == (1.0, 2.0, at(5))
    with pytest.raises(ValueError):
        T.asof_backward(a, b, "t", [], ["v"], None, bucket_seconds=60)


def test_nearest_prefers_first_of_equals(spark):
    a = spark.createDataFrame([(1, at(0))], "k int, t timestamp_ntz")
    b = spark.createDataFrame([(1, 7, at(-10)), (1, 3, at(10)), (1, 1, at(20))], "k int, p int, t timestamp_ntz")
    assert T.nearest_in_time(a, b, "t", ["k"], "p").first().nearest_p == 3


def test_first_future_rain(spark):
    rows = [(1, at(-10), 5.0), (1, at(20), 2.0), (2, at(0), 1.0), (3, at(5), 0.0)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, v double").withColumn("ref", F.lit(T0))
    got = {r.k: (r.rain_ahead, r.minutes) for r in T.first_future(df, ["k"], "t", "ref", "v").collect()}
    assert got == {1: (True, 20), 2: (True, 0), 3: (False, None)}


def test_history_needs_every_step(spark):
    df = spark.createDataFrame([(1, at(m)) for m in (0, 5, 10, 20, 25, 30)], "k int, t timestamp_ntz")
    got = sorted(r.t for r in T.lagged_history(df, ["k"], "t", 300, 3).collect())
    assert got == [at(10), at(30)]
    s = T.samples(df, ["k"], "t", 300, 3, [600]).collect()
    assert [(r.t, r.target_time) for r in s] == [(at(10), at(20))]


def test_time_split_bounds(spark):
    df = spark.createDataFrame([(at(1440 * i),) for i in range(4)], "t timestamp_ntz")
    parts = lambda share: [r.part for r in T.time_split(df, "t", share).orderBy("t").collect()]
    assert parts(0.25) == ["train"] * 3 + ["val"]
    assert parts(1.0) == ["train"] + ["val"] * 3


@pytest.fixture(scope="module")
def raster(spark):
    return spark.createDataFrame([(1, y, x, float(y * 6 + x)) for y in range(6) for x in range(6)], "k int, y int, x int, value double")


def test_grids(spark, raster):
    assert {r.value for r in G.block_mean(raster.withColumn("value", F.lit(2.0)), ["k"], 6, 6, 3, 3).collect()} == {2.0}
    nan = raster.withColumn("value", F.when((F.col("y") == 0) & (F.col("x") == 0), float("nan")).otherwise(1.0))
    assert sum(math.isnan(r.value) for r in G.block_mean(nan, ["k"], 6, 6, 3, 3).collect()) == 1
    pooled = {(r.y, r.x): r.value for r in G.max_pool(raster, ["k"], 6, 6, 1).collect()}
    assert pooled[0, 0] == 35.0 and pooled[2, 2] == 21.0
    flat = {(r.y, r.x): r.value for r in G.max_pool(raster, ["k"], 6, 6, 1, wrap=False).collect()}
    assert flat[0, 0] == 7.0
    points = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 5.0, 5.0), (1, 3, 5.1, 0.0)], "k int, id int, fy double, fx double")
    got = {r.id: r.value for r in G.bilinear(raster, points, ["k"], 6, 6).collect()}
    assert got[1] == 3.5 and got[2] == 35.0 and math.isnan(got[3])
    assert G.stack(raster, ["k"], 6).first()["values"] == [float(i) for i in range(36)]
    again = G.melt(G.stack(raster, ["k"], 6), ["k"], "values", 6)
    assert again.exceptAll(raster).isEmpty()


def test_distance_is_brute_force(spark):
    cells = [(1, y, x, 0 if (y * 7 + x * 3) % 11 == 0 else 1) for y in range(7) for x in range(9)] + [(2, 0, 0, 1)]
    df = spark.createDataFrame(cells, "k int, y int, x int, value int")
    got = {(r.k, r.y, r.x): r.distance for r in G.distance_to_zero(df, ["k"], 2.0, 3.0).collect()}
    for k, y, x, _ in cells:
        ways = [math.hypot((y - b) * 2.0, (x - c) * 3.0) for a, b, c, v in cells if a == k and v == 0]
        assert (got[k, y, x] is None) if not ways else math.isclose(got[k, y, x], min(ways))


def test_idw_stays_within_values(spark):
    stations = spark.createDataFrame([(49.0, 2.0, 1.0), (52.0, 7.0, 5.0), (50.0, 4.0, None)], "lat double, lon double, value double")
    grid = G.regular_grid(spark, 5, 6, 1.5, 7.5, 48.9, 52.5)
    assert all(1.0 <= r.value <= 5.0 for r in G.idw(stations, grid, []).collect())
    corner = grid.orderBy("y", "x").first()
    assert (corner.lat, corner.lon) == (52.5, 1.5)


def test_projection_round_trip(spark):
    p = dict(true_lat=60.0, lon0=0.0, a=6378.137, b=6356.752)
    df = spark.createDataFrame([(50.5, 4.3), (52.0, -3.0), (89.0, 120.0)], "lat double, lon double")
    x, y = S.polar_stereographic(F.col("lat"), F.col("lon"), **p)
    lat, lon = S.polar_stereographic_inverse(F.col("px"), F.col("py"), **p)
    for r in df.withColumns({"px": x, "py": y}).withColumns({"la": lat, "lo": lon}).collect():
        assert math.isclose(r.la, r.lat, abs_tol=1e-8) and math.isclose(r.lo, r.lon, abs_tol=1e-8)


def test_text_and_time(spark):
    assert one(spark, S.duration_seconds(F.lit("P1DT2H"))) == 93600
    assert one(spark, S.duration_seconds(F.lit("PT"))) is None
    assert one(spark, S.header_time(F.lit("05-MAY-2024;10:20:30.000"))) == datetime(2024, 5, 5, 10, 20, 30)
    assert one(spark, S.stamp_time(F.lit("none"))) is None
    assert one(spark, S.lead_minutes(F.lit(at(-1)) - F.expr("INTERVAL 30 SECOND"), F.lit(T0))) == -2
    assert one(spark, S.calibrated(F.lit(65535), F.lit("GEO=0.01*PV+0"))) != one(spark, S.calibrated(F.lit(10), F.lit("GEO=0.01*PV+0")))
    assert math.isclose(one(spark, S.calibrated(F.lit(10), F.lit("GEO=0.01*PV+0.0"))), 1.2)
    assert one(spark, S.absolute_url(F.lit("http://b/"), F.lit("/x"))) == "http://b/x"
    assert one(spark, S.clock_label(F.lit(T0), "Europe/Brussels")) == "02:00"
    expanded = one(spark, I.expand_times(F.lit("junk,2024-05-01T00:00:00Z/2024-05-01T00:30:00Z/PT15M,2024-05-01T00:15:00Z")))
    assert expanded == [at(0), at(15), at(30)]
    xml = "<Layer><Name>a</Name></Layer><Layer><Name>rain</Name><Dimension name=\"time\" units=\"x\"> T1,T2 </Dimension></Layer>"
    assert one(spark, I.layer_dimension(F.lit(xml), "rain")) == "T1,T2"


@pytest.mark.parametrize("body", ["{}", "junk", '{"animation":{}}', '{"animation":{"sequence":[null,{"time":"x"}]}}'])
def test_malformed_payloads_give_no_rows(spark, body):
    df = spark.createDataFrame([("l", 1.0, 2.0, T0, body)], "location string, lat double, lon double, poll_ts timestamp, body string")
    assert I.animation_rows(df).count() == 0


def test_payload_values(spark):
    body = json.dumps({"animation": {"sequence": [{"time": "2024-05-01T00:10:00+00:00", "value": 1.5}, {"time": "2024-05-01T02:20:00+02:00", "value": "odd"}]}, "for": {"hourly": [{"precipQuantity": "0.4"}, {"precipQuantity": 2}]}})
    df = spark.createDataFrame([("l", 1.0, 2.0, T0, body)], "location string, lat double, lon double, poll_ts timestamp, body string")
    assert [(r.lead_min, r.value_mm_per_h) for r in I.animation_rows(df).orderBy("lead_min").collect()] == [(10, 9.0), (20, 0.0)]
    hours = df.select(*[I.hourly_value(F.col("body"), F.lit(m)).alias(f"m{m}") for m in (0, 60, 600)]).first()
    assert list(hours) == [0.4, 2.0, 2.0]


def test_station_rows(spark):
    f = json.dumps({"geometry": {"coordinates": [4.3, 50.8]}, "properties": {"code": 6447, "timestamp": "2024-05-01T00:00:00Z", "pressure": 1013.2, "wind_direction": "x"}})
    row = I.station_rows(spark.createDataFrame([(f,)], "feature string")).first()
    assert (row.lon, row.code, row.pressure, row.wind_direction) == (4.3, 6447, 1013.2, None)


def test_store_publishes_whole_snapshots(spark, tmp_path):
    store = serving.SnapshotStore(spark, str(tmp_path / "store"), serving.Grid(height=10, width=10))
    assert store.health(T0)["status"] == "empty"
    with pytest.raises(serving.RequestError) as e:
        store.forecast(50.0, 4.0)
    assert e.value.status == 503
    cells = lambda band, rate: spark.range(len(next(b for b in serving.BANDS if b.name == band).leads()) * 100).select(F.element_at(F.array(*[F.lit(x) for x in next(b for b in serving.BANDS if b.name == band).leads()]), (F.floor(F.col("id") / 100) + 1).cast("int")).alias("lead_min"), F.floor(F.col("id") % 100 / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.lit(rate).alias("rate"))
    store.publish(T0, "nowcast", cells("nowcast", 1.0))
    store.publish(at(5), "short", cells("short", 2.0))
    got = store.forecast(50.5, 3.5, 1440).collect()
    assert [r.band for r in got] == ["nowcast"] * 12 + ["short"] * 10  # the band that did not tick is still there
    assert store.forecast(50.5, 3.5, 60).count() == 7
    assert store.animation("short").count() == 10
    assert store.overlay("short", 120).first().a > 0
    assert store.health(at(6))["status"] == "ok" and store.health(at(60))["status"] == "degraded"
    with pytest.raises(serving.RequestError) as e:
        store.forecast(10.0, 4.0)
    assert e.value.status == 400
    with pytest.raises(ValueError):
        store.publish(at(10), "short", cells("short", 2.0).limit(5))
    assert store.prune(keep=1) == 1 and len(store.snapshots()) == 1


def test_archive_is_verified(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("2024-0"), (F.col("id") % 3 + 1).cast("string")).alias("month"), "id")
    checks = archive.compact(rows, "month", str(tmp_path / "a"))
    assert archive.verified(checks, str(tmp_path / "a"), "month", ["month", "id"]).count() == 3
    plan = archive.month_plan(spark.createDataFrame([("a_202401",), ("b_202401",), ("c_202402",), ("none",)], "name string"), F.regexp_extract("name", r"_(\d{6})", 1), "202402")
    assert [(r.month, r.files) for r in plan.collect()] == [("202401", 2)]


def test_stream_upsert_keeps_last(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    df = spark.createDataFrame([(1, "d1", 1, "a"), (1, "d1", 2, "b"), (2, "d2", 1, "c")], "k int, day string, seq int, v string")
    df.write.parquet(source)
    run = lambda: ticks.upsert_stream(ticks.landed(spark, source, df.schema), table, str(tmp_path / "state"), ["k", "day"], "seq", "day").awaitTermination()
    run()
    spark.createDataFrame([(1, "d1", 3, "z")], df.schema).write.mode("append").parquet(source)
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(table).collect()) == [(1, "z"), (2, "c")]


def test_features(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    assert math.isnan(X.filled(df, ["v"]).first().v)
    out = X.scored(spark.range(3), lambda frames: (f.assign(id=f["id"] * 2) for f in frames), "id long")
    assert sorted(r.id for r in out.collect()) == [0, 2, 4]


def test_entry_module(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repeated_and_null_points(spark):
    raster = spark.createDataFrame([(1, y, x, 10.0) for y in range(3) for x in range(3)] + [(2, 0, 0, 1.0)], "k int, y int, x int, value double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (1, None, 0.5), (2, 0.5, 0.5), (1, 9.0, 0.0), (None, 0.5, 0.5)], "k int, fy double, fx double")
    rows = sorted(((r.k, r.fy, r.value) for r in G.bilinear(raster, points, ["k"], 3, 3).collect()), key=str)
    assert str(rows) == str(sorted([(1, 0.5, 10.0), (1, 0.5, 10.0), (1, None, None), (2, 0.5, float("nan")), (1, 9.0, float("nan")), (None, 0.5, float("nan"))], key=str))
    cells = spark.createDataFrame([(0, 7, 0.1, 0.0), (0, 5, -0.1, 0.0), (1, 9, 1.0, 1.0)], "b int, cell int, lat double, lon double")
    at = spark.createDataFrame([(0, 0.0, 0.0), (0, 0.0, 0.0), (4, 0.0, 0.0), (None, 0.0, 0.0)], "b int, lat double, lon double")
    for ring, together in ((0, 1024), (0, 1), (1, 1024)):
        got = sorted(((r.b, r.cell) for r in G.nearest_cell(at, cells, ["b"], ring=ring, together=together).collect()), key=str)
        assert got == sorted([(0, 5), (0, 5), (4, None), (None, None)], key=str)


def test_asof_tolerance_counts_fractions_of_a_second(spark):
    a = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:10.9' AS t")
    b = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS t, 1.0 AS v")
    assert [T.asof_backward(a, b, "t", [], ["v"], x).first().v for x in (10, 10.9, 11)] == [None, 1, 1]


def test_grid_blocks_do_not_change_inverse_distance(spark):
    stations = spark.createDataFrame([(1, 50.0, 3.0, 2.0), (1, 51.0, 4.0, 6.0), (1, 50.5, 3.5, None)], "k int, lat double, lon double, value double")
    grid = G.regular_grid(spark, 4, 5, 2.0, 5.0, 49.0, 52.0)
    rows = lambda most: sorted((r.y, r.x, round(r.value, 9)) for r in G.idw(stations, grid, ["k"], most_cells=most).collect())
    assert rows(10**6) == rows(3) and len(rows(3)) == 20


def test_ramp_has_the_fixed_stops(spark):
    r = spark.range(1).select(*[S.ramp_colour(F.lit(v)).alias(f"c{i}") for i, v in enumerate([0.0, 2.5, 7.5, 80.0])]).first()
    assert [tuple(x)[:3] for x in r] == [(0, 0, 0), (49, 130, 189), (253, 141, 60), (227, 26, 28)] and [x.a for x in r] == [0, 220, 220, 220]


def test_compact_can_be_repeated(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("v"), F.when(F.col("id") < 60, "2024-01").otherwise("2024-02").alias("month"))
    for _ in range(2):
        checks = archive.compact(rows, "month", str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 100
    assert archive.verified(checks, str(tmp_path / "a"), "month", ["v", "month"]).count() == 2


def payloads(spark, n=3):
    frames = [{"time": f"2024-05-01T{m // 60:02d}:{m % 60:02d}:00+00:00", "value": m / 10} for m in range(0, 120, 10)]
    body = json.dumps({"animation": {"sequence": frames}, "for": {"hourly": [{"hour": str(h), "precipQuantity": h / 4} for h in range(49)]}})
    rows = [(name, *I.PLACES[name], body) for name in list(I.PLACES)[:n]] + [("nowhere", 50.0, 5.0, "{}"), ("broken", 50.0, 5.0, "no json")]
    return spark.createDataFrame(rows, "location string, lat double, lon double, body string")


def test_worker_publishes_tensors_and_overlays(spark, tmp_path):
    store = serving.SnapshotStore(spark, str(tmp_path / "s"), serving.Grid(height=4, width=5))
    now = datetime(2024, 5, 1, 12, 3, 20)
    done = worker.run_all(store, payloads(spark), now, ["nowcast", "short", "odd"])
    assert set(done) == {"nowcast", "short"} and done["nowcast"]["snapshot"] == "2024-05-01T12-00-00Z"
    assert done["nowcast"]["max_mm_per_h"] == pytest.approx(66.0) and done["short"]["max_mm_per_h"] == pytest.approx(2.75)
    name = store.latest()
    assert name == "2024-05-01T12-00-00Z.2"  # the same five minutes: a further version with both bands
    assert store.tensors(name).where("band = 'nowcast'").count() == 12 and store.tensors(name).where("band = 'short'").count() == 10
    image, seconds = store.image("short", 180)
    assert image.startswith(b"\x89PNG") and seconds == 3590
    with pytest.raises(serving.RequestError):
        store.image("short", 185)
    meta = json.loads(store._get(f"{name}/grid.json"))
    assert meta["model_version"] == "stub-0.1" and meta["shape"] == [4, 5]

    def fails(*_):
        raise RuntimeError("down")

    bad = worker.run_all(store, payloads(spark), now, ["nowcast"], fails)
    assert isinstance(bad["nowcast"], RuntimeError) and store.latest() == name
    with pytest.raises(RuntimeError):
        worker.stand_in(payloads(spark).limit(0), serving.BANDS[0], store.grid)


def test_png_has_the_ramp(spark):
    import struct
    import zlib

    import numpy as np

    data = serving.png(np.array([[0.0, 2.5, float("nan")], [7.5, 100.0, 0.15]]))
    assert struct.unpack(">II", data[16:24]) == (3, 2)
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    lines = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(2, 13)[:, 1:].reshape(2, 3, 4)
    assert lines[0].tolist()[0] == [0] * 4 and lines[0].tolist()[1] == [49, 130, 189, 220] and lines[0].tolist()[2] == [0] * 4
    assert lines[1].tolist()[0][:3] == [253, 141, 60] and lines[1].tolist()[1] == [227, 26, 28, 220] and lines[1].tolist()[2][3] == 110


def test_aligned_store(spark, tmp_path):
    grid = G.regular_grid(spark, 2, 3, 2.0, 4.0, 50.0, 51.0)
    t = lambda m: datetime(2024, 5, 1, 12) + timedelta(minutes=m)
    radar = spark.createDataFrame([(t(i), lead, y, x, float(lead + y + x)) for i in (0, 60) for lead in (5, 0) for y in range(2) for x in range(3)], "issue_time timestamp_ntz, lead_min int, y int, x int, rate double")
    fields = "pressure double, temp_dry_shelter_avg double, humidity_rel_shelter_avg double, wind_speed_10m double"
    stations = [(t(-10), 50.1 + k / 10, 2.1 + k / 3, 1013.0 + 20 * k, 10.0 if k else None, 70.0, float("nan")) for k in range(3)] + [(t(-40), 50.5, 3.0, 1.0, 1.0, 1.0, 1.0)]
    stations = spark.createDataFrame(stations, f"timestamp timestamp_ntz, lat double, lon double, {fields}")
    satellite = spark.createDataFrame([(t(-20), y, x, 5.0) for y in range(2) for x in range(2)], "time timestamp_ntz, y int, x int, value double")
    static = training.static_channels(spark.createDataFrame([(y, x, float(y + x)) for y in range(2) for x in range(3)], "y int, x int, elevation_m double"), 1.0, 2.0)
    store = training.aligned_store(radar, stations, satellite, static, grid, (2.0, 50.0, 4.0, 51.0), (2, 2))
    for _ in range(2):
        training.write_store(store, str(tmp_path / "store"))
    rows = {(r.issue_time, r.y, r.x): r for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert len(rows) == 12
    early, late = rows[t(0), 1, 2], rows[t(60), 1, 2]
    assert early.leads == [0, 5] and early.radar == [3.0, 8.0]
    assert 0 < early.aws_pressure < 2 and early.aws_humidity == 0 and math.isnan(early.aws_temp) and math.isnan(early.aws_wind)  # three stations, two and none
    assert early.msg == 5.0 and math.isnan(late.msg) and math.isnan(late.aws_pressure)
    assert (early.elevation_m, early.landmask, early.distance_km) == (3.0, 1.0, pytest.approx(math.hypot(1, 4)))
    training.write_static(static, str(tmp_path / "static"))
    training.write_static(static.limit(0), str(tmp_path / "static"))
    assert spark.read.parquet(str(tmp_path / "static")).count() == 6


def test_feed_parameters_and_windows(spark):
    got = I.Settings.load({"SKYLATTICE_STALE_AFTER_SECONDS": "60", "SKYLATTICE_ORIGINS": "a, b,", "OTHER": "1"})
    assert (got.stale_after_seconds, got.origin_list(), got.model_version) == (60, ["a", "b"], "stub-0.1")
    assert I.between_filter("timestamp", "a", "b") == "timestamp BETWEEN 'a' AND 'b'"
    assert "bbox=49.0%2C2.0%2C51.0%2C4.0" in I.map_url("http://h/wms", "l", "2024-05-01T00:00:00Z", (2.0, 49.0, 4.0, 51.0), (4, 4))
    assert I.datasets(spark).count() == 5
    listing = spark.createDataFrame([(f"RAD_{s}.h5",) for s in ("202405010000", "202405010005", "202405010010", "202406010000")] + [("X_202405010005.h5",)], "name string").withColumn("stamp", S.stamp_time("name"))
    names = lambda c: [r.name for r in I.in_window(listing, "RAD_", "2024-05-01 00:00:00", "2024-05-01 00:10:00", c).orderBy("name").collect()]
    assert names(5) == ["RAD_202405010000.h5", "RAD_202405010005.h5", "RAD_202405010010.h5"] and names(10) == ["RAD_202405010000.h5", "RAD_202405010010.h5"]
    key = spark.range(1).select(I.seek_key("RAD_", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).alias("k")).first().k
    assert key == "RAD_202404302359"
    cells = spark.createDataFrame([([(0, 0), (0, 1)], '{"results": [{"elevation": 3.5}, {"elevation": null}]}')], "cells array<struct<y:int,x:int>>, body string")
    assert sorted(tuple(r) for r in I.elevations(cells).collect()) == [(0, 0, 3.5), (0, 1, 0.0)]
    with pytest.warns(UserWarning):
        assert tables.capped(spark.range(10), [F.col("id")], 3).count() == 3


def test_json_source_reads_with_retries(spark):
    import http.server
    import threading

    asked = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(b'{"a": 1}')

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(I.JsonHttpSource)
    rows = spark.read.format("json_http").option("urls", f"http://127.0.0.1:{server.server_port}/x").load().collect()
    server.shutdown()
    assert [(r.status, json.loads(r.body)) for r in rows] == [(200, {"a": 1})] and len(asked) >= 2


def test_late_rows_are_dropped_and_ticks_run_once(spark, tmp_path):
    schema = "ts timestamp_ntz, k string, v double"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = []

    def run():
        feed = ticks.landed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        out = ticks.tumbling(feed, "ts", "v", ["k"], "5 minutes", "10 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        out.awaitTermination()
        ticks.tick(feed, str(tmp_path / "tick"), lambda batch, n: counts.append(batch.count())).awaitTermination()

    write([(at(0), "a", 1.0), (at(60), "a", 2.0)])
    run()
    write([(at(1), "a", 9.0), (at(120), "a", 3.0)])  # the first comes an hour late
    run()
    write([(at(300), "a", 4.0)])
    run()
    rows = sorted((r.start, r.n, r.peak) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [(n, peak) for _, n, peak in rows][:2] == [(1, 1.0), (1, 2.0)] and all(peak != 9.0 for *_, peak in rows)
    assert counts == [2, 2, 1]
