"""Streams as of time, snapshots of several writers, searches, mergeable measures and caches."""

import json
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import grids as G
from skylattice.operators import tables as B
from skylattice.operators import temporal as T
from skylattice.operators import verification as V
from skylattice.plans import caches, serving, worker
from skylattice.plans.catalog_feeds import _ROCKS, _STORE
from skylattice.streaming import ticks
from skylattice.streaming.asof import asof_stream

T0 = datetime(2024, 5, 1)
EVENTS = "id int, k string, t timestamp_ntz, side string, v double"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


# ---- streaming as-of


def stream(spark, tmp_path, batches, tolerance=600, late="0 seconds", keys=("k",)):
    """Result rows and, after each batch, how many rows the state holds."""
    spark.conf.set(_STORE, _ROCKS)
    place, held = str(tmp_path), []
    schema = spark.createDataFrame([], EVENTS).schema
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{place}/in")
        feed = ticks.landed(spark, f"{place}/in", schema)
        left, right = feed.where("side = 'l'").select("id", "k", "t"), feed.where("side = 'r'").select("k", "t", "v")
        out = asof_stream(left, right, "t", list(keys), ["v"], tolerance, late)
        run = out.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"] if run.lastProgress else None)
    return {r.id: (r.right_t, r.v) for r in spark.read.schema(out.schema).parquet(f"{place}/out").collect()}, held


def clock(minutes):
    return (None, "clock", at(minutes), "l", None)


def test_stream_equals_batch_on_out_of_order_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, ["a", "b", None][int(rng.integers(0, 3))], at(int(rng.integers(0, 200)) / 2), "lr"[int(rng.integers(0, 2))], float(rng.integers(0, 5))) for i in range(400)]
    rows.sort(key=lambda r: r[2] + timedelta(minutes=float(rng.integers(0, 9))))
    got, _ = stream(spark, tmp_path, [rows[:150], rows[150:300], rows[300:], [clock(300)]], late="20 minutes")
    df = spark.createDataFrame(rows, EVENTS)
    want = T.asof_backward(df.where("side = 'l'").select("id", "k", "t"), df.where("side = 'r'").select("k", "t", "v"), "t", ["k"], ["v"], 600)
    got.pop(None, None)
    assert got == {r.id: (r.right_t, r.v) for r in want.collect()}
    assert all(v is None for i, (_, v) in got.items() if rows[[r[0] for r in rows].index(i)][1] is None)


def test_stale_rows_leave_the_state_and_late_ones_are_dropped(spark, tmp_path):
    first = [(1, "a", at(5), "l", None), (0, "a", at(0), "r", 1.0), (0, "a", at(3), "r", 2.0), (0, "a", at(3), "r", 7.0), (0, "b", at(1), "r", 9.0), clock(30)]
    second = [(2, "a", at(6), "l", None), (3, "a", at(40), "l", None), (0, "a", at(41), "r", 3.0), (4, "a", at(41), "l", None), clock(200)]
    got, held = stream(spark, tmp_path, [first, second, [clock(300)]])
    assert got[1] == (at(3), 7.0)  # the greatest of equal times
    assert 2 not in got  # it came after the watermark had passed it
    assert got[3] == (None, None) and got[4] == (at(41), 3.0)  # past the tolerance, and at the same time
    assert held[-1] <= 2  # nothing but the clock's own row


# ---- snapshots


def cells(spark, band, rate, n=10):
    leads = next(b for b in serving.BANDS if b.name == band).leads()
    k = F.col("id")
    return spark.range(len(leads) * n * n).select(F.element_at(F.array(*[F.lit(x) for x in leads]), (F.floor(k / (n * n)) + 1).cast("int")).alias("lead_min"), F.floor(k % (n * n) / n).cast("int").alias("y"), (k % n).cast("int").alias("x"), F.lit(rate).alias("rate"))


def test_bands_that_publish_side_by_side_all_show(spark, tmp_path):
    store = serving.SnapshotStore(spark, str(tmp_path / "s"), serving.Grid(height=10, width=10))
    errors, names = [], []

    def one(band, rate):
        try:
            names.append(store.publish(at(1), band, cells(spark, band, rate), bucket_seconds=300))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=one, args=(b.name, float(i + 1))) for i, b in enumerate(serving.BANDS)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(set(names)) == 4 and set(names) == set(store.snapshots())
    rates = {r.band: (r.n, r.v) for r in store.points(store.latest()).groupBy("band").agg(F.count("*").alias("n"), F.max("rate").alias("v")).collect()}
    assert rates == {b.name: (len(b.leads()) * 100, float(i + 1)) for i, b in enumerate(serving.BANDS)}
    assert store.images(store.latest()).count() == 106 and store.tensors(store.latest()).count() == 106


def test_a_commit_that_is_taken_is_tried_again(spark, tmp_path):
    store = serving.SnapshotStore(spark, str(tmp_path / "s"))
    names = [store._append("b", "nowcast", f"data/{i}", {}, {}) for i in range(3)]
    assert names == ["b", "b.2", "b.3"]
    assert not store._create("commits/000000000002.json", "{}")  # never written over
    assert store._commit(2)["bands"] == {"nowcast": "data/1"}
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append(store._append("c", f"band{i}", f"data/c{i}", {}, {}))) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(made)) == 12 and len(store.snapshots()) == 15
    assert store._newest_commit()[1]["bands"] == {"nowcast": "data/2"} | {f"band{i}": f"data/c{i}" for i in range(12)}


def test_prune_counts_buckets_and_orders_versions_as_numbers(spark, tmp_path):
    store = serving.SnapshotStore(spark, str(tmp_path / "s"))
    for bucket in ("2024-05-01T12-00-00Z", "2024-05-01T12-05-00Z"):
        for i in range(11):
            store._append(bucket, "nowcast", f"data/{bucket}-{i}", {}, {})
    assert store.prune(3) == 10  # of the older bucket its last version stays
    left = store.snapshots()
    assert left[0] == "2024-05-01T12-00-00Z.11" and len(left) == 12 and store.latest() == "2024-05-01T12-05-00Z.11"
    assert store.prune(1) == 1 and store.prune(0) == 10 and store.snapshots() == ["2024-05-01T12-05-00Z.11"]


def test_the_model_runs_once_and_failures_leave_nothing(spark, tmp_path):
    store = serving.SnapshotStore(spark, str(tmp_path / "s"), serving.Grid(height=4, width=4))
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    df = cells(spark, "nowcast", 1.0, 4)
    store.publish(T0, "nowcast", df.mapInArrow(counted, df.schema))
    assert runs.value == df.count()
    with pytest.raises(ValueError):
        store.publish(at(9), "nowcast", df.where("y > 0"))
    with pytest.raises(ValueError):
        store.publish(at(9), "nowcast", df.unionByName(df.limit(1)))
    assert len(store.snapshots()) == 1 and len(list((tmp_path / "s" / "data").iterdir())) == 1
    assert json.loads(store._get(f"{store.latest()}/grid.json"))["shape"] == [4, 4]


def test_of_a_places_polls_the_newest_counts(spark):
    polls = spark.createDataFrame([("a", 1.0, 2.0, at(0), "old"), ("a", 1.0, 2.0, at(9), "new"), ("b", 3.0, 4.0, at(1), "one")], "location string, lat double, lon double, poll_ts timestamp_ntz, body string")
    assert sorted((r.location, r.body) for r in worker.newest_polls(polls).collect()) == [("a", "new"), ("b", "one")]


# ---- joins and searches


def test_null_keys_meet_nothing(spark):
    left = spark.createDataFrame([(1, None, at(5)), (2, "a", at(5))], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([(None, at(1), 1), ("a", at(1), 2)], "k string, t timestamp_ntz, v int")
    assert {r.id: r.v for r in T.asof_backward(left, right, "t", ["k"], ["v"]).collect()} == {1: None, 2: 2}
    assert {r.id: r.nearest_v for r in T.nearest_in_time(left, right, "t", ["k"], "v").collect()} == {2: 2}


@pytest.mark.parametrize("bucket", [None, 60, 600, 10**6])
def test_nearest_in_buckets_is_brute_force(spark, bucket):
    rng = np.random.default_rng(9)
    right = [(["a", "b"][int(k)], int(m)) for k, m in zip(rng.integers(0, 2, 60), rng.integers(0, 300, 60), strict=True)]
    left = [(i, ["a", "b", "c", None][int(rng.integers(0, 4))], int(rng.integers(-50, 350))) for i in range(120)]
    a = spark.createDataFrame([(i, k, at(m)) for i, k, m in left], "id int, k string, t timestamp_ntz")
    b = spark.createDataFrame([(k, p, at(m)) for p, (k, m) in enumerate(right)] + [(None, 99, at(1))], "k string, p int, t timestamp_ntz")
    got = {r.id: r.nearest_p for r in T.nearest_in_time(a, b, "t", ["k"], "p", bucket_seconds=bucket).collect()}
    for i, k, m in left:
        near = [(abs(m - n), p) for p, (kk, n) in enumerate(right) if kk == k]
        assert got.get(i) == (min(near)[1] if near else None)


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("radius", [0, 1, 4, 13])
def test_pooling_is_brute_force(spark, wrap, radius):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 50, (2, 5, 6)).astype(float)
    df = spark.createDataFrame([(k, y, x, float(grid[k, y, x])) for k in range(2) for y in range(5) for x in range(6)], "k int, y int, x int, value double")
    got = {(r.k, r.y, r.x): r.value for r in G.max_pool(df, ["k"], 5, 6, radius, wrap).collect()}
    around = range(-radius, radius + 1)
    for k, y, x in np.ndindex(2, 5, 6):
        assert got[k, y, x] == max(grid[k, (y + i) % 5, (x + j) % 6] for i in around for j in around if wrap or (0 <= y + i < 5 and 0 <= x + j < 6))


def test_lower_envelope_is_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        x = np.sort(rng.choice(200, n, replace=False)).astype(float)
        h = np.where(rng.random(n) < 0.4, np.inf, rng.integers(0, 400, n).astype(float))
        at_ = G.lower_envelope(x, h)
        cost = (x[:, None] - x[None]) ** 2 + h[None]
        if np.isinf(h).all():
            assert (at_ == -1).all()
        else:
            assert np.allclose(cost[np.arange(n), at_], cost.min(1))


@pytest.mark.parametrize("step", [0.05, 1.0, 40.0])
def test_nearest_anywhere_is_brute_force(spark, step):
    rng = np.random.default_rng(2)
    cells_ = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(0, 30, (60, 2)) / 10)] + [(60, 9.0, 9.0), (61, 9.0, 9.0), (62, None, 1.0)]
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(np.concatenate([rng.integers(-20, 120, (150, 2)) / 10, [[500.0, -300.0]]]))] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, 1.0), (902, 1.0, 1.0)]
    got = G.nearest_anywhere(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(cells_, "cell int, lat double, lon double"), step=step, together=5).collect()
    assert len(got) == len(points)
    for r in got:
        if r.id in (900, 901):
            assert r.cell is None and r.d2 is None
            continue
        d2, cell = min(((r.lat - y) ** 2 + (r.lon - x) ** 2, c) for c, y, x in cells_ if y is not None)
        assert r.d2 == pytest.approx(d2, abs=1e-12) and (r.cell == cell or r.d2 == pytest.approx((r.lat - cells_[r.cell][1]) ** 2 + (r.lon - cells_[r.cell][2]) ** 2, abs=1e-12))


def test_nearest_without_cells_or_points(spark):
    none = spark.createDataFrame([], "cell int, lat double, lon double")
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lat double, lon double")
    assert [(r.id, r.cell, r.d2) for r in G.nearest_anywhere(points, none).collect()] == [(1, None, None)]
    assert G.nearest_anywhere(points.limit(0), spark.createDataFrame([(1, 2.0, 3.0)], none.schema)).count() == 0


def test_pages_by_key_meet_every_row_once(spark):
    rows = spark.createDataFrame([(i // 7, i % 7, i) for i in range(40)] + [(None, 1, 99)], "a int, b int, v int")
    seen, after = [], None
    while found := B.page_after(rows, ["a", "b"], after, 6).collect():
        seen += [r.v for r in found]
        after = [F.lit(found[-1].a), F.lit(found[-1].b)]
    assert seen == list(range(40))


def test_samples_are_cut_in_tasks(spark):
    df = spark.range(200_000).select((F.col("id") % 3).cast("int").alias("g"), "id", F.when(F.col("id") % 2 == 0, "x").alias("s"))
    got = V.sampled(df, 50, ["g"], ["id"])
    want = df.withColumn("h", F.md5(F.concat_ws("|", F.lit("0"), F.col("id").cast("string")).cast("binary"))).orderBy("h", "id")
    for g in range(3):
        assert sorted(r.id for r in got.where(f"g = {g}").collect()) == sorted(r.id for r in want.where(f"g = {g}").limit(50).collect())
    assert sorted(r.id for r in V.sampled(df, 70, [], ["id"]).collect()) == sorted(r.id for r in want.limit(70).collect())
    assert V.sampled(df, 500, ["s", "g"], ["id"]).groupBy("s", "g").count().agg(F.max("count"), F.min("count"), F.count("*")).first()[:] == (500, 500, 6)
    assert V.sampled(df, 2, ["id"], ["id"]).count() == 200_000  # many groups
    assert V.sampled(df.limit(0), 5, [], ["id"]).count() == 0


# ---- measures that add up, and caches


def test_added_runs_equal_the_full_pass(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(at(1440 * (i % 3) + 5 * (i % 7)), int(i % 4) * 5, i % 3, i % 5, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for i in range(600)]
    pairs = spark.createDataFrame(rows, "issue_time timestamp_ntz, lead_min int, y int, x int, forecast double, observed double")
    path = str(tmp_path / "runs")
    V.add_runs(spark, pairs.where(F.col("issue_time") < at(1440)).withColumn("forecast", F.lit(99.0)), [2, 5], path)  # to be replaced
    V.add_runs(spark, pairs.where(F.col("issue_time") >= at(1440)), [2, 5], path)
    kept = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "runs" / "day=2024-05-02").iterdir()}
    V.add_runs(spark, pairs.where(F.col("issue_time") < at(1440)), [2, 5], path)
    assert kept == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "runs" / "day=2024-05-02").iterdir()}  # other days are not touched
    states = V.stored_states(spark, path)
    assert states.count() == pairs.select("issue_time", "lead_min").distinct().count()
    full = {r.lead_min: r for r in V.continuous(pairs).collect()}
    for r in V.merged_continuous(states).collect():
        assert r.n == full[r.lead_min].n and all(abs(r[c] - full[r.lead_min][c]) < 1e-9 for c in ("mae", "rmse", "bias"))
    assert sorted(map(str, V.merged_categorical(states).select(*V.categorical_sweep(pairs, [2, 5]).columns).collect())) == sorted(map(str, V.categorical_sweep(pairs, [2, 5]).collect()))


def test_only_changed_partitions_are_made_again(spark, tmp_path):
    path, made = str(tmp_path / "cache"), []

    def make(a, b):
        made.append(sorted(r.d for r in a.select("d").distinct().collect()))
        return a.join(b, "d", "left").groupBy("d").agg(F.sum("v").alias("v"), F.max("w").alias("w")).where("v > 0")

    a = spark.createDataFrame([("01", 1), ("01", 2), ("02", 3), ("03", 4)], "d string, v int")
    b = spark.createDataFrame([("01", 10), ("02", 20)], "d string, w int")
    held = lambda: sorted((r.d, r.v, r.w) for r in caches.read(spark, path).collect())
    assert caches.refresh(make, {"a": a, "b": b}, "d", path) == ["01", "02", "03"]
    first = held()
    assert first == [("01", 3, 10), ("02", 3, 20), ("03", 4, None)]
    assert caches.refresh(make, {"a": a.repartition(7), "b": b}, "d", path) == [] and held() == first  # the order of rows is nothing
    b2 = spark.createDataFrame([("01", 10), ("02", 21)], "d string, w int")
    assert caches.refresh(make, {"a": a, "b": b2}, "d", path) == ["02"] and made[-1] == ["02"]
    assert held() == [("01", 3, 10), ("02", 3, 21), ("03", 4, None)]
    gone = a.where("d <> '03'").withColumn("v", F.when(F.col("d") == "01", -1).otherwise(F.col("v")))
    assert caches.refresh(make, {"a": gone, "b": b2}, "d", path) == ["01"]
    assert held() == [("02", 3, 21)]  # one has no input any more, one has no rows any more
    assert caches.refresh(make, {"a": gone, "b": b2}, "d", path, version="2") == ["01", "02"]


def test_one_changed_day_rewrites_one_day_of_the_training_store(spark, tmp_path):
    from skylattice.plans import training

    grid, path = G.regular_grid(spark, 2, 3, 2.0, 4.0, 50.0, 51.0), str(tmp_path / "store")
    days = [0, 1440, 2880]
    radar = spark.createDataFrame([(at(d + m), lead, y, x, float(lead + y + x)) for d in days for m in (5, 700) for lead in (0, 5) for y in range(2) for x in range(3)], "issue_time timestamp_ntz, lead_min int, y int, x int, rate double")
    fields = "timestamp timestamp_ntz, lat double, lon double, pressure double, temp_dry_shelter_avg double, humidity_rel_shelter_avg double, wind_speed_10m double"

    def stations(odd=None):
        rows = [(at(d + m), 50.1 + k / 10, 2.1 + k / 3, 1000.0 + k + (9 if (d, m) == odd else 0), 10.0 + k, 70.0, 4.0) for d in days for m in (690, 1435) for k in range(3)]
        return spark.createDataFrame(rows, fields)

    satellite = spark.createDataFrame([(at(d + 680), y, x, float(d)) for d in days for y in range(2) for x in range(2)], "time timestamp_ntz, y int, x int, value double")
    static = training.static_channels(spark.createDataFrame([(y, x, float(y + x)) for y in range(2) for x in range(3)], "y int, x int, elevation_m double"), 1.0, 2.0)
    rest = (grid, (2.0, 50.0, 4.0, 51.0), (2, 2))
    run = lambda s, st=static: training.refresh_store(radar, s, satellite, st, *rest, path)
    named = ["2024-05-01", "2024-05-02", "2024-05-03"]

    def equal(s, st=static):
        want = training.aligned_store(radar, s, satellite, st, *rest).withColumn("date", F.col("date").cast("string"))
        got = caches.read(spark, path).select(want.columns)
        text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
        return text(got) == text(want)

    made = run(stations())
    assert set(named) <= set(made) and equal(stations())
    assert run(stations()) == []
    assert run(stations(odd=(1440, 690))) == ["2024-05-02"] and equal(stations(odd=(1440, 690)))
    late = stations(odd=(0, 1435))  # just before midnight: two days depend on it, and the second day's own change is undone
    assert run(late) == named[:2] and equal(late)
    other = static.withColumn("elevation_m", F.col("elevation_m") + 1)
    assert set(named) <= set(run(late, other)) and equal(late, other)
