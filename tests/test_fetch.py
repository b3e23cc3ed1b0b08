"""Fetchers against a local service with signatures, limits and caps."""

import hashlib
import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators.grids import regular_grid
from skylattice.sources import fetch, ingest, listing, rasters

from test_rasters import tiff

T0 = datetime(2024, 5, 1)
STATIONS = [(T0 + timedelta(minutes=10 * i), code) for i in range(100) for code in range(3)]
IMAGE = tiff(np.arange(20, dtype="u2").reshape(4, 5, 1))


class Service(BaseHTTPRequestHandler):
    busy = 2
    spans: list = []

    def do_GET(self):
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        status, body = 200, b""
        if url.path == "/forecast":
            good = hashlib.md5(f"salt;{q['s']};01/05/2024".encode()).hexdigest()
            status, body = (200, json.dumps({"at": [q["lat"], q["long"]]}).encode()) if q["k"] == good else (403, b"no")
        elif url.path == "/wfs":
            assert "%3A" not in url.query.partition("cql_filter=")[2]
            low, high = (datetime.fromisoformat(x).replace(tzinfo=None) for x in q["cql_filter"].split("'")[1::2])
            Service.spans.append((low, high))
            found = [{"geometry": {"coordinates": [4.0, 50.0 + c]}, "properties": {"timestamp": t.isoformat() + "Z", "code": c, "pressure": 1000 + c}} for t, c in STATIONS if low <= t <= high]
            body = json.dumps({"features": found[: int(q["count"])]}).encode()
        elif url.path == "/topo":
            if Service.busy:
                Service.busy -= 1
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            body = json.dumps({"results": [{"elevation": None if i % 7 == 0 else float(p.split(",")[0])} for i, p in enumerate(q["locations"].split("|"))]}).encode()
        elif url.path == "/wms":
            assert q["bbox"] == "48.0,1.0,52.0,7.0" and q["time"].endswith("Z")
            body = IMAGE if q["time"] != "2024-05-01T00:30:00.000Z" else b"<error/>"
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_forecasts_are_signed_for_the_day(spark, base):
    places = ingest.places(spark)
    rows = fetch.polled(places, f"{base}/forecast", "salt", datetime(2024, 5, 1, 12)).collect()
    assert len(rows) == 8 and {r.location: json.loads(r.body)["at"] for r in rows}["ghent"] == ["51.054300", "3.717400"]
    assert fetch.polled(places, f"{base}/forecast", "salt", datetime(2024, 5, 2, 12)).count() == 0
    answers = fetch.fetched(fetch.forecast_requests(places, f"{base}/forecast", "other", F.lit("2024-05-01").cast("date")))
    assert {r.status for r in answers.collect()} == {403}
    lost = fetch.fetched(spark.createDataFrame([("http://127.0.0.1:9/x",), ("nothing",)], "url string")).collect()
    assert all(r.status is None and r.content is None and r.error for r in lost)


@pytest.mark.parametrize("count, hours", [(10_000, 24), (50, 24), (4, 5)])
def test_features_beyond_the_cap_are_asked_for_in_halves(spark, base, count, hours):
    spark.dataSource.register(fetch.FeatureSource)
    load = lambda **o: spark.read.format("wfs_features").options(url=f"{base}/wfs", typename="aws", start="2024-05-01T00:00:00", end="2024-05-01T16:30:00", count=count, hours=hours, **o).load()
    rows = ingest.station_rows(load()).select("code", "timestamp", "pressure").collect()
    assert sorted((r.code, r.timestamp.replace(tzinfo=None)) for r in rows) == sorted((c, t) for t, c in STATIONS) and all(r.pressure == 1000 + r.code for r in rows)
    with pytest.raises(Exception, match="ask for more at once"):
        spark.read.format("wfs_features").options(url=f"{base}/wfs", typename="aws", start="2024-05-01T00:00:00", end="2024-05-01T01:00:00", count=3).load().collect()


def test_bounds_on_the_time_reach_the_service(spark, base):
    spark.dataSource.register(fetch.FeatureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        Service.spans.clear()
        rows = spark.read.format("wfs_features").options(url=f"{base}/wfs", typename="aws", start="2024-05-01T00:00:00", end="2024-05-01T16:30:00", pushdown="true").load()
        at = lambda h: F.lit(f"2024-05-01 {h:02d}:00:00").cast("timestamp_ntz")
        assert rows.where((F.col("timestamp") > at(3)) & (F.col("timestamp") <= at(5))).count() == 36
        assert min(a for a, _ in Service.spans) == datetime(2024, 5, 1, 3) and max(b for _, b in Service.spans) == datetime(2024, 5, 1, 5)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_elevations_wait_when_the_service_is_busy(spark, base):
    grid = regular_grid(spark, 5, 30, 1.5, 7.5, 48.9, 52.5)
    Service.busy = 2
    answers = fetch.elevation_answers(ingest.elevation_requests(grid, 30), f"{base}/topo", pause=0.0)
    got = {(r.y, r.x): r.elevation_m for r in ingest.elevations(answers).collect()}
    want = {(r.y, r.x): 0.0 if (r.y * 30 + r.x) % 100 % 7 == 0 else round(r.lat, 6) for r in grid.collect()}
    assert got == pytest.approx(want)
    with pytest.raises(Exception, match="no elevations"):
        ingest.elevations(fetch.elevation_answers(ingest.elevation_requests(grid, 30), f"{base}/forecast?s=x&k=y", pause=0.0)).collect()


def test_map_images_land_and_are_read(spark, base, tmp_path):
    spark.dataSource.register(listing.LandingSource)
    times = spark.createDataFrame([(T0 + timedelta(minutes=15 * i),) for i in range(4)], "time timestamp_ntz")
    asked = fetch.map_requests(times, f"{base}/wms", "msg:ir108", (1.0, 48.0, 7.0, 52.0), (5, 4))
    asked.select("name", "url", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("digest")).write.format("landing").option("path", str(tmp_path)).mode("append").save()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(str(tmp_path))
    got = {r.path.rpartition("/")[2]: r["values"] for r in rasters.rasters(files).collect()}
    assert set(got) == {f"msg_ir108_20240501T00{m:02d}00Z.tif" for m in (0, 15, 30, 45)}
    assert got.pop("msg_ir108_20240501T003000Z.tif") is None and all(v == [float(i) for i in range(20)] for v in got.values())
