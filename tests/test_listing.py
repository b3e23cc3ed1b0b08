"""Key-seek listings and landing against a local service that breaks off."""

import hashlib
import json
import os
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from skylattice.sources import listing

T0 = datetime(2024, 5, 1)
NAMES = sorted(f"RAD_{(T0 + timedelta(minutes=5 * i)).strftime('%Y%m%d%H%M')}.h5" for i in range(900)) + ["READ_ME.txt"]
BODY = {n: (n.encode() + b"\0\xff") * 20_000 for n in NAMES[:6]}


class Service(BaseHTTPRequestHandler):
    asked: list = []
    broken: set = set()
    listed = len(NAMES)

    def do_GET(self):
        url = urlparse(self.path)
        if url.path == "/files":
            q = parse_qs(url.query)
            after, size = q["startAfterFilename"][0], int(q["maxKeys"][0])
            Service.asked.append(after)
            names = [n for n in NAMES[: Service.listed] if n > after]
            body = json.dumps({"files": [{"filename": n, "size": 7} for n in names[:size]], "isTruncated": len(names) > size}).encode()
            self.send_response(200)
        else:
            whole = BODY[url.path[1:]]
            at = int(self.headers.get("Range", "bytes=0-")[6:-1])
            if at >= len(whole):
                self.send_error(416)
                return
            body = whole[at:]
            self.send_response(206 if at else 200)
            Service.asked.append((url.path[1:], at))
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if url.path[1:] in Service.broken:
            Service.broken.discard(url.path[1:])
            body = body[: len(body) // 2]
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def options(base, **more):
    return {"url": f"{base}/files", "prefix": "RAD_", "start": "202405010200", "end": "202405022300", "pageSize": "50"} | {k: str(v) for k, v in more.items()}


def wanted(start="202405010200", end="202405022300", cadence=5):
    return [n for n in NAMES[:-1] if start <= n[4:16] <= end and int(n[14:16]) % cadence == 0]


def test_batches_seek_by_day_and_stop_at_the_end(spark, base):
    spark.dataSource.register(listing.KeyListingSource)
    Service.asked.clear()
    rows = spark.read.format("key_listing").options(**options(base)).load()
    assert rows.rdd.getNumPartitions() == 2
    found = rows.collect()
    assert sorted(r.name for r in found) == wanted() and found[0].stamp == datetime(2024, 5, 1, 2)
    assert max(map(str, Service.asked)) < "RAD_20240502230"  # nothing behind the end is asked for
    slow = spark.read.format("key_listing").options(**options(base, cadence=30)).load()
    assert sorted(r.name for r in slow.collect()) == wanted(cadence=30)
    none = spark.read.format("key_listing").options(**options(base, start="203001010000", end="203001010100")).load()
    assert none.count() == 0


@pytest.mark.parametrize("pages", [0, 2])
def test_a_restarted_stream_goes_on_behind_its_last_key(spark, base, tmp_path, pages):
    spark.dataSource.register(listing.KeyListingSource)
    out = str(tmp_path / "out")

    def run():
        feed = spark.readStream.format("key_listing").options(**options(base, pages=pages)).load()
        feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.name for r in spark.read.parquet(out).collect())

    Service.listed = 300
    first = run()
    assert first == [n for n in wanted() if n in NAMES[:300]][: len(first)] and first
    Service.listed = len(NAMES)
    Service.asked.clear()
    found = run()
    assert min(a for a in Service.asked if isinstance(a, str)) >= first[-1]  # not from the start again
    for _ in range(8 if pages else 0):
        found = run()
    assert found == wanted()  # each once
    assert run() == wanted()


def rows(spark, base, names=None, digests=True):
    data = [(n, f"{base}/{n}", len(BODY[n]), hashlib.sha256(BODY[n]).hexdigest() if digests else None) for n in names or BODY]
    return spark.createDataFrame(data, "name string, url string, size long, digest string").repartition(3)


def landed(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.startswith("RAD")}


def test_files_land_once_and_broken_ones_go_on(spark, base, tmp_path):
    spark.dataSource.register(listing.LandingSource)
    folder, names = str(tmp_path / "land"), list(BODY)
    save = lambda df: df.write.format("landing").option("path", folder).mode("append").save()
    save(rows(spark, base, names[:2]))
    assert landed(folder) == {n: BODY[n] for n in names[:2]}
    Service.broken |= {names[3]}
    with pytest.raises(Exception, match="bytes came|Incomplete"):
        save(rows(spark, base))
    assert names[3] not in landed(folder) and all(BODY[n] == b for n, b in landed(folder).items())
    assert {r.name for r in listing.manifests(spark, folder).collect()} == set(names[:2])  # the failed write has no manifest
    Service.asked.clear()
    save(rows(spark, base))
    assert landed(folder) == BODY
    tries = dict(a for a in Service.asked if isinstance(a, tuple))
    assert tries[names[3]] == len(BODY[names[3]]) // 2 and names[0] not in tries  # continued, and skipped
    got = {(r.name, r.length, r.digest) for r in listing.manifests(spark, folder).collect()}
    assert got == {(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in BODY.items()}
    save(rows(spark, base))
    assert listing.manifests(spark, folder).count() == len(BODY)
    assert os.listdir(f"{folder}/_parts") == []


def test_wrong_parts_and_wrong_digests(spark, base, tmp_path):
    folder, n = str(tmp_path), next(iter(BODY))
    os.makedirs(f"{folder}/_parts")
    with open(f"{folder}/_parts/{n}~0", "wb") as f:
        f.write(b"x" * 100)  # what another version of the file left
    assert listing.land(folder, n, f"{base}/{n}", len(BODY[n]), hashlib.sha256(BODY[n]).hexdigest(), {})[1] == len(BODY[n])
    assert landed(folder) == {n: BODY[n]}
    with pytest.raises(OSError, match="digest"):
        listing.land(folder, NAMES[1], f"{base}/{NAMES[1]}", None, "0" * 64, {})
    assert NAMES[1] not in landed(folder)
    with pytest.raises(ValueError):
        listing.land(folder, "../up", f"{base}/{n}", None, None, {})
