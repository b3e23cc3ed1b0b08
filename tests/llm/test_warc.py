"""Archives written and read back; version lines inside payloads; split files."""

import base64
import hashlib

import pytest

from skylattice.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_round_trip(spark, tmp_path, small_splits):
    rows = [(1, "http://a b", "plain"), (2, "u", FAKE + "x"), (3, None, FAKE * 80 + "tail"), (4, "u", "plain"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n" * 400), (8, "u", "é" * 9000), (None, "u", "only null"), (None, "u", "plain"), (9, "u", "WARC/WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + i, "u", FAKE + str(i)) for i in range(30)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(d, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    got = warc.page_records(records).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for i, _, html in rows:
        if i is not None:
            data = (html or "").encode()
            assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), digest(data))
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {4: 1, 6: 5}
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    assert by[1].uri == "http://a%20b"


def test_junk_before_and_after_the_chain(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (folder / "a.warc").write_bytes(good + b"oops" + good)  # the chain breaks after the first record
    (folder / "b.warc").write_bytes(b"oops" + good)  # nothing starts at the start
    (folder / "c.warc").write_bytes(good + good[:-20])  # cut short
    rows = [(r.file[-6:], r.offset, r.payload_digest) for r in warc.read_archives(spark, str(folder)).collect()]
    assert sorted(rows) == [("a.warc", 0, digest(b"abc")), ("c.warc", 0, digest(b"abc"))]


def test_small_payloads_may_stay_responses(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_archives(d, str(tmp_path / "w"), least_bytes=3)
    got = {r.page_id: r.record_type for r in warc.page_records(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    warc.write_archives(d.limit(0), str(tmp_path / "empty"))
    assert warc.page_records(warc.read_archives(spark, str(tmp_path / "empty"))).count() == 0


def test_long_urls_break_no_chain(spark, tmp_path, small_splits):
    """Headers of any length, also with version words inside, and the records and revisits after them."""
    urls = ["u", "data:," + "x" * 100_000, "http://h/?q=" + "WARC/1.1" * 20_000 + "x", "v", "é" * 70_000, "w", "w"]
    rows = [(i, u, f"page {i % 5}") for i, u in enumerate(urls)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(d, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.page_records(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert {i: (r.uri, r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (u, len(h), digest(h.encode())) for i, u, h in rows}
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 0, 6: 1}
