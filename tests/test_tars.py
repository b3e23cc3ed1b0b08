"""Archives against the standard library's reader, repetition, broken copies."""

import hashlib
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.plans import tars


@pytest.fixture()
def members(spark):
    rng = np.random.default_rng(7)
    rows = [(f"dir/file{i:04d}.bin", rng.bytes(int(rng.integers(0, 3000)))) for i in range(200)] + [("x" * 300 + ".txt", b"long name"), ("empty", None), ("naïve é", b"\0" * 512), (None, b"lost")]
    return spark.createDataFrame(rows, "name string, content binary").repartition(7), {n: c or b"" for n, c in rows if n}


def test_the_standard_reader_finds_every_member(spark, members, tmp_path):
    df, want = members
    path = str(tmp_path / "a" / "one.tar")
    digest = tars.write_tar(df, path)
    with tarfile.open(path) as t:
        assert {m.name: t.extractfile(m).read() for m in t.getmembers()} == want
        assert [m.name for m in t.getmembers()] == sorted(want, key=lambda n: n.encode())
    got = {r.name: (bytes(r.content), r.sha256) for r in tars.contents(tars.read_index(spark, path), path).collect()}
    assert got == {n: (c, hashlib.sha256(c).hexdigest()) for n, c in want.items()}
    first = open(path, "rb").read()
    assert len(first) % 10240 == 0
    assert tars.write_tar(df.repartition(3), path) == digest and open(path, "rb").read() == first
    assert not [n for n in os.listdir(tmp_path / "a") if n.endswith(".part")]
    with pytest.raises(ValueError):
        tars.write_tar(df.unionByName(df.limit(1).where("name IS NOT NULL")), path)
    with pytest.raises(ValueError):
        tars.write_tar(df, "hdfs://host/one.tar")
    assert open(path, "rb").read() == first


def test_empty_archives(spark, members, tmp_path):
    path = str(tmp_path / "none.tar")
    tars.write_tar(members[0].limit(0), path)
    with tarfile.open(path) as t:
        assert t.getmembers() == []


def test_mirrors_are_checked_before_they_get_their_name(spark, members, tmp_path, monkeypatch):
    monkeypatch.setattr(tars, "BLOCK", 10_000)
    here, there = str(tmp_path / "one.tar"), str(tmp_path / "nas" / "one.tar")
    tars.write_tar(members[0], here)
    assert tars.mirror(spark, here, there) is True
    assert open(there, "rb").read() == open(here, "rb").read()
    assert tars.mirror(spark, here, there) is False
    good = open(there, "rb").read()
    tars.write_tar(members[0].where("name <> 'empty'"), here)
    with open(here, "r+b") as f:  # the source decays
        f.seek(5000)
        f.write(b"?" * 600)
    with pytest.raises(OSError):
        tars.mirror(spark, here, there)
    assert open(there, "rb").read() == good and not [n for n in os.listdir(tmp_path / "nas") if n.endswith(".part")]
    tars.write_tar(members[0].where("name <> 'empty'"), here)
    assert tars.mirror(spark, here, there) is True and open(there, "rb").read() == open(here, "rb").read()


def test_months_are_archived_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"RAD_20240{m}{d:02d}0000.h5", b"x" * d) for m in (1, 2, 3) for d in range(1, 10)], "name string, content binary")
    month = F.regexp_extract("name", r"_(\d{6})", 1)
    folder = str(tmp_path)
    assert tars.month_tars(rows, month, "202403", folder, dry_run=True) == {"202401": 9, "202402": 9} and os.listdir(folder) == []
    assert tars.month_tars(rows, month, "202403", folder) == {"202401": 9, "202402": 9}
    assert tars.month_tars(rows, month, "202403", folder) == {}
    assert tars.read_index(spark, f"{folder}/202402.tar").count() == 9
