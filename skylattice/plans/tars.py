"""Archive files that tasks write side by side, and their mirrors.

Members are sorted by name and have their places in the file (512-byte records, a header before each) before anything is
written; tasks then write theirs into one file at those places.  A task that runs again writes the same bytes at the same
place.  Index and digest stand beside the file, which gets its name by one rename when all of it is there.
Paths are of a folder that the driver and all executors have mounted.
"""

from __future__ import annotations

import hashlib
import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import fresh_path, remove, written

RECORD = 512
#: Bytes that one task of a mirror copies.
BLOCK = 64 << 20


def mounted(path: str) -> str:
    """A path of this machine's file system, also of a file: address."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path} is not in a mounted folder")
    return unquote(url.path) if url.scheme else path


def header(name: str, length: int) -> bytes:
    """A member's header records, the same ones for the same name and length."""
    info = tarfile.TarInfo(name)
    info.size, info.mtime, info.mode = length, 0, 0o644
    return info.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape")


def _placed(members: DataFrame) -> DataFrame:
    """part, at (within the part), name, length, sha256, content: sorted by name over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places, lengths, digests = [], [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places.append(at)
                lengths.append(len(content))
                digests.append(hashlib.sha256(content).hexdigest())
                at += len(header(name, len(content))) + -(-len(content) // RECORD) * RECORD
            ends = [*places[1:], at]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(batch), pa.int32()), pa.array(places, pa.int64()), pa.array(ends, pa.int64()), batch.column(0), pa.array(lengths, pa.int64()), pa.array(digests), batch.column(1)], names=["part", "at", "until", "name", "length", "sha256", "content"])

    sorted_ = members.select(F.col("name").cast("string").alias("name"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).where("name IS NOT NULL").repartitionByRange("name").sortWithinPartitions("name")
    return sorted_.mapInArrow(run, "part int, at long, until long, name string, length long, sha256 string, content binary")


def digest_of(index: DataFrame) -> str:
    """A digest of all members' names, lengths and digests, whatever their order and parts."""
    line = F.sha2(F.concat_ws("|", "name", F.col("length").cast("string"), "sha256"), 256)
    number = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)"))
    r = index.agg(F.count("*").alias("n"), *[number(1 + 15 * i).alias(f"s{i}") for i in range(4)]).first()
    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()


def write_tar(members: DataFrame, target: str) -> str:
    """An archive of the members (name, content), its index (<target>.index) and digest (<target>.digest); gives the digest.

    The same members make the same bytes.  A null content is empty, members without a name are left out, names must differ.
    A target that is there is replaced at the end in one step, digest and index before it.
    """
    spark, goal = members.sparkSession, mounted(target)
    placed = written(_placed(members), "members")
    sums = placed.groupBy("part").agg(F.max("until").alias("size"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each part
    if placed.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("two members have one name")
    base, total = {}, 0
    for r in sums:
        base[r.part] = total
        total += r.size
    part = f"{goal}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(part), exist_ok=True)
    with open(part, "wb") as out:  # two empty records, and up to a whole block of twenty
        out.truncate(-(-(total + 2 * RECORD) // (20 * RECORD)) * 20 * RECORD)
    sent = spark.sparkContext.broadcast(base)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(part, "r+b", buffering=0) as out:
            for batch in batches:
                starts = []
                for in_part, at, name, content in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "name", "content")), strict=True):
                    head = header(name, len(content))
                    os.pwrite(out.fileno(), head, sent.value[in_part] + at)
                    view, done = memoryview(content), 0
                    while done < len(view):
                        done += os.pwrite(out.fileno(), view[done:], sent.value[in_part] + at + len(head) + done)
                    starts.append(sent.value[in_part] + at + len(head))
                yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(starts, pa.int64()), batch.column("length"), batch.column("sha256")], names=["name", "offset", "length", "sha256"])
            os.fsync(out.fileno())

    index = fresh_path(spark, "index")
    placed.mapInArrow(put, "name string, offset long, length long, sha256 string").write.parquet(index)
    found = spark.read.parquet(index)
    digest = digest_of(found)
    bad = unlike(found, part)
    if bad.limit(1).count():
        os.remove(part)
        raise OSError("what was written is not what was meant")
    folder = f"{goal}.index-{digest[:16]}"
    found.write.mode("overwrite").parquet(_address(folder))
    _put(f"{goal}.digest", json.dumps({"digest": digest, "index": os.path.basename(folder), "bytes": os.path.getsize(part)}))
    os.replace(part, goal)
    remove(spark, index)
    return digest


def _address(path: str) -> str:
    return f"file://{path}"


def _put(path: str, text: str) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)


def read_index(spark: SparkSession, archive: str) -> DataFrame:
    """name, offset, length, sha256 of an archive's members."""
    goal = mounted(archive)
    with open(f"{goal}.digest") as f:
        place = json.load(f)["index"]
    return spark.read.parquet(_address(f"{os.path.dirname(goal)}/{place}"))


def contents(index: DataFrame, archive: str) -> DataFrame:
    """The index with each member's content, read at its place."""
    goal = mounted(archive)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(goal, "rb", buffering=0) as f:
            for batch in batches:
                held = [_read(f.fileno(), k, at) for at, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])

    return index.select("name", "offset", "length", "sha256").mapInArrow(get, "name string, offset long, length long, sha256 string, content binary")


def _read(file: int, size: int, at: int) -> bytes:
    parts = []
    while size > 0 and (got := os.pread(file, size, at)):
        parts.append(got)
        size, at = size - len(got), at + len(got)
    return b"".join(parts)


def unlike(index: DataFrame, archive: str) -> DataFrame:
    """Members whose bytes in the archive are not those of the index."""
    return contents(index, archive).where(F.sha2("content", 256) != F.col("sha256")).drop("content")


def mirror(spark: SparkSession, source: str, target: str) -> bool:
    """Brings the target to the source's state; False if it has the digest already.

    Blocks are copied side by side beside the target; it gets its name when every member of the copy has its digest.
    """
    here, there = mounted(source), mounted(target)
    with open(f"{here}.digest") as f:
        wanted = json.load(f)
    if os.path.exists(there) and os.path.exists(f"{there}.digest"):
        with open(f"{there}.digest") as f:
            if json.load(f) == wanted and os.path.getsize(there) == wanted["bytes"]:
                return False
    index = read_index(spark, source)
    os.makedirs(os.path.dirname(there), exist_ok=True)
    part, size = f"{there}.{uuid.uuid4().hex}.part", wanted["bytes"]
    with open(part, "wb") as out:
        out.truncate(size)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(here, "rb", buffering=0) as src, open(part, "r+b", buffering=0) as out:
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    at, end = n * BLOCK, min(size, (n + 1) * BLOCK)
                    while at < end:
                        at += os.pwrite(out.fileno(), _read(src.fileno(), min(1 << 20, end - at), at), at)
                yield batch
            os.fsync(out.fileno())

    blocks = -(-size // BLOCK)
    spark.range(0, blocks, 1, min(blocks, 10_000)).mapInArrow(copy, "id long").count()
    try:
        if unlike(index, part).limit(1).count():
            raise OSError(f"the copy of {source} is not like it")
        if digest_of(index) != wanted["digest"]:
            raise OSError(f"the index of {source} is not the one of its digest")
        index.write.mode("overwrite").parquet(_address(f"{os.path.dirname(there)}/{wanted['index']}"))
        _put(f"{there}.digest", json.dumps(wanted))
        os.replace(part, there)
    except BaseException:
        os.remove(part)
        raise
    return True


def month_tars(members: DataFrame, month: Column, current: str, folder: str, *, dry_run: bool = False) -> dict[str, int]:
    """An archive <folder>/<month>.tar for each completed month that has none, and how many members it has (would have, with ``dry_run``)."""
    named = members.withColumn("_month", month).where((F.col("_month") != "") & (F.col("_month") < current))
    todo = {r["_month"]: r["count"] for r in named.groupBy("_month").count().collect() if not os.path.exists(f"{mounted(folder)}/{r['_month']}.tar")}  # a row for each month
    for m in [] if dry_run else sorted(todo):
        write_tar(named.where(F.col("_month") == m).select("name", "content"), f"{folder}/{m}.tar")
    return dict(sorted(todo.items()))
