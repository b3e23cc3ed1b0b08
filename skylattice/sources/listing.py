"""Listings walked by key, and files landed exactly once."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from re import search
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAMP = "%Y%m%d%H%M"


def polite_open(url: str, headers: dict[str, str], tries: int = 4):
    """An open answer; waits when the service's allowance runs out, and tries again after 429, 5xx and broken lines."""
    for turn in range(tries):
        try:
            answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=120)  # noqa: S310
            left, reset = answer.headers.get("X-RateLimit-Remaining", ""), answer.headers.get("X-RateLimit-Reset", "")
            if left.isdigit() and reset.isdigit() and int(left) <= 5:
                time.sleep(min(3700.0, max(0.0, int(reset) - time.time() + 2)))
            return answer
        except urllib.error.HTTPError as error:
            if turn == tries - 1 or not (error.code == 429 or error.code >= 500):
                raise
            wait = error.headers.get("Retry-After", "")
            time.sleep(min(3700.0, float(wait)) if wait.isdigit() else 0.25 * 2**turn)
        except OSError:
            if turn == tries - 1:
                raise
            time.sleep(0.25 * 2**turn)
    raise AssertionError


def stamp_of(name: str) -> str | None:
    found = search(r"\d{12}", name)
    return found[0] if found else None


@dataclass(frozen=True)
class Window:
    """What of a listing is wanted: a prefix, stamps in [start, end] (12 digits) and a cadence in minutes."""

    url: str
    prefix: str
    start: str
    end: str
    cadence: int
    size: int
    headers: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, options: dict[str, str]) -> Window:
        # option names come in lower case
        headers = tuple((k.removeprefix("header."), v) for k, v in options.items() if k.startswith("header."))
        return cls(options["url"], options.get("prefix", ""), options["start"], options["end"], int(options.get("cadence", 5)), int(options.get("pagesize", 500)), headers)

    def before(self, stamp: str) -> str:
        """The key just before all names of a stamp."""
        return self.prefix + (datetime.strptime(stamp, STAMP) - timedelta(minutes=1)).strftime(STAMP) + "~"

    def page(self, after: str) -> tuple[list[dict], bool]:
        """Entries of the page that follows a key, and whether there are more; seeks by key, so a deep page costs what the first does."""
        with polite_open(f"{self.url}?{urlencode({'maxKeys': self.size, 'startAfterFilename': after})}", dict(self.headers)) as answer:
            body = json.loads(answer.read())
        return body.get("files") or [], bool(body.get("isTruncated"))

    def walk(self, after: str, last: str) -> Iterator[tuple[list[dict], str]]:
        """Pages of entries with after < key, up to the stamp ``last``, and each one's last key; stops at the first name beyond."""
        more = True
        while more:
            entries, more = self.page(after)
            if not entries:
                return
            inside = []
            for e in entries:
                stamp = stamp_of(e["filename"]) if e["filename"].startswith(self.prefix) else None
                if stamp is not None and stamp > last:
                    more = False
                    break
                after = e["filename"]
                if stamp is not None:
                    inside.append(e)
            yield inside, after

    def rows(self, entries: list[dict]) -> Iterator[tuple]:
        for e in entries:
            stamp = stamp_of(e["filename"])
            if stamp >= self.start and (self.cadence <= 5 or int(stamp[10:]) % self.cadence == 0):
                yield e["filename"], datetime.strptime(stamp, STAMP), int(e.get("size") or 0)


class _Range(InputPartition):
    def __init__(self, after: str, last: str, upto: str | None = None):
        self.after, self.last, self.upto = after, last, upto


class KeyListingReader(DataSourceReader):
    """A task for each day of the window: as names hold their stamps, each seeks to its own first key."""

    def __init__(self, options: dict[str, str]):
        self.window = Window.of(options)

    def partitions(self) -> list[InputPartition]:
        w, out = self.window, []
        at, end = datetime.strptime(w.start, STAMP), datetime.strptime(w.end, STAMP)
        while at <= end:
            following = (at + timedelta(days=1)).replace(hour=0, minute=0)
            out.append(_Range(w.before(at.strftime(STAMP)), min(following - timedelta(minutes=1), end).strftime(STAMP)))
            at = following
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for entries, _ in self.window.walk(partition.after, partition.last):
            yield from self.window.rows(entries)


class KeyListingStream(DataSourceStreamReader):
    """Offsets are keys: what has been listed is the last key, so a restart goes on behind it.

    A batch is at most ``pages`` pages (0: all there are); each page is fetched again by its own task.
    """

    def __init__(self, options: dict[str, str]):
        self.window, self.pages = Window.of(options), int(options.get("pages", 0))
        self.at: str | None = None
        self.known: list[tuple[str, str]] = []

    def initialOffset(self) -> dict:
        return {"after": self.window.before(self.window.start)}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()["after"]
        for turn, (_, key) in enumerate(self.window.walk(self.at, self.window.end), 1):
            if key != self.at:
                self.known.append((self.at, key))
                self.at = key
            if turn == self.pages:
                break
        return {"after": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None or self.at < end["after"]:
            self.at = end["after"]  # restarted: the last planned batch says how far it had come
        ranges = [(a, b) for a, b in self.known if start["after"] <= a and b <= end["after"]]
        if not ranges or ranges[0][0] != start["after"] or ranges[-1][1] != end["after"]:
            ranges = [(start["after"], end["after"])] if start != end else []
        return [_Range(a, self.window.end, b) for a, b in ranges]

    def commit(self, end: dict) -> None:
        self.known = [(a, b) for a, b in self.known if b > end["after"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for entries, key in self.window.walk(partition.after, partition.last):
            yield from self.window.rows([e for e in entries if e["filename"] <= partition.upto])
            if key >= partition.upto:
                return


class KeyListingSource(DataSource):
    """spark.read or spark.readStream.format("key_listing"): name, stamp, size of a service's files, by key.

    Options: url, prefix, start and end (yyyyMMddHHmm, both ends in), cadence (minutes; names off it are left out if it is above
    5), pageSize, pages (a batch of a stream), header.<name>.  The service answers startAfterFilename and maxKeys in the order of names.
    """

    @classmethod
    def name(cls) -> str:
        return "key_listing"

    def schema(self) -> str:
        return "name string, stamp timestamp_ntz, size long"

    def reader(self, schema) -> DataSourceReader:
        return KeyListingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return KeyListingStream(self.options)


# ---- landing


@dataclass
class Landed(WriterCommitMessage):
    files: list[tuple[str, int, str]]


def _digest(path: str) -> str:
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            out.update(block)
    return out.hexdigest()


def land(folder: str, name: str, url: str, size: int | None, digest: str | None, headers: dict[str, str]) -> tuple[str, int, str]:
    """Brings one file into the folder, whole or not at all; one that is there already with the wanted size and digest stays.

    What an earlier try left is taken over and continued with a Range request.  A file shows under its name only
    by the last rename, when its length and digest are right.
    """
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"no file name: {name!r}")
    target, parts = f"{folder}/{name}", f"{folder}/_parts"
    fits = lambda path: (size is None or os.path.getsize(path) == size) and (digest is None or _digest(path) == digest)
    if os.path.exists(target) and fits(target):
        return name, os.path.getsize(target), _digest(target)
    os.makedirs(parts, exist_ok=True)
    mine = f"{parts}/{name}~{uuid.uuid4().hex}"
    left = sorted((p for p in os.listdir(parts) if p.rpartition("~")[0] == name), key=lambda p: os.path.getsize(f"{parts}/{p}") if os.path.exists(f"{parts}/{p}") else -1)
    for p in reversed(left):
        try:
            os.rename(f"{parts}/{p}", mine)  # one taker only
            break
        except FileNotFoundError:
            continue
    for turn in range(2):
        at = os.path.getsize(mine) if os.path.exists(mine) else 0
        if not (size is not None and at == size):
            try:
                answer = polite_open(url, headers | ({"Range": f"bytes={at}-"} if at else {}))
            except urllib.error.HTTPError as error:
                if error.code != 416:  # 416: nothing is left to send
                    raise
                answer = None
            if answer is not None:
                with answer, open(mine, "ab" if answer.status == 206 else "wb") as out:
                    wanted = answer.headers.get("Content-Length")
                    got = 0
                    while block := answer.read(1 << 16):
                        out.write(block)
                        got += len(block)
                    out.flush()
                    os.fsync(out.fileno())
                    if wanted is not None and got != int(wanted):
                        raise OSError(f"{name}: {got} of {wanted} bytes came")
        if fits(mine):
            break
        os.remove(mine)  # what was continued is not what the service has: once more, from the start
        if turn:
            raise OSError(f"{name} has not the size and digest that were asked for")
    length, found = os.path.getsize(mine), _digest(mine)
    os.replace(mine, target)
    return name, length, found


class LandingWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}

    def write(self, iterator: Iterator) -> Landed:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for row in iterator:
            held = dict(zip(self.columns, row, strict=True))
            files.append(land(self.folder, held["name"], held["url"], held.get("size"), held.get("digest"), self.headers))
        return Landed(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One manifest of all files, under its name only when it is whole."""
        files = sorted({f for m in messages if m is not None for f in m.files})
        os.makedirs(f"{self.folder}/_manifests", exist_ok=True)
        name = hashlib.sha256(json.dumps(files).encode()).hexdigest()[:32]  # the same files again are the same manifest
        part = f"{self.folder}/_manifests/.{uuid.uuid4().hex}"
        with open(part, "w") as out:
            json.dump([{"name": n, "length": k, "digest": d} for n, k, d in files], out)
        os.replace(part, f"{self.folder}/_manifests/{name}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that are whole stay and are skipped next time; the rest is under _parts and goes on from there."""


class LandingSource(DataSource):
    """df.write.format("landing").option("path", folder): a file for each row (name, url and, where known, size and digest).

    The folder must be one that all executors and the driver see.  A table read of the manifests tells what has been
    landed: files that no manifest names belong to a write that has not ended.
    """

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "name string, url string, size long, digest string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LandingWriter(self.options, schema.fieldNames())


def manifests(spark, folder: str):
    """name, length, digest of all files that a finished write has landed, each once."""
    return spark.read.schema("name string, length long, digest string").json(f"{folder}/_manifests/*.json").distinct()
