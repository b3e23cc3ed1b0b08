"""Versioned forecast snapshots and the queries that clients ask.

The tables of a band's refresh are written to a folder of their own and never changed.  A snapshot is a
commit: a numbered file that says which folder holds each band.  It is made by one step that fails if the number is taken; then
the writer takes the newer commit as its base and tries the next number, so bands that publish side by side all
show, and nothing is copied.  All file work goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import RAMP, axis, epoch_seconds, overlay_url, plus_minutes, spatial_bucket
from ..operators.grids import nearest_cell, stack


@dataclass(frozen=True)
class Band:
    name: str
    start: int
    stop: int
    step: int
    refresh_seconds: int
    cron: str

    def leads(self) -> list[int]:
        return list(range(self.start, self.stop, self.step))


# Lead bands in minutes, their refresh in seconds and their schedules.
BANDS = (
    Band("nowcast", 0, 120, 10, 300, "*/5 * * * *"),
    Band("short", 120, 720, 60, 3600, "0 * * * *"),
    Band("medium", 720, 1440, 60, 10800, "0 */3 * * *"),
    Band("long", 1440, 14400, 180, 43200, "0 */12 * * *"),
)


@dataclass(frozen=True)
class Grid:
    west: float = 1.5
    east: float = 7.5
    south: float = 48.9
    north: float = 52.5
    height: int = 100
    width: int = 100

    def holds(self, lat: float, lon: float) -> bool:
        return self.south <= lat <= self.north and self.west <= lon <= self.east


def bands(spark: SparkSession) -> DataFrame:
    """band, start, stop, step, refresh_seconds, max_age: the dimension of four rows."""
    return spark.createDataFrame([(b.name, b.start, b.stop, b.step, b.refresh_seconds, b.refresh_seconds - 10) for b in BANDS], "band string, start int, stop int, step int, refresh_seconds int, max_age int")


def band_leads(bands_table: DataFrame) -> DataFrame:
    return bands_table.select("band", F.explode(F.sequence("start", F.col("stop") - F.col("step"), "step")).alias("lead_min"), "max_age")


def point_shards(cells: DataFrame, grid: Grid, step: float = 0.1) -> DataFrame:
    """band, lead_min, rate of cells (y, x) with coordinates, cell number and buckets."""
    placed = cells.withColumns({"lat": axis(F.col("y"), grid.north, grid.south, grid.height), "lon": axis(F.col("x"), grid.west, grid.east, grid.width), "cell": F.col("y") * grid.width + F.col("x")})
    return placed.withColumns({"lat_bucket": spatial_bucket("lat", step), "lon_bucket": spatial_bucket("lon", step)})


def point_forecast(shards: DataFrame, lat: float, lon: float, horizon_min: int = 1440, step: float = 0.1, ring: int = 0) -> DataFrame:
    """band, lead_min, rate of the cell nearest to a point within its bucket, by band name and lead."""
    spark = shards.sparkSession
    spot = spark.range(1).select(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")).withColumns({"lat_bucket": spatial_bucket("lat", step), "lon_bucket": spatial_bucket("lon", step)})
    b = spot.first()
    near = shards.where(F.col("lat_bucket").between(b.lat_bucket - ring, b.lat_bucket + ring) & F.col("lon_bucket").between(b.lon_bucket - ring, b.lon_bucket + ring))
    cell = nearest_cell(spot, near.select("lat_bucket", "lon_bucket", "cell", "lat", "lon").distinct(), ["lat_bucket", "lon_bucket"], ring=ring).select("cell")
    rows = near.join(F.broadcast(cell), "cell").where(F.col("lead_min") <= horizon_min)
    return rows.select("band", "lead_min", "rate").orderBy("band", "lead_min")


def forecast_frames(rows: DataFrame, snapshot: Column, issued_at: Column) -> DataFrame:
    """band, lead_min, valid_time, rate, overlay_url."""
    return rows.select("band", "lead_min", plus_minutes(issued_at, F.col("lead_min")).alias("valid_time"), "rate", overlay_url(F.col("band"), F.col("lead_min"), snapshot).alias("overlay_url"))


def manifest(leads: DataFrame, overlays: DataFrame, band: str, snapshot: Column, issued_at: Column) -> DataFrame:
    """lead_min, valid_time, url of the band's leads that have an overlay."""
    have = leads.where(F.col("band") == band).join(overlays, ["band", "lead_min"], "left_semi")
    return have.select("lead_min", plus_minutes(issued_at, F.col("lead_min")).alias("valid_time"), overlay_url(F.col("band"), F.col("lead_min"), snapshot).alias("url")).orderBy("lead_min")


def health(snapshots: DataFrame, now: Column, stale_after: int = 900) -> DataFrame:
    """status ('empty', 'ok' or 'degraded'), issued_at and age_seconds of the newest snapshot."""
    newest = snapshots.agg(F.max("issued_at").alias("issued_at"))
    age = epoch_seconds(now) - epoch_seconds("issued_at")
    return newest.select(F.when(F.col("issued_at").isNull(), "empty").when(age > stale_after, "degraded").otherwise("ok").alias("status"), "issued_at", age.alias("age_seconds"))


def retained(snapshots: DataFrame, keep: int = 24) -> DataFrame:
    """snapshots with ``stays``: the newest ``keep`` complete ones and all incomplete ones."""
    rank = F.row_number().over(Window.partitionBy("complete").orderBy(F.desc("snapshot")))
    return snapshots.withColumn("stays", ~F.col("complete") | (rank <= keep))


def response_body(issued_at: Column, lat: Column, lon: Column, model_version: str, horizon_min: int) -> Column:
    """An aggregate: the JSON document of rows with band, lead_min, valid_time, rate and overlay_url (as many as there are leads)."""
    frames = F.array_sort(F.collect_list(F.struct("band", "lead_min", "valid_time", F.col("rate").alias("rate_mm_per_h"), "overlay_url")))
    return F.to_json(F.struct(issued_at.alias("issued_at"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("location"), F.lit(model_version).alias("model_version"), F.lit(horizon_min).alias("horizon_min"), frames.alias("frames")))


def point_response(rows: DataFrame, issued_at: str, lat: float, lon: float, model_version: str, horizon_min: int) -> DataFrame:
    """One JSON document of a point forecast (bounded by the number of leads)."""
    return rows.agg(response_body(F.lit(issued_at), F.lit(lat), F.lit(lon), model_version, horizon_min).alias("body"))


def png(rates: np.ndarray, max_alpha: int = 220, full_at: float = 0.3) -> bytes:
    """A raster of rates as a PNG with the ramp's colours, transparent where it is dry."""
    rate = np.clip(np.nan_to_num(rates.astype(float)), 0, None)
    stops = [s for s, _ in RAMP]
    channels = [np.interp(rate, stops, [c[k] for _, c in RAMP]) for k in range(3)]
    rgba = np.stack([*channels, np.clip(rate / full_at, 0, 1) * max_alpha], axis=-1).astype(np.uint8)
    rgba[rate <= 0] = 0
    height, width = rate.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def overlays(tensors: DataFrame, height: int, width: int) -> DataFrame:
    """band, lead_min, png of rows of band, lead_min, rates (row-major)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [png(np.array(x, float).reshape(height, width)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(images, pa.binary())], names=["band", "lead_min", "png"])

    return tensors.select("band", F.col("lead_min").cast("int"), "rates").mapInArrow(draw, "band string, lead_min int, png binary")


class RequestError(ValueError):
    """A refused request: status 400 (bad input), 404 (no such thing) or 503 (nothing to serve yet)."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


class SnapshotStore:
    """Snapshots under a root path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, grid: Grid | None = None):
        self.spark, self.root, self.grid = spark, root.rstrip("/"), grid or Grid()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _put(self, name: str, text: str) -> None:
        """Writes beside the target and renames over it in one step, so that a reader finds the old text or the new one."""
        part = self._path(f"{self.root}/{name}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs
        target = self._fs.makeQualified(self._path(f"{self.root}/{name}"))
        kind = getattr(files, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        files.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(part), target, over)

    def _get(self, name: str) -> str | None:
        if not self._exists(name):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def name_of(self, issued_at: datetime) -> str:
        return issued_at.strftime("%Y-%m-%dT%H-%M-%SZ")

    def _create(self, name: str, text: str) -> bool:
        """A whole file in one step, or False if there is one already."""
        part, target = f"{self.root}/commits/.{uuid.uuid4().hex}", f"{self.root}/{name}"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename would replace the file; a link does not
                local = lambda p: self._fs.makeQualified(self._path(p)).toUri().getPath()
                try:
                    os.link(local(part), local(target))
                except FileExistsError:
                    return False
                return True
            return self._fs.rename(self._path(part), self._path(target))
        finally:
            self._fs.delete(self._path(part), False)

    def _commits(self) -> list[int]:
        """Numbers of all commits, in order."""
        if not self._exists("commits"):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _commit(self, number: int) -> dict:
        return json.loads(self._get(f"commits/{number:012d}.json") or "{}")

    def _all(self) -> dict[int, dict]:
        """Every commit by its number, in one job."""
        if not self._commits():
            return {}
        found = self.spark.read.option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.json").text(f"{self.root}/commits", wholetext=True)
        rows = found.select(F.col("_metadata.file_name").alias("name"), "value").collect()  # as many as are kept
        return {int(r.name[:-5]): json.loads(r.value) for r in sorted(rows, key=lambda r: r.name)}

    def _newest_commit(self) -> tuple[int, dict]:
        while numbers := self._commits():
            if commit := self._commit(numbers[-1]):
                return numbers[-1], commit
        return 0, {}

    def _find(self, snapshot: str) -> dict:
        _, newest = self._newest_commit()
        if newest.get("snapshot") == snapshot:
            return newest
        for commit in reversed(self._all().values()):
            if commit["snapshot"] == snapshot:
                return commit
        raise RequestError(404, f"no snapshot {snapshot}")

    def latest(self) -> str | None:
        return self._newest_commit()[1].get("snapshot")

    def status(self, snapshot: str) -> dict:
        return self._find(snapshot)["status"]

    def snapshots(self) -> list[str]:
        """Names of all snapshots, by time and version."""
        return [c["snapshot"] for c in self._all().values()]

    def publish(self, issued_at: datetime, band: str, cells: DataFrame, *, model_version: str = "stub", inferred_at: datetime | None = None, bucket_seconds: int = 0, extras: dict | None = None) -> str:
        """A new snapshot: this band from ``cells`` (lead_min, y, x, rate), the others as they are in the newest one.

        A band has shards of points, a tensor (row-major array) and an overlay (PNG) for each lead; the snapshot a
        grid.json with ``extras`` merged last.  With ``bucket_seconds`` it is named by the bucket of its issue time: what is
        issued in the same bucket becomes a further version of that snapshot.  ``cells`` is computed once.
        """
        if bucket_seconds:
            issued_at = datetime.fromtimestamp(issued_at.replace(tzinfo=issued_at.tzinfo or UTC).timestamp() // bucket_seconds * bucket_seconds, tz=UTC).replace(tzinfo=issued_at.tzinfo)
        spec = next((b for b in BANDS if b.name == band), None)
        if spec is None:
            raise RequestError(404, f"no band {band}")
        folder = f"data/{band}-{uuid.uuid4().hex}"
        try:
            self._write_band(spec, cells, f"{self.root}/{folder}")
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        grid = {"bounds": {"west": self.grid.west, "east": self.grid.east, "south": self.grid.south, "north": self.grid.north}, "shape": [self.grid.height, self.grid.width], "model_version": model_version, "issued_at": issued_at.isoformat(), **(extras or {})}
        status = {"band": band, "issued_at": issued_at.isoformat(), "inferred_at": (inferred_at or issued_at).isoformat(), "model_version": model_version}
        name = self._append(self.name_of(issued_at), band, folder, grid, status)
        self._put(f"{name}/grid.json", json.dumps(grid))
        return name

    def _write_band(self, spec: Band, cells: DataFrame, path: str) -> None:
        """points, bands and overlays of one band; everything after the points is made from them as they were written."""
        chosen = cells.select(F.lit(spec.name).alias("band"), F.col("lead_min").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("rate").cast("float"))
        rows = point_shards(chosen, self.grid)
        rows.repartition("lat_bucket").sortWithinPartitions("lat_bucket", "lon_bucket", "lead_min").write.option("compression", "zstd").partitionBy("lat_bucket").parquet(f"{path}/points")
        back = self.spark.read.parquet(f"{path}/points")
        want = len(spec.leads()) * self.grid.height * self.grid.width
        inside = F.col("lead_min").isin(spec.leads()) & F.col("y").between(0, self.grid.height - 1) & F.col("x").between(0, self.grid.width - 1)
        have = back.groupBy("lead_min", "y", "x").count().agg(F.count_if(inside).alias("places"), F.sum("count").alias("rows")).first()
        if have.places != want or have.rows != want:
            raise ValueError(f"{spec.name} needs {want} cells, one for each lead and place")
        tensors = stack(back.select("band", "lead_min", "y", "x", F.col("rate").alias("value")), ["band", "lead_min"], self.grid.width).select("lead_min", F.col("values").alias("rates"), "band")
        tensors.write.parquet(f"{path}/bands")
        overlays(self.spark.read.parquet(f"{path}/bands"), self.grid.height, self.grid.width).select("lead_min", "png", "band").write.parquet(f"{path}/overlays")

    def _append(self, bucket: str, band: str, folder: str, grid: dict, status: dict) -> str:
        """Commits a band's folder on top of the newest commit, whichever that is by then."""
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        while True:
            number, base = self._newest_commit()
            versions = set(self.snapshots())
            name, turn = bucket, 1
            while name in versions:
                turn += 1
                name = f"{bucket}.{turn}"
            commit = {"snapshot": name, "bands": {**base.get("bands", {}), band: folder}, "grid": grid, "status": status}
            if self._create(f"commits/{number + 1:012d}.json", json.dumps(commit)):
                return name

    def prune(self, keep: int = 24) -> int:
        """Removes snapshots beyond the newest ``keep`` buckets, and all but the last version of every bucket but the newest.

        The newest commit always stays.  Folders go when no commit that stays names them.  Gives how many snapshots went.
        """
        order = lambda name: (name.partition(".")[0], int(name.partition(".")[2] or 1))
        commits = self._all()
        if not commits:
            return 0
        last = max(commits)
        buckets = sorted({order(c["snapshot"])[0] for c in commits.values()})
        kept = set(buckets[-keep:] if keep > 0 else [])
        newest = {b: max(order(c["snapshot"])[1] for c in commits.values() if order(c["snapshot"])[0] == b) for b in kept}
        stays = {n for n, c in commits.items() if n == last or (order(c["snapshot"])[0] in kept and (order(c["snapshot"])[0] == buckets[-1] or order(c["snapshot"])[1] == newest[order(c["snapshot"])[0]]))}
        needed = {f for n in stays for f in commits[n]["bands"].values()}
        for n in sorted(set(commits) - stays):
            self._fs.delete(self._path(f"{self.root}/commits/{n:012d}.json"), False)
            self._fs.delete(self._path(f"{self.root}/{commits[n]['snapshot']}"), True)
        for folder in {f for n in set(commits) - stays for f in commits[n]["bands"].values()} - needed:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return len(commits) - len(stays)

    def _bands(self, snapshot: str, table: str) -> DataFrame:
        """A table of all bands of a snapshot."""
        parts = [self.spark.read.parquet(f"{self.root}/{folder}/{table}") for folder in self._find(snapshot)["bands"].values()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def points(self, snapshot: str) -> DataFrame:
        return self._bands(snapshot, "points")

    def tensors(self, snapshot: str) -> DataFrame:
        """lead_min, rates, band."""
        return self._bands(snapshot, "bands")

    def images(self, snapshot: str) -> DataFrame:
        """lead_min, png, band."""
        return self._bands(snapshot, "overlays")

    def image(self, band: str, lead_min: int) -> tuple[bytes, int]:
        """The PNG of a band at a lead, and for how many seconds it may be kept."""
        name, _ = self._newest()
        found = self.images(name).where((F.col("band") == band) & (F.col("lead_min") == lead_min)).select("png").head()
        if found is None:
            raise RequestError(404, "no such overlay")
        return bytes(found.png), next(b.refresh_seconds for b in BANDS if b.name == band) - 10

    def _newest(self) -> tuple[str, dict]:
        name = self.latest()
        if name is None:
            raise RequestError(503, "no snapshot yet")
        return name, self.status(name)

    def forecast(self, lat: float, lon: float, horizon_min: int = 1440) -> DataFrame:
        """Frames at a point: band, lead_min, valid_time, rate, overlay_url."""
        if not (-90 <= lat <= 90 and -180 <= lon <= 180 and 0 < horizon_min <= 14400):
            raise RequestError(400, "bad coordinates or horizon")
        name, status = self._newest()
        if not self.grid.holds(lat, lon):
            raise RequestError(400, "outside the grid")
        rows = point_forecast(self.points(name), lat, lon, horizon_min)
        return forecast_frames(rows, F.lit(name), F.lit(status["issued_at"]).cast("timestamp_ntz"))

    def animation(self, band: str) -> DataFrame:
        if band not in {b.name for b in BANDS}:
            raise RequestError(404, f"no band {band}")
        name, status = self._newest()
        have = self.images(name).select("band", "lead_min").distinct()
        return manifest(band_leads(bands(self.spark)), have, band, F.lit(name), F.lit(status["issued_at"]).cast("timestamp_ntz"))

    def overlay(self, band: str, lead_min: int) -> DataFrame:
        """y, x, r, g, b, a of a band at a lead."""
        from ..functions.scalars import ramp_colour

        name, _ = self._newest()
        rows = self.points(name).where((F.col("band") == band) & (F.col("lead_min") == lead_min)).select("y", "x", ramp_colour("rate").alias("c")).select("y", "x", "c.*")
        if rows.isEmpty():
            raise RequestError(404, "no such overlay")
        return rows

    def health(self, now: datetime, stale_after: int = 900) -> dict:
        name = self.latest()
        if name is None:
            return {"status": "empty"}
        age = (now - datetime.fromisoformat(self.status(name)["issued_at"])).total_seconds()
        return {"status": "degraded" if age > stale_after else "ok", "snapshot": name, "age_seconds": age}
