"""Landed payloads and listings as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import duration_seconds, lead_minutes, lenient_double, per_hour, stamp_time

#: The part of a point-forecast payload that is read; unknown fields are ignored, all are optional.
POINT_FORECAST = "cityName STRING, animation STRUCT<type: STRING, sequence: ARRAY<STRUCT<time: STRING, uri: STRING, value: STRING>>>, `for` STRUCT<hourly: ARRAY<STRUCT<hour: STRING, precipQuantity: STRING>>>"

#: Fields taken from a station feature.
STATION_FIELDS = ["pressure", "temp_dry_shelter_avg", "humidity_rel_shelter_avg", "wind_speed_10m", "wind_direction", "wind_gusts_speed", "precip_quantity", "temp_grass_pt100_avg"]


def animation_rows(payloads: DataFrame, body: str = "body", minutes: int = 10, strict_numbers: bool = False) -> DataFrame:
    """location, lat, lon, poll_ts, frame_ts, lead_min, value_mm_per_h, image_url: a row for each frame with a valid time.

    A missing value is 0; text that is a number counts as one unless ``strict_numbers``.  Leads are whole
    minutes rounded down, negative before the poll.  Malformed payloads give no rows.
    """
    parsed = payloads.withColumn("_j", F.from_json(F.col(body), POINT_FORECAST, {"mode": "PERMISSIVE"}))
    frames = parsed.select(*[c for c in payloads.columns if c != body], F.explode(F.filter(F.coalesce("_j.animation.sequence", F.array().cast(T.ArrayType(parsed.schema["_j"].dataType["animation"].dataType["sequence"].dataType.elementType))), lambda x: x.isNotNull())).alias("_f"))
    # PERMISSIVE text keeps what the field held; a quoted number is told apart in the raw body only when strict
    value = F.when(F.lit(strict_numbers) & ~F.col("_f.value").rlike(r"^-?[0-9.eE+-]+$"), 0.0).otherwise(lenient_double("_f.value"))
    timed = frames.withColumn("frame_ts", F.try_to_timestamp("_f.time")).where("frame_ts IS NOT NULL")
    return timed.select("location", "lat", "lon", "poll_ts", "frame_ts", lead_minutes("frame_ts", "poll_ts").cast("int").alias("lead_min"), per_hour(value, minutes).cast("float").alias("value_mm_per_h"), F.coalesce("_f.uri", F.lit("")).alias("image_url"))


def hourly_value(body: Column, lead_min: Column) -> Column:
    """Precipitation of the hour that holds a lead, the last hour beyond the end, 0 where there is none."""
    hours = F.from_json(body, POINT_FORECAST)["for"]["hourly"]
    place = F.least(F.floor(lead_min / 60), F.size(hours) - 1)
    return F.when(F.coalesce(F.size(hours), F.lit(0)) > 0, lenient_double(F.get(hours, place.cast("int"))["precipQuantity"])).otherwise(0.0)


def station_rows(features: DataFrame, column: str = "feature") -> DataFrame:
    """lon, lat, code, timestamp and the measured fields of GeoJSON features; numbers that are none become NULL."""
    schema = "geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties MAP<STRING, STRING>"
    f = features.withColumn("_f", F.from_json(column, schema))
    prop = lambda name: F.element_at("_f.properties", name)
    return f.select(F.get("_f.geometry.coordinates", 0).alias("lon"), F.get("_f.geometry.coordinates", 1).alias("lat"), prop("code").try_cast("int").alias("code"), F.try_to_timestamp(prop("timestamp")).alias("timestamp"), *[prop(n).try_cast("double").alias(n) for n in STATION_FIELDS])


def upsert_keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, for each key the one with the greatest order; columns missing on a side are NULL."""
    both = old.unionByName(new, allowMissingColumns=True)
    row = F.struct(F.col(order).alias("_o"), *both.columns)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), row).alias("_r")).select("_r.*")


def not_yet_present(listing: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Entries of a listing that the target does not have."""
    return listing.join(present.select(*on).distinct(), on, "left_anti")


def expand_times(dimension: Column) -> Column:
    """Times of a WMS time dimension: comma parts, each a time or start/end/period (both ends in); bad parts are skipped."""
    parts = F.transform(F.split(dimension, ","), lambda x: F.trim(x))

    def one(part: Column) -> Column:
        f = F.split(part, "/")
        start, end, step = F.try_to_timestamp(F.get(f, 0)), F.try_to_timestamp(F.get(f, 1)), duration_seconds(F.get(f, 2))
        span = F.sequence(F.unix_seconds(start), F.unix_seconds(end), step)
        single = F.when(start.isNotNull(), F.array(F.unix_seconds(start)))
        return F.coalesce(F.when(F.size(f) == 1, single).when((F.size(f) == 3) & (end >= start) & (step > 0), span), F.array().cast("array<bigint>"))

    return F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one)))), lambda s: F.timestamp_seconds(s).cast("timestamp_ntz"))


def layer_dimension(capabilities: Column, layer: str) -> Column:
    """The time dimension of a named layer in WMS capabilities."""
    block = F.regexp_extract(capabilities, rf"(?s)<Layer[^>]*>(?:(?!</?Layer).)*?<Name>\s*{layer}\s*</Name>(?:(?!</?Layer\b).)*</Layer>", 0)
    return F.trim(F.regexp_extract(block, r'(?s)<Dimension[^>]*name="time"[^>]*>(.*?)</Dimension>', 1))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, path, length, stamp of files, without their content (the column is pruned)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("name"), "path", "length", stamp_time(name).alias("stamp"))


def in_window(listing: DataFrame, prefix: str, start: str, end: str, cadence_minutes: int = 5, native_minutes: int = 5, stamp: str = "stamp") -> DataFrame:
    """Names with the prefix and stamps in [start, end], thinned to the cadence if it is coarser than the native one."""
    out = listing.where(F.col("name").startswith(prefix) & F.col(stamp).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return out.where(F.minute(stamp) % cadence_minutes == 0) if cadence_minutes > native_minutes else out


def seek_key(prefix: str, start: Column) -> Column:
    """The name just before the window: the stamp a minute before its start."""
    return F.concat(F.lit(prefix), F.date_format(start - F.expr("INTERVAL 1 MINUTE"), "yyyyMMddHHmm"))


def decoded_rasters(spark: SparkSession, path: str, decode, schema: str, glob: str = "*") -> DataFrame:
    """Rasters through a decoder of (path, bytes) -> pandas frame, run beside the files; for formats without a reader."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                table = decode(name, content)
                if table is not None:
                    yield table

    return found.mapInPandas(run, schema)


def decode_hdf5(name: str, content: bytes):
    """issue_time, lead_min, y, x, raw, formula of a radar forecast file; needs h5py, which is optional."""
    import io

    import h5py
    import numpy as np
    import pandas as pd

    with h5py.File(io.BytesIO(content)) as f:
        groups = sorted((k for k in f if k.startswith("image") and k[5:].isdigit()), key=lambda k: int(k[5:]))
        formula = f[groups[0]]["calibration"].attrs["calibration_formulas"]
        times = [pd.to_datetime(f[g].attrs["image_datetime_valid"].decode().split(".")[0].title(), format="%d-%b-%Y;%H:%M:%S") for g in groups]
        parts = []
        for g, t in zip(groups, times, strict=True):
            data = f[g]["image_data"][()]
            y, x = np.indices(data.shape)
            parts.append(pd.DataFrame({"issue_time": times[0], "lead_min": round((t - times[0]).total_seconds() / 60), "y": y.ravel(), "x": x.ravel(), "raw": data.ravel().astype("int32"), "formula": formula.decode()}))
        return pd.concat(parts)


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class JsonHttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(u) for u in self.options["urls"].split()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time
        import urllib.request

        for turn in range(3):
            try:
                with urllib.request.urlopen(partition.url, timeout=30) as answer:
                    yield partition.url, answer.status, answer.read().decode()
                    left = answer.headers.get("X-RateLimit-Remaining")
                    if left is not None and int(left) <= 5:
                        time.sleep(max(5.0, float(answer.headers.get("X-RateLimit-Reset", 3)) + 2 - time.time()))
                    return
            except OSError:
                if turn == 2:
                    raise
                time.sleep(0.25 * 2**turn)


class JsonHttpSource(DataSource):
    """spark.read.format("json_http").option("urls", "..."): a row (url, status, body) for each address, with retries and rate limits."""

    @classmethod
    def name(cls) -> str:
        return "json_http"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return JsonHttpReader(self.options)


def synthetic_runs(spark: SparkSession, runs: int = 12, height: int = 100, width: int = 100, leads: int = 25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Forecasts and observations of a drifting Gaussian blob; forecasts spread and get noisier with lead.

    Noise is made from hashes of the place, so it does not depend on the partitioning.
    """
    step = 5
    cells = lambda n: spark.range(n * height * width).select((F.col("id") / (height * width)).cast("int").alias("k"), F.floor(F.col("id") % (height * width) / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    start = F.lit("2026-05-20 12:00:00").cast("timestamp_ntz")

    def normal(*key) -> Column:
        u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.sqrt(-2 * F.log(u(1))) * F.cos(u(2) * 6.283185307179586)

    def blob(minutes: Column, sigma: Column, wy: Column, wx: Column) -> Column:
        cy, cx = 20 + 0.4 * minutes + wy, 15 + 0.6 * minutes + wx
        return 8.0 * F.exp(-((F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx)) / (2 * sigma * sigma))

    zero = F.lit(0.0)
    obs = cells(runs + leads).select(F.timestamp_seconds(epoch(start) + F.col("k") * step * 60).cast("timestamp_ntz").alias("valid_time"), "y", "x", blob(F.col("k") * step, F.lit(6.0), zero, zero).alias("rate"))
    fc = cells(runs * leads).withColumns({"run": F.floor(F.col("k") / leads).cast("int"), "lead": (F.col("k") % leads) * step})
    wobble = lambda s: normal(F.col("run"), F.col("lead"), F.lit(s)) * 0.06 * F.col("lead")
    noisy = blob(F.col("run") * step + F.col("lead"), 6.0 + 0.04 * F.col("lead"), wobble(3), wobble(4)) + normal(F.col("run"), F.col("lead"), F.col("y"), F.col("x")) * (0.05 + 0.01 * F.col("lead"))
    fc = fc.select(F.timestamp_seconds(epoch(start) + F.col("run") * step * 60).cast("timestamp_ntz").alias("issue_time"), F.col("lead").cast("int").alias("lead_min"), "y", "x", F.greatest(noisy, zero).alias("rate"))
    return fc, obs


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


# ---- tables and parameters of the feeds

# Places whose forecasts are polled, with latitude and longitude.
PLACES = {
    "brussels": (50.8503, 4.3517),
    "antwerp": (51.2194, 4.4025),
    "ghent": (51.0543, 3.7174),
    "liege": (50.6326, 5.5797),
    "charleroi": (50.4108, 4.4446),
    "bruges": (51.2093, 3.2247),
    "arlon": (49.6839, 5.8167),
    "ostend": (51.2247, 2.9069),
}

# Alias, dataset, version and prefix of file names.
DATASETS = {
    "radar_forecast": ("radar_forecast", "2.0", "RAD_NL25_RAC_FM_"),
    "rtcor": ("nl_rdr_data_rtcor_5m", "1.0", "RAD_NL25_RAC_RT_"),
    "nl_rdr_data_rtcor_5m": ("nl_rdr_data_rtcor_5m", "1.0", "RAD_NL25_RAC_RT_"),
    "volume_herwijnen": ("radar_volume_full_herwijnen", "1.0", "RAD_NL62_VOL_NA_"),
    "volume_denhelder": ("radar_volume_denhelder", "2.0", "RAD_NL61_VOL_NA_"),
}


def places(spark: SparkSession) -> DataFrame:
    """location, lat, lon: the dimension of polled places."""
    return spark.createDataFrame([(k, *v) for k, v in PLACES.items()], "location string, lat double, lon double")


def datasets(spark: SparkSession) -> DataFrame:
    """alias, dataset, version, prefix."""
    return spark.createDataFrame([(k, *v) for k, v in DATASETS.items()], "alias string, dataset string, version string, prefix string")


def known_places(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows of known locations with their coordinates."""
    return rows.join(table, "location")


@dataclass(frozen=True)
class Settings:
    """What a deployment sets, from variables SKYLATTICE_<NAME> where they are set."""

    store_root: str = "var/forecasts"
    stale_after_seconds: int = 900
    feed_url: str = ""
    model_version: str = "stub-0.1"
    origins: str = ""

    @classmethod
    def load(cls, env: dict[str, str]) -> Settings:
        found = {f.name: env[f"SKYLATTICE_{f.name.upper()}"] for f in fields(cls) if f"SKYLATTICE_{f.name.upper()}" in env}
        return cls(**{k: int(v) if k.endswith("seconds") else v for k, v in found.items()})

    def origin_list(self) -> list[str]:
        return [x.strip() for x in self.origins.split(",") if x.strip()]


FORECAST_BODY = "issued_at STRING, model_version STRING, frames ARRAY<STRING>"
FORECAST_FRAME = "band STRING, lead_min STRING, valid_time STRING, rate_mm_per_h STRING, overlay_url STRING"


def forecast_body_rows(landed: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, issued_at, model_version, band, lead_min, valid_time, rate, overlay_url of forecast documents, in time order within one.

    Documents without issued_at or frames, frames that are no objects and frames without a time give no
    row; other gaps get 'unknown', 'nowcast', 0, 0.0 and ''.
    """
    b, f = F.from_json(body, FORECAST_BODY), F.from_json("_f", FORECAST_FRAME)
    rows = landed.select(*keys, b.alias("_b")).where("_b.issued_at IS NOT NULL AND _b.frames IS NOT NULL")
    rows = rows.select(*keys, "_b", F.explode("_b.frames").alias("_f")).where(F.ltrim("_f").startswith("{")).withColumn("_f", f)
    at = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    out = rows.select(
        *keys,
        at("_b.issued_at").alias("issued_at"),
        F.coalesce("_b.model_version", F.lit("unknown")).alias("model_version"),
        F.coalesce("_f.band", F.lit("nowcast")).alias("band"),
        F.coalesce(F.col("_f.lead_min").try_cast("double"), F.lit(0.0)).cast("int").alias("lead_min"),
        at("_f.valid_time").alias("valid_time"),
        lenient_double("_f.rate_mm_per_h").alias("rate"),
        F.coalesce("_f.overlay_url", F.lit("")).alias("overlay_url"),
    )
    return out.where("issued_at IS NOT NULL AND valid_time IS NOT NULL").sortWithinPartitions(*keys, "valid_time")


def between_filter(column: str, start: str, end: str) -> str:
    """A feature service's filter expression, applied by the server."""
    return f"{column} BETWEEN '{start}' AND '{end}'"


def map_url(base: str, layer: str, when: str, bbox: tuple[float, float, float, float], size: tuple[int, int]) -> str:
    """Address of a map image; version 1.3.0 takes south, west, north, east."""
    west, south, east, north = bbox
    query = {"service": "WMS", "version": "1.3.0", "request": "GetMap", "layers": layer, "styles": "", "crs": "EPSG:4326", "bbox": f"{south},{west},{north},{east}", "width": size[0], "height": size[1], "time": when, "format": "image/geotiff"}
    return f"{base}?{urlencode(query)}"


def elevation_requests(cells: DataFrame, width: int, size: int = 100) -> DataFrame:
    """batch, cells (y, x in order), locations (lat,lon joined by bars): ``size`` cells of a grid a request."""
    placed = cells.withColumn("_i", F.col("y") * width + F.col("x"))
    packed = F.array_sort(F.collect_list(F.struct("_i", "y", "x", "lat", "lon")))
    out = placed.groupBy(F.floor(F.col("_i") / size).alias("batch")).agg(packed.alias("_c"))
    spot = F.transform("_c", lambda c: F.concat_ws(",", F.format_string("%.6f", c["lat"]), F.format_string("%.6f", c["lon"])))
    return out.select("batch", F.transform("_c", lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"))).alias("cells"), F.array_join(spot, "|").alias("locations"))


def elevations(answers: DataFrame) -> DataFrame:
    """y, x, elevation_m of answers (cells, body); a null elevation is 0."""
    heights = F.from_json("body", "results ARRAY<STRUCT<elevation: DOUBLE>>")["results"]
    rows = answers.select(F.explode(F.arrays_zip("cells", heights.alias("h"))).alias("_z"))
    return rows.select("_z.cells.y", "_z.cells.x", F.coalesce("_z.h.elevation", F.lit(0.0)).alias("elevation_m"))
