"""Requests to services as tables: signed forecasts, features by time, elevations and map images."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.error import HTTPError
from urllib.parse import quote, urlencode

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.scalars import rounded_coordinate, signed_key
from .listing import polite_open

MILLI = timedelta(milliseconds=1)


def fetched(requests: DataFrame, headers: dict[str, str] | None = None, *, tasks: int = 4, pause: float = 0.0, url: str = "url") -> DataFrame:
    """requests with status and content (binary), NULL where no answer came, and error.

    At most ``tasks`` requests are under way at once, each task waiting ``pause`` seconds between its own.  429 (with its Retry-After),
    5xx and broken lines are tried again, other refusals are answers.  A task that runs again asks again.
    """
    columns, head = requests.columns, dict(headers or {})
    place = columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = False
        for batch in batches:
            rows: list[tuple] = []
            for address in batch.column(place).to_pylist():
                if asked and pause:
                    time.sleep(pause)
                asked = True
                try:
                    with polite_open(address, head) as answer:
                        rows.append((answer.status, answer.read(), None))
                except HTTPError as error:
                    rows.append((error.code, error.read(), str(error)))
                except (OSError, ValueError) as error:
                    rows.append((None, None, str(error)))
            status, content, error = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.int32()), pa.array(content, pa.binary()), pa.array(error, pa.string())], names=[*columns, "status", "content", "error"])

    schema = T.StructType([*requests.schema.fields, T.StructField("status", T.IntegerType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    return requests.repartition(tasks).mapInArrow(run, schema)


# ---- signed point forecasts


def forecast_requests(places: DataFrame, base: str, salt: str, day: Column, method: str = "getForecasts") -> DataFrame:
    """places (location, lat, lon) with the address of each one's forecast, signed for the day; the salt comes from configuration."""
    at = lambda c: F.format_string("%.6f", rounded_coordinate(F.col(c)))
    return places.withColumn("url", F.concat(F.lit(f"{base}?s={quote(method)}&k="), signed_key(salt, F.lit(method), day), F.lit("&lat="), at("lat"), F.lit("&long="), at("lon")))


def polled(places: DataFrame, base: str, salt: str, now: datetime, **more) -> DataFrame:
    """location, lat, lon, poll_ts, body of the places whose service answered with 200."""
    asked = forecast_requests(places, base, salt, F.lit(now).cast("date"))
    answered = fetched(asked, **more).where("status = 200")
    return answered.select("location", "lat", "lon", F.lit(now).cast("timestamp").alias("poll_ts"), F.col("content").cast("string").alias("body"))


# ---- features by time


class _Span(InputPartition):
    def __init__(self, start: datetime, end: datetime):
        self.start, self.end = start, end


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        read = lambda name: datetime.fromisoformat(options[name]).replace(tzinfo=None)
        self.start, self.end = read("start"), read("end")
        self.most, self.hours = int(options.get("count", 10_000)), float(options.get("hours", 24))
        self.property = options.get("property", "timestamp")

    def partitions(self) -> list[InputPartition]:
        out, at = [], self.start
        while at <= self.end:
            after = at + timedelta(hours=self.hours)
            out.append(_Span(at, min(after - MILLI, self.end)))
            at = after
        return out or [_Span(self.start, self.start - MILLI)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.start <= partition.end:
            yield from self._span(partition.start, partition.end)

    def _span(self, start: datetime, end: datetime) -> Iterator[tuple]:
        """The features of a span; an answer as long as the service's cap may lack some, so such a span is asked for in halves."""
        iso = lambda t: t.isoformat(timespec="milliseconds") + "Z"
        fixed = urlencode({"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typenames": self.options["typename"], "outputFormat": "application/json", "count": self.most})
        asked = quote(f"{self.property} BETWEEN '{iso(start)}' AND '{iso(end)}'", safe=":")  # the service reads no coded colons
        headers = {k.removeprefix("header."): v for k, v in self.options.items() if k.startswith("header.")}
        with polite_open(f"{self.options['url']}?{fixed}&cql_filter={asked}", headers) as answer:
            features = json.loads(answer.read()).get("features") or []
        if len(features) < self.most:
            for f in features:
                stamp = (f.get("properties") or {}).get(self.property)
                yield (datetime.fromisoformat(stamp).replace(tzinfo=None) if stamp else None), json.dumps(f)
            return
        if end - start < 2 * MILLI:
            raise ValueError(f"{self.most} features or more at {iso(start)}: ask for more at once")
        middle = start + MILLI * ((end - start) // (2 * MILLI))
        yield from self._span(start, middle)
        yield from self._span(middle + MILLI, end)


class NarrowedFeatureReader(FeatureReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the time narrow what is asked for; Spark looks at all of them again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("timestamp",) and isinstance(getattr(f, "value", None), datetime):
                at = f.value.replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, at)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = min(self.end, at)
            yield f


class FeatureSource(DataSource):
    """spark.read.format("wfs_features"): timestamp (UTC, without a zone), feature (JSON) of a feature service, in tasks of ``hours``.

    Options: url, typename, start, end (both ends in), count (the service's cap), hours, property, header.<name>.  With pushdown "true" bounds
    on the timestamp go to the service; spark.sql.python.filterPushdown.enabled has to be set then.
    """

    @classmethod
    def name(cls) -> str:
        return "wfs_features"

    def schema(self) -> str:
        return "timestamp timestamp_ntz, feature string"

    def reader(self, schema) -> DataSourceReader:
        return (NarrowedFeatureReader if self.options.get("pushdown") == "true" else FeatureReader)(self.options)


# ---- elevations and map images


def elevation_answers(requests: DataFrame, base: str, **more) -> DataFrame:
    """cells, body of the requests (batch, cells, locations) that sources.ingest.elevation_requests makes."""
    asked = requests.withColumn("url", F.concat(F.lit(f"{base}?locations="), F.url_encode("locations")))
    answered = fetched(asked, **{"tasks": 1, "pause": 1.0, **more})
    failed = F.raise_error(F.concat(F.lit("no elevations: "), F.coalesce("error", F.col("status").cast("string"))))
    return answered.select("cells", F.when(F.col("status") == 200, F.col("content").cast("string")).otherwise(failed).alias("body"))


def map_requests(times: DataFrame, base: str, layer: str, bbox: tuple[float, float, float, float], size: tuple[int, int], time: str = "time", image: str = "image/geotiff") -> DataFrame:
    """times with name (as suffix_stamp reads it) and url of a layer's image at each time; to be written with format("landing")."""
    west, south, east, north = bbox
    fixed = urlencode({"service": "WMS", "version": "1.3.0", "request": "GetMap", "layers": layer, "styles": "", "crs": "EPSG:4326", "bbox": f"{south},{west},{north},{east}", "width": size[0], "height": size[1], "format": image})
    at = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ending = {"image/geotiff": "tif", "image/png": "png"}[image]
    name = F.concat(F.lit(layer.replace(":", "_") + "_"), F.date_format(time, f"yyyyMMdd'T'HHmmss'Z.{ending}'"))
    return times.select("*", name.alias("name"), F.concat(F.lit(f"{base}?{fixed}&time="), F.url_encode(at)).alias("url"))
