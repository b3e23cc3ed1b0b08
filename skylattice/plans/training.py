"""The aligned training store: radar runs with the stations, the satellite raster and the static channels that were known at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from ..operators.features import with_static
from ..operators.grids import bilinear, distance_to_zero, idw
from ..operators.temporal import asof_backward
from . import caches

# Station fields, the channel's name, centre and scale.
STATION_CHANNELS = {
    "pressure": ("aws_pressure", 1013.0, 20.0),
    "temp_dry_shelter_avg": ("aws_temp", 10.0, 10.0),
    "humidity_rel_shelter_avg": ("aws_humidity", 70.0, 30.0),
    "wind_speed_10m": ("aws_wind", 4.0, 4.0),
}


def station_grids(stations: DataFrame, grid: DataFrame, time: str = "timestamp", channels: dict[str, tuple[str, float, float]] | None = None, least: int = 3) -> DataFrame:
    """time, y, x and a column for each channel: inverse distance over the finite values of a time, normalised.

    A channel with fewer than ``least`` finite values at a time is NaN everywhere at that time.
    """
    channels = channels or STATION_CHANNELS
    long = stations.select(time, "lat", "lon", F.explode(F.array(*[F.struct(F.lit(name).alias("channel"), ((F.col(c).cast("double") - centre) / scale).alias("value")) for c, (name, centre, scale) in channels.items()])).alias("_c")).select(time, "lat", "lon", "_c.*")
    finite = long.where(is_finite("value"))
    full = finite.groupBy(time, "channel").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    field = idw(finite.join(full, [time, "channel"], "left_semi"), grid, [time, "channel"])
    wide = field.groupBy(time, "y", "x").pivot("channel", [name for name, *_ in channels.values()]).agg(F.first("value"))
    every = stations.select(time).distinct().join(F.broadcast(grid.select("y", "x")))
    nan = F.lit(float("nan"))
    return every.join(wide, [time, "y", "x"], "left").select(time, "y", "x", *[F.coalesce(name, nan).alias(name) for name, *_ in channels.values()])


def aligned_store(radar: DataFrame, stations: DataFrame, satellite: DataFrame, static: DataFrame, grid: DataFrame, box: tuple[float, float, float, float], shape: tuple[int, int], *, station_seconds: int = 1800, satellite_seconds: int = 3600, channels: dict[str, tuple[str, float, float]] | None = None) -> DataFrame:
    """issue_time, y, x, leads, radar, the station channels, msg, the static channels and date: a row for each issue time and cell.

    radar has issue_time, lead_min, y, x, rate; stations timestamp, lat, lon and their fields; satellite time, y, x,
    value of rasters of ``shape`` over ``box`` (west, south, east, north); grid y, x, lat, lon.  Stations and
    satellite are the newest not after the issue time within their tolerance; without them their channels are NaN.
    """
    channels = channels or STATION_CHANNELS
    names = [name for name, *_ in channels.values()]
    issues = radar.select("issue_time").distinct()
    newest = lambda rows, time, seconds: asof_backward(issues, rows.select(F.col(time).alias("issue_time")).distinct(), "issue_time", [], [], seconds, bucket_seconds=max(seconds, 3600)).where("right_issue_time IS NOT NULL")
    packed = F.array_sort(F.collect_list(F.struct("lead_min", "rate")))  # as many as a run has leads
    frames = radar.groupBy("issue_time", "y", "x").agg(packed.alias("_p")).select("issue_time", "y", "x", F.transform("_p", lambda p: p["lead_min"]).alias("leads"), F.transform("_p", lambda p: p["rate"]).alias("radar"))
    met = newest(stations, "timestamp", station_seconds)
    used = stations.join(met.select(F.col("right_issue_time").alias("timestamp")).distinct(), "timestamp", "left_semi")
    aws = met.join(station_grids(used, grid, "timestamp", channels).withColumnRenamed("timestamp", "right_issue_time"), "right_issue_time").drop("right_issue_time")
    rows, columns = shape
    west, south, east, north = box
    seen = newest(satellite, "time", satellite_seconds)
    spots = seen.select(F.col("right_issue_time").alias("time")).distinct().join(F.broadcast(grid)).select("time", F.col("y").alias("gy"), F.col("x").alias("gx"), ((north - F.col("lat")) / (north - south) * (rows - 1)).alias("fy"), ((F.col("lon") - west) / (east - west) * (columns - 1)).alias("fx"))
    sampled = bilinear(satellite, spots, ["time"], rows, columns).select(F.col("time").alias("right_issue_time"), F.col("gy").alias("y"), F.col("gx").alias("x"), F.col("value").alias("msg"))
    msg = seen.join(sampled, "right_issue_time").drop("right_issue_time")
    nan = F.lit(float("nan"))
    out = frames.join(aws, ["issue_time", "y", "x"], "left").join(msg, ["issue_time", "y", "x"], "left")
    out = out.withColumns({n: F.coalesce(n, nan) for n in [*names, "msg"]})
    return with_static(out, static, ["y", "x"]).withColumn("date", F.to_date("issue_time"))


def write_store(store: DataFrame, path: str) -> None:
    """One folder a date; dates that are there already are replaced."""
    store.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def refresh_store(radar: DataFrame, stations: DataFrame, satellite: DataFrame, static: DataFrame, grid: DataFrame, box: tuple[float, float, float, float], shape: tuple[int, int], path: str, *, station_seconds: int = 1800, satellite_seconds: int = 3600, **more) -> list[str]:
    """Brings a stored aligned_store() up to date and gives the dates that were made again.

    A date depends on its radar runs, on the stations and satellite images of the day and of the tolerance before it, and on the
    static channels and the grid; only dates whose rows of these have changed are read again and rewritten.
    """

    def by_date(rows: DataFrame, time: str, seconds: int = 0) -> DataFrame:
        later = F.to_date(F.col(time) + F.make_interval(secs=F.lit(seconds)))
        return rows.withColumn("date", F.explode(F.array_distinct(F.array(F.to_date(time), later))))

    def make(r: DataFrame, a: DataFrame, m: DataFrame) -> DataFrame:
        once = lambda rows: rows.drop("date").distinct()  # noqa: E731 - a row near midnight comes with two dates
        dates = r.select("date").distinct()
        store = aligned_store(r.drop("date"), once(a), once(m), static, grid, box, shape, station_seconds=station_seconds, satellite_seconds=satellite_seconds, **more)
        return store.join(dates, "date", "left_semi")

    fixed = caches.table_print([static, grid])
    inputs = {"a_radar": by_date(radar, "issue_time"), "b_stations": by_date(stations, "timestamp", station_seconds), "c_satellite": by_date(satellite, "time", satellite_seconds)}
    return caches.refresh(make, inputs, "date", path, version=fixed)


def static_channels(elevation: DataFrame, pitch_y: float, pitch_x: float) -> DataFrame:
    """y, x, elevation_m, landmask, distance_km (of land to the nearest sea, NULL without any) of y, x, elevation_m."""
    land = elevation.withColumn("landmask", (F.col("elevation_m") > 0).cast("double"))
    far = distance_to_zero(land.select("y", "x", F.col("landmask").alias("value"), F.lit(0).alias("_g")), ["_g"], pitch_y, pitch_x)
    return land.join(far.select("y", "x", F.col("distance").alias("distance_km")), ["y", "x"])


def write_static(channels: DataFrame, path: str, force: bool = False) -> None:
    """Written once; with ``force`` anew."""
    channels.write.mode("overwrite" if force else "ignore").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes rows beside a table, which they may be made from, and puts them in its place; a crash in between leaves the old or the new one beside it."""
    spark = rows.sparkSession
    beside = f"{path}__new"
    rows.write.mode("overwrite").parquet(beside)
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = files.Path(path).getFileSystem(conf)
    fs.delete(files.Path(f"{path}__old"), True)
    if fs.exists(files.Path(path)):
        fs.rename(files.Path(path), files.Path(f"{path}__old"))
    fs.rename(files.Path(beside), files.Path(path))
    fs.delete(files.Path(f"{path}__old"), True)
