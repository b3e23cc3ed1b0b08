"""Queries of feeds, stores and searches that work in several steps, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.folders import fresh_path
from ..operators import grids as G
from ..operators import tables as B
from ..operators import verification as V
from ..sources import ingest as I
from ..sources import rasters
from ..streaming.asof import asof_stream
from . import archive, caches, serving, tars
from .catalog import _ALL_SCORES, _ASOF, _CONT, _PAIRS, _SCORES, _SHARDS, _TABLE, NOW, Tables, _rounded, query

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(f"WITH {_ASOF} SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 21600000000 THEN rts END AS right_ts, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 21600000000 THEN rv END AS value FROM m")
def stream_asof(t: Tables) -> DataFrame:
    """Events landed in two batches, the later half after the earlier; an empty row a month on lets the last ones be answered."""
    spark, place, files = t.spark, fresh_path(t.spark, "asof"), 8
    ends = t.events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if ends.low is None:
        return t.events.select("event_id", "user_id", "ts", F.col("ts").alias("right_ts"), "value")
    middle = F.lit(ends.low + (ends.high - ends.low) / 2).cast("timestamp_ntz")
    last = t.events.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.events.schema]).withColumns({"ts": F.lit(ends.high).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS"), "event_type": F.lit("end")})
    for part in (t.events.where(F.col("ts") < middle), t.events.where(F.col("ts") >= middle).unionByName(last)):
        part.repartition(files).write.mode("append").parquet(f"{place}/in")
    feed = spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    left = feed.where("event_type != 'error'").select("event_id", "user_id", "ts")
    right = feed.where("event_type = 'error'").select("user_id", "ts", "value")
    out = asof_stream(left, right, "ts", ["user_id"], ["value"], 21600, late="20 days")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        out.writeStream.outputMode("append").format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(out.schema).parquet(f"{place}/rows").where("event_id IS NOT NULL")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-03-01', 500) ORDER BY o_orderdate, o_orderkey LIMIT 500")
def listing_seek(t: Tables) -> DataFrame:
    after = [F.lit("1996-03-01 00:00:00").cast("timestamp_ntz"), F.lit(500)]
    return B.page_after(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], after)


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 997) / 50.0::DOUBLE AS lat, (o_custkey % 613) / 50.0::DOUBLE AS lon FROM orders), c AS (SELECT s_suppkey AS cell, (s_suppkey * 37 % 499) / 50.0::DOUBLE AS lat, (s_suppkey * 53 % 311) / 50.0::DOUBLE AS lon FROM supplier),
 p AS (SELECT DISTINCT lat, lon FROM o), m AS (SELECT p.lat, p.lon, min(struct_pack(d2 := (p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon), cell := cell)) AS b FROM p, c GROUP BY 1, 2)
 SELECT o_orderkey, b.cell AS cell, round(b.d2, 6) AS d2 FROM o JOIN m USING (lat, lon)""")
def nearest_anywhere(t: Tables) -> DataFrame:
    """Suppliers fill a quarter of the area: most orders have none in their own bucket or around it."""
    points = t.orders.select("o_orderkey", (F.col("o_orderkey") % 997 / 50.0).alias("lat"), (F.col("o_custkey") % 613 / 50.0).alias("lon"))
    cells = t.supplier.select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") * 37 % 499 / 50.0).alias("lat"), (F.col("s_suppkey") * 53 % 311 / 50.0).alias("lon"))
    return _rounded(G.nearest_anywhere(points, cells, step=0.5), "d2").select("o_orderkey", "cell", "d2")


def _store(t: Tables) -> DataFrame:
    """A store of states, filled in two turns: the later half of the runs first, then all runs but the last day's."""
    pairs, path = t.pairs(), fresh_path(t.spark, "runs")
    at = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    V.add_runs(t.spark, pairs.where(F.col("issue_time") >= at(15)), [10, 50], path)
    V.add_runs(t.spark, pairs.where(F.col("issue_time") < at(16)), [10, 50], path)
    return V.stored_states(t.spark, path)


@query(f"WITH {_PAIRS} SELECT lead_min, {_CONT} FROM pairs GROUP BY lead_min")
def verify_added_runs(t: Tables) -> DataFrame:
    return _rounded(V.merged_continuous(_store(t)), "mae", "rmse", "bias")


@query(f"WITH {_PAIRS}, c AS (SELECT tau AS threshold, lead_min, {_TABLE} FROM pairs, (SELECT unnest([10.0::DOUBLE, 50.0::DOUBLE]) AS tau) GROUP BY ALL) SELECT *, {_SCORES} FROM c")
def verify_added_tables(t: Tables) -> DataFrame:
    return _rounded(V.merged_categorical(_store(t)), *_ALL_SCORES)


@query("SELECT lead_min, issue_time, y, x FROM (SELECT *, row_number() OVER (PARTITION BY lead_min ORDER BY md5(concat_ws('|', '3', strftime(issue_time, '%Y-%m-%d %H:%M:%S'), y, x)), issue_time, y, x) AS rn FROM (WITH " + _PAIRS + " SELECT lead_min, issue_time, y, x FROM pairs)) WHERE rn <= 40")
def sample_by_lead(t: Tables) -> DataFrame:
    return V.sampled(t.pairs().select("lead_min", "issue_time", "y", "x"), 40, ["lead_min"], ["issue_time", "y", "x"], seed=3)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5('0|' || event_id), event_id) AS rn FROM events) WHERE rn <= 250")
def sample_overall(t: Tables) -> DataFrame:
    return V.sampled(t.events.select("event_id"), 250, [], ["event_id"])


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, CASE WHEN CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) THEN value * 2 ELSE value END AS value FROM events), d AS (SELECT day, user_id, count(*) AS n, round(max(value), 6) AS peak FROM e GROUP BY 1, 2)
 SELECT strftime(day, '%Y-%m-%d') AS day, user_id, n, peak, day = (SELECT max(day) FROM e) AS made_again FROM d""")
def cache_refresh(t: Tables) -> DataFrame:
    """A cache by day, made, and refreshed after the last day's values have changed: that day alone is made again."""
    path = fresh_path(t.spark, "cache")
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = t.events.select(day.alias("day"), "user_id", "value")
    last = t.events.agg(F.max(day)).first()[0]
    make = lambda r: r.groupBy("day", "user_id").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    caches.refresh(make, {"events": rows}, "day", path)
    changed = rows.withColumn("value", F.when(F.col("day") == last, F.col("value") * 2).otherwise(F.col("value")))
    again = caches.refresh(make, {"events": changed}, "day", path)
    marked = caches.read(t.spark, path).withColumn("made_again", F.col("day").isin(again))
    return _rounded(marked, "peak").select("day", "user_id", "n", "peak", "made_again")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def archive_members(t: Tables) -> DataFrame:
    """Documents as members of an archive, read back at the places that its index gives."""
    path = f"{fresh_path(t.spark, 'archive')}/documents.tar"
    rows = t.documents.where("text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    tars.write_tar(rows, path)
    back = tars.contents(tars.read_index(t.spark, path), path)
    return back.select(F.regexp_extract("name", r"^(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))


@query("""WITH v AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i))
 SELECT CAST(vec_id AS BIGINT) AS vec_id, count(*) FILTER (v > 0 AND floor(least(v / 0.3, 1.0) * 220) >= 1) AS wet, CAST(coalesce(sum(i) FILTER (v > 0 AND floor(least(v / 0.3, 1.0) * 220) >= 1), 0) AS BIGINT) AS places FROM v GROUP BY 1""")
def alpha_mask(t: Tables) -> DataFrame:
    """Vectors drawn as overlays and read back: where an image is not transparent."""
    drawn = serving.overlays(t.embeddings.select(F.col("vec_id").cast("string").alias("band"), F.lit(0).alias("lead_min"), F.col("embedding").cast("array<float>").alias("rates")), 8, 8)
    masks = rasters.rasters(drawn.select(F.col("band").alias("path"), F.col("png").alias("content")), rasters.png_mask)
    cells = masks.select(F.col("path").cast("long").alias("vec_id"), F.posexplode("values").alias("i", "wet"))
    return cells.groupBy("vec_id").agg(F.sum(F.col("wet").cast("long")).alias("wet"), F.sum(F.when(F.col("wet") > 0, F.col("i")).otherwise(0)).alias("places"))


@query("""WITH g AS (SELECT CAST(user_id % 7 AS INTEGER) AS k, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) AS INTEGER) AS x, min(50 + value / 100) AS lat, max(4 + value / 50) AS lon FROM events GROUP BY 1, 2, 3),
 d AS (SELECT k, lat, abs(lat - lag(lat) OVER (PARTITION BY k, x ORDER BY y)) AS dy, abs(lon - lag(lon) OVER (PARTITION BY k, y ORDER BY x)) AS dx FROM g)
 SELECT k, round(avg(dy) * (pi() / 180 * 6371), 6) AS pitch_y_km, round(avg(dx) * (pi() / 180 * 6371) * cos(radians(avg(lat))), 6) AS pitch_x_km FROM d GROUP BY 1""")
def pitch_in_km(t: Tables) -> DataFrame:
    cells = t.events.groupBy((F.col("user_id") % 7).cast("int").alias("k"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x")).agg(F.min(50 + F.col("value") / 100).alias("lat"), F.max(4 + F.col("value") / 50).alias("lon"))
    return _rounded(G.grid_pitch_km(cells, ["k"]), "pitch_y_km", "pitch_x_km")


@query("""WITH n AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'RAD_NL25_' || strftime(o_orderdate, '%Y%m%d%H%M') || '.h5' WHEN 1 THEN 'msg_ir108_' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '.tif' ELSE 'notes_' || strftime(o_orderdate, '%Y%m%d') || '.txt' END AS name, strftime(o_orderdate, '%Y%m') AS m, o_orderkey % 3 AS r FROM orders)
 SELECT CASE WHEN r < 2 THEN m END AS month, count(*) AS files, min(name) AS first_name FROM n GROUP BY 1""")
def months_of_names(t: Tables) -> DataFrame:
    at, kind = F.col("o_orderdate"), F.col("o_orderkey") % 3
    radar = F.concat(F.lit("RAD_NL25_"), F.date_format(at, "yyyyMMddHHmm"), F.lit(".h5"))
    image = F.concat(F.lit("msg_ir108_"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z.tif'"))
    notes = F.concat(F.lit("notes_"), F.date_format(at, "yyyyMMdd"), F.lit(".txt"))
    names = t.orders.select(F.when(kind == 0, radar).when(kind == 1, image).otherwise(notes).alias("name"))
    return names.groupBy(archive.month_of(F.col("name")).alias("month")).agg(F.count("*").alias("files"), F.min("name").alias("first_name"))


@query(f"""WITH {_SHARDS} SELECT cell, band, lead_min, TIMESTAMP '{NOW}' + to_minutes(lead_min) AS valid_time, rate, 'https://host/v1/overlay/' || band || '/' || lead_min || '.png?t=snap' AS url, row_number() OVER (PARTITION BY cell ORDER BY lead_min, band) - 1 AS place FROM shards WHERE lead_min <= 720""")
def response_frames(t: Tables) -> DataFrame:
    """A JSON response for every cell, as a server gives it, and what a client shows of it: frames in time order with whole addresses."""
    rows = t.shards().where("lead_min <= 720").withColumns({"valid_time": S.plus_minutes(F.lit(NOW).cast("timestamp_ntz"), F.col("lead_min")), "overlay_url": S.overlay_url(F.col("band"), F.col("lead_min"), F.lit("snap"))})
    bodies = rows.groupBy("cell").agg(serving.response_body(F.lit(NOW), F.first("lat"), F.first("lon"), "stub", 720).alias("body"))
    frames = I.forecast_body_rows(bodies, ["cell"])
    shown = frames.withColumn("place", (F.row_number().over(Window.partitionBy("cell").orderBy("valid_time", "band")) - 1).cast("long"))
    return shown.select("cell", "band", "lead_min", "valid_time", "rate", S.absolute_url(F.lit("https://host/"), F.col("overlay_url")).alias("url"), "place")
