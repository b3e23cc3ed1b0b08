"""Queries of what clients show, of small table operations and of the training store, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import tables as B
from ..operators import temporal as T
from ..sources import ingest as I
from . import serving, training, worker
from .catalog import NOW, Tables, _round, _rounded, query

# ---- numbers, names and labels


@query("SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS quantity, (l_extendedprice - 30000) / 15000 AS price FROM lineitem")
def znorm(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return X.normalised(rows, {"quantity": (25, 10), "price": (30000, 15000)})


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 7.0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_defaults(t: Tables) -> DataFrame:
    p = F.from_json("props", "k STRING, missing STRING")
    return t.events.select("event_id", S.lenient_double(p["k"], 7.0).alias("k"), S.or_default(p["missing"], "none").alias("missing"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS name, to_timestamp(epoch(ts)::BIGINT // 300 * 300)::TIMESTAMP AS bucket, strftime(to_timestamp(epoch(ts)::BIGINT // 300 * 300)::TIMESTAMP, '%Y-%m-%dT%H-%M-%SZ') AS bucket_name FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def snapshot_name(t: Tables) -> DataFrame:
    bucket = S.floor_time("ts", 300)
    return t.events.select("event_id", S.snapshot_name("ts").alias("name"), bucket.alias("bucket"), S.snapshot_name(bucket).alias("bucket_name"))


@query("SELECT event_id, round(value / 7, 6) AS lat, round(value / 3, 2) AS lon FROM events")
def coordinate_rounding(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.rounded_coordinate(F.col("value") / 7 + 1e-9).alias("lat"), S.rounded_coordinate(F.col("value") / 3, 2).alias("lon"))


@query("""WITH l AS (SELECT event_id, value / 8 - 1 AS v FROM events), k AS (SELECT event_id, CASE WHEN NOT v > 0 THEN 'none' WHEN v < 2.5 THEN 'light' WHEN v < 7.5 THEN 'moderate' WHEN v < 50 THEN 'heavy' ELSE 'violent' END AS level FROM l)
 SELECT event_id, level, CASE level WHEN 'light' THEN '#9ECAE1' WHEN 'moderate' THEN '#3182BD' WHEN 'heavy' THEN '#FD8D3C' WHEN 'violent' THEN '#E31A1C' END AS colour, CASE level WHEN 'none' THEN chr(8211) ELSE upper(level[1]) || level[2:] END AS label FROM k""")
def level_labels(t: Tables) -> DataFrame:
    level = S.rain_level(F.col("value") / 8 - 1)
    return t.events.select("event_id", level.alias("level"), S.level_style(level).alias("s")).select("event_id", "level", "s.*")


@query("""WITH f AS (SELECT user_id, list(value ORDER BY ts, event_id) AS frames FROM events GROUP BY 1) SELECT user_id, frames[CAST(user_id % 200 AS INTEGER) + 1] AS frame, CASE WHEN len(frames) > 0 THEN (user_id % 200 + 1) % len(frames) END AS next FROM f""")
def frame_and_playback(t: Tables) -> DataFrame:
    frames = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("frames"))
    at = F.col("user_id") % 200
    return frames.select("user_id", S.frame_at("frames", at).alias("frame"), S.next_frame(at, F.size("frames")).alias("next"))


@query("WITH m AS (SELECT user_id, max(value / 1000) AS largest FROM events GROUP BY 1) SELECT event_id, round(value / 1000 / greatest(largest, 0.5), 6) AS height FROM events JOIN m USING (user_id)")
def chart_heights(t: Tables) -> DataFrame:
    largest = t.events.groupBy("user_id").agg(F.max(F.col("value") / 1000).alias("largest"))
    return t.events.join(largest, "user_id").select("event_id", _round(S.bar_height(F.col("value") / 1000, "largest")).alias("height"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 50.8503 ELSE c_acctbal END AS lat FROM customer")
def default_location(t: Tables) -> DataFrame:
    fix = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", S.or_default(fix, I.PLACES["brussels"][0]).alias("lat"))


@query("SELECT o_orderkey, date_trunc('minute', o_orderdate + to_minutes(o_orderkey % 1440)) AS stamp FROM orders")
def suffix_stamps(t: Tables) -> DataFrame:
    at = S.plus_minutes("o_orderdate", F.col("o_orderkey") % 1440)
    return t.orders.select("o_orderkey", S.suffix_stamp(F.concat(F.lit("msg_ir108_"), F.date_format(at, "yyyyMMdd'T'HHmm'Z.tif'"))).alias("stamp"))


@query("""WITH p AS (SELECT * FROM (VALUES ('antwerp', 51.2194::DOUBLE, 4.4025::DOUBLE, 0), ('arlon', 49.6839, 5.8167, 1), ('bruges', 51.2093, 3.2247, 2), ('brussels', 50.8503, 4.3517, 3), ('charleroi', 50.4108, 4.4446, 4), ('ghent', 51.0543, 3.7174, 5), ('liege', 50.6326, 5.5797, 6), ('ostend', 51.2247, 2.9069, 7)) v(location, lat, lon, k))
 SELECT location, lat, lon, count(*) AS polls, max(ts) AS newest FROM events JOIN p ON user_id % 10 = k GROUP BY 1, 2, 3""")
def polled_places(t: Tables) -> DataFrame:
    """Polls by place: events stand for polls, two users in ten for places that are not known."""
    names = F.array(*[F.lit(x) for x in [*sorted(I.PLACES), "atlantis", "lyonesse"]])
    polls = t.events.select(F.get(names, (F.col("user_id") % 10).cast("int")).alias("location"), "ts")
    return I.known_places(polls, I.places(t.spark)).groupBy("location", "lat", "lon").agg(F.count("*").alias("polls"), F.max("ts").alias("newest"))


# ---- tables


@query(f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def now_window(t: Tables) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 48 HOURS")
    return B.around_now(t.events.select("event_id", "ts"), "ts", now, "24 HOURS", "24 HOURS")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def half_open_range(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return B.half_open(t.events.select("event_id", "ts"), "ts", day("2024-01-05"), day("2024-01-09"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head_rows(t: Tables) -> DataFrame:
    return B.head(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 1000")
def listing_page(t: Tables) -> DataFrame:
    return B.page(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 2).select("o_orderkey")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 200")
def capped_rows(t: Tables) -> DataFrame:
    return B.capped(t.events.select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 200).select("event_id")


@query("WITH h AS (SELECT event_id, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) - 1 AS place FROM events) SELECT event_id, place, place // 64 AS batch FROM h")
def shuffled_batches(t: Tables) -> DataFrame:
    return B.batches(t.events.select("event_id"), ["event_id"], 64, 7).select("event_id", "place", "batch")


@query("SELECT o_orderkey, coalesce(n, 0) * 1.0::DOUBLE AS lines, o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) USING (o_orderkey)")
def channel_merge(t: Tables) -> DataFrame:
    channel = t.lineitem.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    once = B.merged_channel(t.orders.select("o_orderkey", "o_totalprice"), channel, ["o_orderkey"], "lines")
    return B.merged_channel(once, channel, ["o_orderkey"], "lines")


@query("SELECT event_type, count(*) AS considered, count(*) FILTER (value < 50) AS dry, count(*) FILTER (props IS NULL) AS missing FROM events GROUP BY 1")
def row_counters(t: Tables) -> DataFrame:
    return B.counters(t.events, ["event_type"], dry=F.col("value") < 50, missing=F.col("props").isNull())


@query("WITH e AS (SELECT event_id, date_trunc('hour', ts) AS hour, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events), n AS (SELECT hour, count(v) AS n FROM e GROUP BY 1) SELECT event_id, CASE WHEN n >= 3 THEN v ELSE 'nan'::DOUBLE END AS v FROM e JOIN n USING (hour)")
def station_rule(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", S.floor_time("ts", 3600).alias("hour"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return B.enough_stations(rows, ["hour"], "v").select("event_id", "v")


@query("""WITH l AS (SELECT event_id, date_trunc('hour', ts) AS ts FROM events WHERE event_type = 'purchase'), r AS (SELECT date_trunc('hour', ts) AS ts, user_id, value FROM events WHERE event_type = 'error'),
 d AS (SELECT DISTINCT ts FROM r), m AS (SELECT l.*, d.ts AS rts FROM l ASOF JOIN d ON l.ts >= d.ts) SELECT event_id, count(*) AS stations, round(sum(r.value), 6) AS total FROM m JOIN r ON r.ts = m.rts WHERE epoch(m.ts) - epoch(m.rts) <= 3600 GROUP BY 1""")
def asof_whole_set(t: Tables) -> DataFrame:
    hour = S.floor_time("ts", 3600)
    left = t.events.where("event_type = 'purchase'").select("event_id", hour.alias("ts"))
    met = T.asof_set(left, t.errors().select(hour.alias("ts"), "user_id", "value"), "ts", [], ["user_id", "value"], 3600)
    return met.groupBy("event_id").agg(F.count("*").alias("stations"), _round(F.sum("value")).alias("total"))


# ---- feeds and the store


@query("SELECT event_id, date_trunc('second', ts) AS issued_at, 'unknown' AS model_version, CASE WHEN k = 0 THEN 'nowcast' ELSE 'short' END AS band, CAST(k * 60 AS INTEGER) AS lead_min, date_trunc('second', ts) + to_minutes(k * 60) AS valid_time, CASE WHEN k = 0 THEN 0.0 ELSE value END AS rate, '' AS overlay_url FROM events, (SELECT unnest([0, 1]) AS k)")
def forecast_documents(t: Tables) -> DataFrame:
    """Documents made from events: two good frames (one with gaps), one that is no object and one without a time."""
    at = lambda m: F.concat(F.date_format(F.date_trunc("second", "ts") + F.expr(f"INTERVAL {m} MINUTE"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    gaps = F.concat(F.lit('{"valid_time": "'), at(0), F.lit('", "rate_mm_per_h": "x"}'))
    full = F.concat(F.lit('{"band": "short", "lead_min": 60, "rate_mm_per_h": '), F.col("value").cast("string"), F.lit(', "valid_time": "'), at(60), F.lit('"}'))
    body = F.concat(F.lit('{"issued_at": "'), at(0), F.lit('", "frames": ['), gaps, F.lit(", 7, "), full, F.lit(', {"band": "long"}]}'))
    return I.forecast_body_rows(t.events.select("event_id", body.alias("body")), ["event_id"])


@query("SELECT CAST(i // 100 AS BIGINT) AS batch, string_agg(printf('%.6f,%.6f', 49 + (i * 37 % 350) / 100.0::DOUBLE, 1.5::DOUBLE + (i * 53 % 580) / 100.0::DOUBLE), '|' ORDER BY i) AS locations, count(*) AS cells FROM (SELECT c_custkey AS i FROM customer) GROUP BY 1")
def elevation_batches(t: Tables) -> DataFrame:
    """Requests of a hundred places each: customers stand for the cells of a grid twelve wide."""
    k = F.col("c_custkey")
    cells = t.customer.select(F.floor(k / 12).alias("y"), (k % 12).alias("x"), (49 + k * 37 % 350 / 100.0).alias("lat"), (F.lit(1.5) + k * 53 % 580 / 100.0).alias("lon"))
    return I.elevation_requests(cells, 12).select("batch", "locations", F.size("cells").cast("long").alias("cells"))


@query("""WITH g AS (SELECT CAST(vec_id AS INTEGER) AS y, CAST(i AS INTEGER) AS x, floor(CAST(embedding[i + 1] AS DOUBLE) * 100 + 22) AS h FROM embeddings, (SELECT unnest(range(0, 64)) AS i)), sea AS (SELECT y AS sy, x AS sx FROM g WHERE h <= 0),
 d AS (SELECT y, x, h, min((y - sy) * 4.0::DOUBLE * ((y - sy) * 4.0::DOUBLE) + (x - sx) * 3.0::DOUBLE * ((x - sx) * 3.0::DOUBLE)) AS d2 FROM g LEFT JOIN sea ON true GROUP BY 1, 2, 3)
 SELECT y, x, h AS elevation_m, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS landmask, round(sqrt(d2), 6) AS distance_km FROM d""")
def static_channels(t: Tables) -> DataFrame:
    """Mask and distance to the sea of a field of heights: a row for each vector, a column for each component."""
    heights = t.embeddings.select(F.col("vec_id").cast("int").alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "e")).select("y", "x", F.floor(F.col("e") * 100 + 22).cast("double").alias("elevation_m"))
    return _rounded(training.static_channels(heights, 4.0, 3.0), "distance_km")


_GRID = serving.Grid(height=3, width=4)
_GRID_SQL = "g AS (SELECT CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, 52.5::DOUBLE + (i // 4) * (48.9::DOUBLE - 52.5::DOUBLE) / 2 AS lat, 1.5::DOUBLE + (i % 4) * (7.5::DOUBLE - 1.5::DOUBLE) / 3 AS lon FROM (SELECT unnest(range(0, 12)) AS i))"


def _payloads(t: Tables) -> DataFrame:
    """Payloads of suppliers' places: frames 20 minutes apart and three hours."""
    k = F.col("s_suppkey")
    frames = F.array(*[F.struct(F.lit(f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00+00:00").alias("time"), (k % 7 + m / 20).cast("string").alias("value")) for m in range(0, 120, 20)])
    hours = F.array(*[F.struct(F.lit(str(h)).alias("hour"), F.lit(v).alias("precipQuantity")) for h, v in enumerate(["0.5", "1.25", None])])
    body = F.to_json(F.struct(F.struct(frames.alias("sequence")).alias("animation"), F.struct(hours.alias("hourly")).alias("for")))
    place = t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("location"), (49 + k * 37 % 350 / 100).alias("lat"), (F.lit(1.6) + k * 53 % 580 / 100).alias("lon"), body.alias("body"))
    return place


@query(f"""WITH {_GRID_SQL}, s AS (SELECT s_suppkey AS k, 49 + (s_suppkey * 37 % 350) / 100.0::DOUBLE AS lat, 1.6::DOUBLE + (s_suppkey * 53 % 580) / 100.0::DOUBLE AS lon FROM supplier), l AS (SELECT CAST(unnest(range(0, 120, 10)) AS INTEGER) AS lead_min),
 v AS (SELECT k, lat, lon, lead_min, (k % 7 + least(CASE WHEN lead_min % 20 = 10 THEN lead_min - 10 ELSE lead_min END, 100) / 20.0::DOUBLE) * 6 AS v FROM s, l),
 w AS (SELECT lead_min, y, x, v, 1 / ((g.lat - v.lat) * (g.lat - v.lat) + (g.lon - v.lon) * (g.lon - v.lon) + 1e-9) AS w FROM v, g) SELECT lead_min, y, x, round(sum(w * v) / sum(w), 4) AS rate FROM w GROUP BY 1, 2, 3""")
def stand_in_nowcast(t: Tables) -> DataFrame:
    return worker.stand_in(_payloads(t), serving.BANDS[0], _GRID).withColumn("rate", F.round("rate", 4))


@query(f"WITH {_GRID_SQL}, p AS (SELECT max(s_suppkey) AS k FROM supplier) SELECT CAST(lead_min AS INTEGER) AS lead_min, y, x, ((k % 5 + least(lead_min // 60, 4)) / 4.0)::DOUBLE AS rate FROM g, p, (SELECT unnest(range(0, 720, 60)) AS lead_min) WHERE lead_min >= 120")
def stand_in_hourly(t: Tables) -> DataFrame:
    """Suppliers stand for polls of one place, the last of which counts."""
    k = F.col("s_suppkey")
    hours = F.array(*[F.struct(F.lit(str(h)).alias("hour"), ((k % 5 + h) / 4).cast("string").alias("precipQuantity")) for h in range(5)])
    body = F.to_json(F.struct(F.struct(hours.alias("hourly")).alias("for")))
    polls = t.supplier.select(F.lit("brussels").alias("location"), F.lit(50.8503).alias("lat"), F.lit(4.3517).alias("lon"), F.timestamp_seconds(k * 300).alias("poll_ts"), body.alias("body"))
    return worker.stand_in(polls, serving.BANDS[1], _GRID)


@query("WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, length(e) AS cells, round(e[1], 6) AS first, round(e[64], 6) AS last FROM r")
def band_tensor(t: Tables) -> DataFrame:
    from ..operators.grids import stack

    tensors = stack(t.rasters(), ["vec_id"], 8)
    return tensors.select("vec_id", F.size("values").cast("long").alias("cells"), _round(F.get("values", 0)).alias("first"), _round(F.get("values", 63)).alias("last"))
