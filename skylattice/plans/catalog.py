"""Every query by name over the star-schema and event tables, each with its SQL oracle.

Events stand for observations: an hour and a cell made from the user id hold the largest
value.  Forecasts are made from them with an error that depends on lead and cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.folders import fresh_path
from ..operators import features as X
from ..operators import grids as G
from ..operators import temporal as T
from ..operators import verification as V
from ..sources import ingest as I
from ..streaming import ticks
from . import archive, serving

EDGES = [0.0, 5.0, 20.0, 50.0, 100.0, 200.0, 500.0, float("inf")]
LABELS = ["b1", "b2", "b3", "b4", "b5", "b6", "b7"]
LEADS = 13
NOW = "2024-01-31 00:00:00"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, and what is made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def obs(self) -> DataFrame:
        e = self.events.select(S.floor_time("ts", 3600).alias("valid_time"), F.floor(F.col("user_id") % 20 / 5).cast("int").alias("y"), (F.col("user_id") % 5).cast("int").alias("x"), "value")
        return e.groupBy("valid_time", "y", "x").agg(F.max("value").alias("rate"))

    def fc(self) -> DataFrame:
        k = F.col("k")
        wobble = 1 + (((k * 7 + F.col("y") * 3 + F.col("x")) % 5) - 2) * F.lit(0.1)
        return self.obs().select("*", F.explode(F.sequence(F.lit(0), F.lit(LEADS - 1))).alias("k")).select(F.col("valid_time").alias("issue_time"), "y", "x", (k * 60).cast("int").alias("lead_min"), (F.col("rate") * wobble).alias("rate"))

    def pairs(self) -> DataFrame:
        return V.pair(self.fc(), self.obs())

    def rasters(self) -> DataFrame:
        """vec_id, y, x, value: vectors of 64 as 8 x 8 rasters."""
        return G.melt(self.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), ["vec_id"], "e", 8)

    def calm(self) -> DataFrame:
        return self.events.where("event_type != 'error'").select("event_id", "user_id", "ts")

    def errors(self) -> DataFrame:
        return self.events.where("event_type = 'error'").select("event_id", "user_id", "ts", "value")

    def shards(self) -> DataFrame:
        """Points of a 20 x 20 grid: an event stands for the cell of its user and for one of the 106 leads."""
        lead, user = F.col("event_id") % 106, F.col("user_id") % 400
        start, step = (F.when(lead < 12, x[0]).when(lead < 22, x[1]).when(lead < 34, x[2]).otherwise(x[3]) for x in ((0, 120, 720, 1440), (10, 60, 60, 180)))
        first = F.when(lead < 12, 0).when(lead < 22, 12).when(lead < 34, 22).otherwise(34)
        band = F.when(lead < 12, "nowcast").when(lead < 22, "short").when(lead < 34, "medium").otherwise("long")
        cells = self.events.select(band.alias("band"), (start + (lead - first) * step).cast("int").alias("lead_min"), F.floor(user / 20).cast("int").alias("y"), (user % 20).cast("int").alias("x"), "value")
        return serving.point_shards(cells.groupBy("band", "lead_min", "y", "x").agg(F.max("value").alias("rate")), serving.Grid(height=20, width=20))


_OBS = """obs AS (SELECT date_trunc('hour', ts) AS valid_time, CAST(floor((user_id % 20) / 5.0) AS INTEGER) AS y, CAST(user_id % 5 AS INTEGER) AS x, max(value) AS rate FROM events GROUP BY 1, 2, 3)"""
_FC = _OBS + """, fc AS (SELECT valid_time AS issue_time, y, x, CAST(k * 60 AS INTEGER) AS lead_min, rate * (1 + ((k * 7 + y * 3 + x) % 5 - 2) * CAST(0.1 AS DOUBLE)) AS rate FROM obs, (SELECT unnest(range(0, 13)) AS k))"""
_PAIRS = _FC + """, pairs AS (SELECT fc.issue_time, fc.lead_min, fc.y, fc.x, fc.rate AS forecast, obs.rate AS observed FROM fc JOIN obs ON obs.valid_time = fc.issue_time + to_minutes(fc.lead_min) AND obs.y = fc.y AND obs.x = fc.x)"""
_CONT = """count(*) AS n, round(avg(abs(forecast - observed)), 6) AS mae, round(sqrt(avg((forecast - observed) * (forecast - observed))), 6) AS rmse, round(avg(forecast - observed), 6) AS bias"""
_TABLE = """count(*) FILTER (forecast >= tau AND observed >= tau) AS hits, count(*) FILTER (forecast < tau AND observed >= tau) AS misses, count(*) FILTER (forecast >= tau AND observed < tau) AS false_alarms, count(*) FILTER (forecast < tau AND observed < tau) AS correct_negatives"""
_SCORES = """round(CASE WHEN hits + misses <> 0 THEN hits / (hits + misses) END, 6) AS pod, round(CASE WHEN hits + false_alarms <> 0 THEN false_alarms / (hits + false_alarms) END, 6) AS far, round(CASE WHEN hits + misses + false_alarms <> 0 THEN hits / (hits + misses + false_alarms) END, 6) AS csi,
  round(CASE WHEN (hits + misses) * (misses + correct_negatives) + (hits + false_alarms) * (false_alarms + correct_negatives) <> 0 THEN 2.0::DOUBLE * (hits * correct_negatives - misses * false_alarms) / ((hits + misses) * (misses + correct_negatives) + (hits + false_alarms) * (false_alarms + correct_negatives)) END, 6) AS hss"""
_BAND = """CASE WHEN observed > 0 AND observed <= 5 THEN 'b1' WHEN observed > 5 AND observed <= 20 THEN 'b2' WHEN observed > 20 AND observed <= 50 THEN 'b3' WHEN observed > 50 AND observed <= 100 THEN 'b4' WHEN observed > 100 AND observed <= 200 THEN 'b5' WHEN observed > 200 AND observed <= 500 THEN 'b6' WHEN observed > 500 THEN 'b7' END"""
_RASTER = """r AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"""
_LEADS = """leads AS (SELECT 'nowcast' AS band, unnest(range(0, 120, 10)) AS lead_min, 290 AS max_age UNION ALL SELECT 'short', unnest(range(120, 720, 60)), 3590 UNION ALL SELECT 'medium', unnest(range(720, 1440, 60)), 10790 UNION ALL SELECT 'long', unnest(range(1440, 14400, 180)), 43190)"""
_SHARDS = _LEADS + """, numbered AS (SELECT *, row_number() OVER (ORDER BY CASE band WHEN 'nowcast' THEN 0 WHEN 'short' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, lead_min) - 1 AS k FROM leads),
 shards AS (SELECT band, CAST(lead_min AS INTEGER) AS lead_min, y, x, max(value) AS rate, 52.5::DOUBLE + y * (48.9::DOUBLE - 52.5::DOUBLE) / 19 AS lat, 1.5::DOUBLE + x * (7.5::DOUBLE - 1.5::DOUBLE) / 19 AS lon, y * 20 + x AS cell
   FROM (SELECT event_id % 106 AS k, CAST(user_id % 400 // 20 AS INTEGER) AS y, CAST(user_id % 20 AS INTEGER) AS x, value FROM events) JOIN numbered USING (k) GROUP BY band, lead_min, y, x)"""


def _nudged(sql: str) -> str:
    """round(x, 6) as round(x + 1e-9, 6), as _round() does: exact halves then fall alike in both engines."""
    out, at = "", 0
    while (found := sql.find("round(", at)) >= 0:
        depth, end = 1, found + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _nudged(sql[found + 6 : end - 1])
        if inner.endswith(", 6"):
            inner = f"{inner[:-3]} + 1e-9, 6"
        out += sql[at:found] + f"round({inner})"
        at = end
    return out + sql[at:]


def query(sql: str | None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Tables(spark, folder))

        _QUERIES[f.__name__] = run
        if sql:
            _ORACLES[f.__name__] = _nudged(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _round(c) for c in columns})


def _round(x) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, 6)


_ALL_SCORES = ("pod", "far", "csi", "hss")

# ---- verification


@query(f"WITH {_PAIRS} SELECT lead_min, {_CONT} FROM pairs GROUP BY lead_min")
def verify_continuous(t: Tables) -> DataFrame:
    return _rounded(V.continuous(t.pairs()), "mae", "rmse", "bias")


@query(f"WITH {_PAIRS}, c AS (SELECT lead_min, {_TABLE.replace('tau', '50')} FROM pairs GROUP BY lead_min) SELECT *, {_SCORES} FROM c")
def verify_categorical(t: Tables) -> DataFrame:
    return _rounded(V.categorical(t.pairs(), 50.0), *_ALL_SCORES)


@query(f"WITH {_PAIRS}, c AS (SELECT tau AS threshold, lead_min, {_TABLE} FROM pairs, (SELECT unnest([10.0::DOUBLE, 50.0::DOUBLE, 100.0::DOUBLE]) AS tau) GROUP BY ALL) SELECT *, {_SCORES} FROM c")
def verify_multi_threshold(t: Tables) -> DataFrame:
    return _rounded(V.categorical_sweep(t.pairs(), [10, 50, 100]), *_ALL_SCORES)


_PERSIST = "p AS (SELECT b.lead_min, sqrt(avg((a.observed - b.observed) * (a.observed - b.observed))) AS rmse_persistence FROM pairs a JOIN pairs b ON a.lead_min = 0 AND a.issue_time = b.issue_time AND a.y = b.y AND a.x = b.x GROUP BY b.lead_min)"


@query(f"WITH {_PAIRS}, {_PERSIST} SELECT lead_min, round(rmse_persistence, 6) AS rmse_persistence FROM p")
def verify_persistence(t: Tables) -> DataFrame:
    return _rounded(V.persistence(t.pairs()), "rmse_persistence")


@query(f"WITH {_PAIRS}, {_PERSIST}, c AS (SELECT lead_min, count(*) AS n, sqrt(avg((forecast - observed) * (forecast - observed))) AS rmse FROM pairs GROUP BY 1) SELECT lead_min, n, round(rmse, 6) AS rmse, round(rmse_persistence, 6) AS rmse_persistence, round(CASE WHEN rmse_persistence <> 0 THEN 1 - (rmse * rmse) / (rmse_persistence * rmse_persistence) END, 6) AS skill FROM c JOIN p USING (lead_min)")
def verify_skill(t: Tables) -> DataFrame:
    return _rounded(V.skill(t.pairs()), "rmse", "rmse_persistence", "skill")


@query(f"WITH {_PAIRS} SELECT lead_min, {_BAND} AS band, round(avg(forecast - observed), 6) AS bias, count(*) AS n FROM pairs WHERE observed > 0 GROUP BY 1, 2")
def verify_intensity_strata(t: Tables) -> DataFrame:
    return _rounded(V.strata(t.pairs(), EDGES, LABELS), "bias")


@query(f"WITH {_PAIRS}, s AS (SELECT lead_min, {_BAND} AS band, forecast - observed AS e FROM pairs) SELECT lead_min, " + ", ".join(f"round(avg(e) FILTER (band = '{b}'), 6) AS {b}" for b in LABELS) + " FROM s WHERE band IS NOT NULL GROUP BY 1")
def verify_bias_pivot(t: Tables) -> DataFrame:
    return _rounded(V.strata_pivot(t.pairs(), EDGES, LABELS), *LABELS)


@query(f"WITH {_PAIRS}, c AS (SELECT DISTINCT issue_time, y, x FROM pairs), s AS (SELECT *, row_number() OVER (PARTITION BY issue_time ORDER BY md5(concat_ws('|', '0', strftime(issue_time, '%Y-%m-%d %H:%M:%S'), y, x)), issue_time, y, x) AS rn FROM c) SELECT lead_min, count(*) AS n, round(avg(forecast), 6) AS mean_forecast FROM pairs JOIN s USING (issue_time, y, x) WHERE rn <= 5 GROUP BY 1")
def verify_sampled_cells(t: Tables) -> DataFrame:
    pairs = t.pairs()
    cells = V.sampled(pairs.select("issue_time", "y", "x").distinct(), 5, ["issue_time"], ["issue_time", "y", "x"])
    return pairs.join(cells, ["issue_time", "y", "x"]).groupBy("lead_min").agg(F.count("*").alias("n"), _round(F.avg("forecast")).alias("mean_forecast"))


@query("SELECT CASE WHEN value / 10 <= 0 THEN 'none' WHEN value / 10 < 2.5 THEN 'light' WHEN value / 10 < 7.5 THEN 'moderate' WHEN value / 10 < 50 THEN 'heavy' ELSE 'violent' END AS level, count(*) AS n FROM events GROUP BY 1")
def wmo_level_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(S.rain_level(F.col("value") / 10).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event_type) AS distinct_event_type, count(DISTINCT ts) AS distinct_ts FROM events")
def distinct_counts(t: Tables) -> DataFrame:
    return V.summary_counts(t.events, ["user_id", "event_type", "ts"])


@query("SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events")
def global_stats(t: Tables) -> DataFrame:
    return _rounded(V.value_range(t.events, "value"), "mean")


def _model(t: Tables) -> DataFrame:
    return t.fc().withColumn("rate", F.col("rate") * 0.95)


_MODEL = _PAIRS + ", mp AS (SELECT issue_time, lead_min, y, x, forecast * 0.95::DOUBLE AS forecast, observed FROM pairs)"
_SIDE = _MODEL + f""", a AS (SELECT lead_min, {_CONT}, {_TABLE.replace('tau', '50')} FROM pairs GROUP BY 1), b AS (SELECT lead_min, {_CONT}, {_TABLE.replace('tau', '50')} FROM mp GROUP BY 1),
 s AS (SELECT lead_min, a.rmse AS rmse_op, b.rmse AS rmse_model, round(CASE WHEN a.hits + a.misses + a.false_alarms <> 0 THEN a.hits / (a.hits + a.misses + a.false_alarms) END, 6) AS csi_op, round(CASE WHEN b.hits + b.misses + b.false_alarms <> 0 THEN b.hits / (b.hits + b.misses + b.false_alarms) END, 6) AS csi_model FROM a JOIN b USING (lead_min))"""


def _side(t: Tables) -> DataFrame:
    def measured(fc: DataFrame) -> DataFrame:
        pairs = V.pair(fc, t.obs())
        return V.continuous(pairs).join(V.categorical(pairs, 50.0), "lead_min").select("lead_min", _round("rmse").alias("rmse"), _round("csi").alias("csi"))

    return V.side_by_side(measured(t.fc()), measured(_model(t)))


@query(f"WITH {_SIDE} SELECT * FROM s")
def eval_side_by_side(t: Tables) -> DataFrame:
    return _side(t)


@query(f"WITH {_SIDE} SELECT round(avg(CASE WHEN rmse_model < rmse_op THEN 1.0 ELSE 0.0 END), 6) AS rmse_wins, round(avg(CASE WHEN csi_model > csi_op THEN 1.0 ELSE 0.0 END), 6) AS csi_wins, count(*) AS leads FROM s")
def win_rates(t: Tables) -> DataFrame:
    return _rounded(V.win_rates(_side(t)), "rmse_wins", "csi_wins")


@query(f"WITH {_PAIRS}, d AS (SELECT lead_min, abs(forecast - observed) / 100 AS d, least(abs(forecast - observed) / 100, 1.0) AS q, forecast / 100 AS f, observed / 100 AS o FROM pairs) SELECT lead_min, round(avg((0.5::DOUBLE * q * q + (d - q)) * (1 + o)), 6) AS huber, round(avg((0.5::DOUBLE * q * q + (d - q)) * (1 + o)) + 0.1::DOUBLE * (avg(f) - avg(o)) * (avg(f) - avg(o)), 6) AS total FROM d GROUP BY 1")
def weighted_huber(t: Tables) -> DataFrame:
    scaled = t.pairs().withColumns({"forecast": F.col("forecast") / 100, "observed": F.col("observed") / 100})
    return _rounded(V.weighted_huber(scaled, "lead_min", penalty=0.1), "huber", "total")


@query(f"WITH {_PAIRS}, b AS (SELECT sqrt(avg((forecast - observed) * (forecast - observed))) AS rmse FROM pairs GROUP BY hour(issue_time), lead_min) SELECT round(avg(rmse), 6) AS mean_rmse, count(*) AS batches FROM b")
def batch_rmse(t: Tables) -> DataFrame:
    return _rounded(V.batch_rmse(t.pairs(), F.struct(F.hour("issue_time"), "lead_min")), "mean_rmse")


# ---- as-of and nearest joins

_ASOF = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'), r0 AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'error'),
 r AS (SELECT user_id, ts, max(struct_pack(value := value)).value AS value FROM r0 GROUP BY 1, 2),
 m AS (SELECT l.*, r.ts AS rts, r.value AS rv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts)"""


@query(f"WITH {_ASOF} SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 21600000000 THEN rts END AS right_ts, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 21600000000 THEN rv END AS value FROM m")
def asof_backward_tol(t: Tables) -> DataFrame:
    return T.asof_backward(t.calm(), t.errors(), "ts", ["user_id"], ["value"], 21600)


@query(f"WITH {_ASOF} SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(rts) <= 21600000000 THEN rv ELSE 0.0 END AS value FROM m")
def asof_zero_fill(t: Tables) -> DataFrame:
    return T.asof_backward(t.calm(), t.errors(), "ts", ["user_id"], ["value"], 21600).select("event_id", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("""WITH l AS (SELECT event_id, date_trunc('hour', ts) AS ts FROM events WHERE event_type <> 'error'), r AS (SELECT date_trunc('hour', ts) AS ts, user_id, value FROM events WHERE event_type = 'error'),
 d AS (SELECT DISTINCT ts FROM r), m AS (SELECT l.*, d.ts AS rts FROM l ASOF JOIN d ON l.ts >= d.ts)
 SELECT m.event_id, m.ts, r.ts AS right_ts, count(*) AS stations, max(r.value) AS peak FROM m JOIN r ON r.ts = m.rts WHERE epoch(m.ts) - epoch(m.rts) <= 7200 GROUP BY 1, 2, 3""")
def asof_set_right(t: Tables) -> DataFrame:
    hour = S.floor_time("ts", 3600)
    left, right = t.calm().select("event_id", hour.alias("ts")), t.errors().select(hour.alias("ts"), "user_id", "value")
    times = T.asof_backward(left, right.select("ts").distinct(), "ts", [], [], 7200, bucket_seconds=7200).where("right_ts IS NOT NULL")
    # the set at each time is summed up first, so that it is joined once and not once for each row on the left
    sets = right.groupBy(F.col("ts").alias("right_ts")).agg(F.count("*").alias("stations"), F.max("value").alias("peak"))
    return times.join(sets, "right_ts").select("event_id", "ts", "right_ts", "stations", "peak")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS pos, user_id, ts AS rts FROM events WHERE event_type = 'error'),
 m AS (SELECT l.*, pos, rts, row_number() OVER (PARTITION BY event_id ORDER BY abs(date_diff('microsecond', rts, ts)), pos) AS rn FROM l JOIN r USING (user_id))
 SELECT event_id, user_id, ts, pos AS nearest_pos, rts AS nearest_ts FROM m WHERE rn = 1""")
def nearest_in_time(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return T.nearest_in_time(left, t.errors().select(F.col("event_id").alias("pos"), "user_id", "ts"), "ts", ["user_id"], "pos", bucket_seconds=86400)


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 997) / 100.0::DOUBLE AS lat, (o_custkey % 613) / 100.0::DOUBLE AS lon FROM orders), c AS (SELECT s_suppkey AS cell, (s_suppkey * 37 % 997) / 100.0::DOUBLE AS lat, (s_suppkey * 53 % 613) / 100.0::DOUBLE AS lon FROM supplier),
 m AS (SELECT o_orderkey, cell, (o.lat - c.lat) * (o.lat - c.lat) + (o.lon - c.lon) * (o.lon - c.lon) AS d2 FROM o LEFT JOIN c ON round_even(o.lat / 2, 0) = round_even(c.lat / 2, 0) AND round_even(o.lon / 2, 0) = round_even(c.lon / 2, 0)),
 k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d2, cell) AS rn FROM m) SELECT o_orderkey, cell, round(d2, 6) AS d2 FROM k WHERE rn = 1""")
def nearest_cell_point(t: Tables) -> DataFrame:
    b = lambda df: df.withColumns({"lat_bucket": S.spatial_bucket("lat", 2), "lon_bucket": S.spatial_bucket("lon", 2)})
    points = b(t.orders.select("o_orderkey", (F.col("o_orderkey") % 997 / 100.0).alias("lat"), (F.col("o_custkey") % 613 / 100.0).alias("lon")))
    cells = b(t.supplier.select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") * 37 % 997 / 100.0).alias("lat"), (F.col("s_suppkey") * 53 % 613 / 100.0).alias("lon")))
    return _rounded(G.nearest_cell(points, cells, ["lat_bucket", "lon_bucket"]), "d2").select("o_orderkey", "cell", "d2")


# ---- grids


@query("""WITH g AS (SELECT CAST(i // 12 AS INTEGER) AS y, CAST(i % 12 AS INTEGER) AS x, 52.5::DOUBLE + (i // 12) * (48.9::DOUBLE - 52.5::DOUBLE) / 9 AS lat, 1.5::DOUBLE + (i % 12) * (7.5::DOUBLE - 1.5::DOUBLE) / 11 AS lon FROM (SELECT unnest(range(0, 120)) AS i)),
 s AS (SELECT CAST(s_nationkey AS INTEGER) AS k, 49 + (s_suppkey * 37 % 350) / 100.0::DOUBLE AS lat, 1.6::DOUBLE + (s_suppkey * 53 % 580) / 100.0::DOUBLE AS lon, s_acctbal AS v FROM supplier),
 w AS (SELECT k, y, x, v, 1 / ((g.lat - s.lat) * (g.lat - s.lat) + (g.lon - s.lon) * (g.lon - s.lon) + 1e-9) AS w FROM s, g) SELECT k, y, x, round(sum(w * v) / sum(w), 4) AS value FROM w GROUP BY 1, 2, 3""")
def idw_grid(t: Tables) -> DataFrame:
    stations = t.supplier.select(F.col("s_nationkey").cast("int").alias("k"), (49 + F.col("s_suppkey") * 37 % 350 / 100.0).alias("lat"), (1.6 + F.col("s_suppkey") * 53 % 580 / 100.0).alias("lon"), F.col("s_acctbal").alias("value"))
    out = G.idw(stations, G.regular_grid(t.spark, 10, 12, 1.5, 7.5, 48.9, 52.5), ["k"])
    return out.withColumn("value", F.round("value", 4))


_POINTS = "p AS (SELECT vec_id, (vec_id * 7 % 75) / 10.0::DOUBLE AS fy, (vec_id * 13 % 69) / 10.0::DOUBLE AS fx FROM embeddings)"


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", (F.col("vec_id") * 7 % 75 / 10.0).alias("fy"), (F.col("vec_id") * 13 % 69 / 10.0).alias("fx"))


@query(f"""WITH {_RASTER}, {_POINTS}, q AS (SELECT *, CAST(least(floor(fy), 6) AS INTEGER) AS y0, CAST(least(floor(fx), 6) AS INTEGER) AS x0 FROM p WHERE fy <= 7 AND fx <= 7),
 c AS (SELECT vec_id, sum(value * (CASE WHEN y = y0 THEN 1 - (fy - y0) ELSE fy - y0 END) * (CASE WHEN x = x0 THEN 1 - (fx - x0) ELSE fx - x0 END)) AS value FROM q JOIN r USING (vec_id) WHERE y IN (y0, y0 + 1) AND x IN (x0, x0 + 1) GROUP BY 1)
 SELECT p.vec_id, p.fy, p.fx, coalesce(round(c.value, 6), 'nan'::DOUBLE) AS value FROM p LEFT JOIN c USING (vec_id)""")
def bilinear_sample(t: Tables) -> DataFrame:
    return _rounded(G.bilinear(t.rasters(), _points(t), ["vec_id"], 8, 8), "value")


@query(f"WITH {_RASTER}, {_POINTS} SELECT p.vec_id, fy, fx, r.y, r.x, value FROM p JOIN r ON p.vec_id = r.vec_id AND r.y = least(round_even(fy, 0), 7) AND r.x = least(round_even(fx, 0), 7)")
def nearest_pixel(t: Tables) -> DataFrame:
    return G.nearest_pixel(t.rasters(), _points(t), ["vec_id"], 8, 8).select("vec_id", "fy", "fx", "y", "x", "value")


@query(f"WITH {_RASTER} SELECT vec_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(value), 6) AS value FROM r WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3")
def block_mean(t: Tables) -> DataFrame:
    return _rounded(G.block_mean(t.rasters(), ["vec_id"], 8, 8, 3, 3), "value")


@query(f"WITH {_RASTER}, o AS (SELECT unnest(range(-1, 2)) AS d) SELECT vec_id, CAST((y + a.d + 8) % 8 AS INTEGER) AS y, CAST((x + b.d + 8) % 8 AS INTEGER) AS x, max(value) AS value FROM r, o a, o b GROUP BY 1, 2, 3")
def max_pool(t: Tables) -> DataFrame:
    return G.max_pool(t.rasters(), ["vec_id"], 8, 8, 1)


@query(f"WITH {_RASTER}, m AS (SELECT vec_id, y, x, CASE WHEN value < -0.1 THEN 0 ELSE 1 END AS value FROM r), z AS (SELECT * FROM m WHERE value = 0) SELECT m.vec_id, m.y, m.x, round(min(sqrt((m.y - z.y) * (m.y - z.y) * 2.5::DOUBLE * 2.5 + (m.x - z.x) * (m.x - z.x) * 1.5::DOUBLE * 1.5)), 6) AS distance FROM m LEFT JOIN z USING (vec_id) GROUP BY 1, 2, 3")
def edt_distance(t: Tables) -> DataFrame:
    mask = t.rasters().withColumn("value", F.when(F.col("value") < -0.1, 0).otherwise(1))
    return _rounded(G.distance_to_zero(mask, ["vec_id"], 2.5, 1.5), "distance")


@query(f"WITH {_RASTER}, g AS (SELECT vec_id, abs(value - lag(value) OVER (PARTITION BY vec_id, y ORDER BY x)) AS gx, abs(value - lag(value) OVER (PARTITION BY vec_id, x ORDER BY y)) AS gy FROM r) SELECT vec_id, round(avg(gx), 6) AS pitch_x, round(avg(gy), 6) AS pitch_y FROM g GROUP BY 1")
def grid_pitch(t: Tables) -> DataFrame:
    return _rounded(G.grid_pitch(t.rasters(), ["vec_id"]), "pitch_x", "pitch_y")


@query(f"WITH {_RASTER} SELECT vec_id, y, x, value FROM r")
def tensor_melt(t: Tables) -> DataFrame:
    return t.rasters()


@query("SELECT vec_id, list_aggregate(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 'string_agg', ',') IS NOT NULL AS filled, len(embedding) AS cells, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def tensor_stack(t: Tables) -> DataFrame:
    e = F.col("values")
    return G.stack(t.rasters(), ["vec_id"], 8).select("vec_id", e.isNotNull().alias("filled"), F.size(e).cast("long").alias("cells"), e[0].alias("first"), e[63].alias("last"))


@query(f"WITH {_OBS} SELECT valid_time, round(avg(CASE WHEN rate >= 50 THEN 1.0 ELSE 0.0 END), 6) AS wet_fraction FROM obs GROUP BY 1 HAVING avg(CASE WHEN rate >= 50 THEN 1.0 ELSE 0.0 END) >= 0.5")
def wet_fraction_filter(t: Tables) -> DataFrame:
    return _rounded(G.wet_fraction(t.obs(), ["valid_time"], wet=50.0).where("wet_fraction >= 0.5"), "wet_fraction")


def _ramp_sql(k: int) -> str:
    stops = [(0.0, (220, 220, 220)), (0.001, (158, 202, 225)), (2.5, (49, 130, 189)), (7.5, (253, 141, 60)), (50.0, (227, 26, 28))]
    cases = " ".join(f"WHEN v < {b} THEN {lo[k]} + ({hi[k]} - {lo[k]}) * ((v - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE))" for (a, lo), (b, hi) in zip(stops, stops[1:], strict=False))
    return f"CAST(CASE WHEN v > 0 THEN floor(CASE {cases} ELSE {stops[-1][1][k]} END) ELSE 0 END AS INTEGER)"


@query(f"WITH e AS (SELECT event_id, value / 8 AS v FROM events) SELECT event_id, {_ramp_sql(0)} AS r, {_ramp_sql(1)} AS g, {_ramp_sql(2)} AS b, CAST(CASE WHEN v > 0 THEN floor(least(1.0, v / 0.3::DOUBLE) * 220) ELSE 0 END AS INTEGER) AS a FROM e")
def colour_ramp(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.ramp_colour(F.col("value") / 8).alias("c")).select("event_id", "c.*")


@query("SELECT p_partkey, CASE WHEN p_size IN (7, 9) THEN 'nan'::DOUBLE ELSE (p_size * 0.01::DOUBLE + -0.5) * 12 END AS rate FROM part")
def calibrate_decode(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.calibrated("p_size", F.lit("GEO = 0.01 * PV + -0.5".replace("+ -", "-")), (7, 9)).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 6 AS per_10_min, l_quantity * 12 AS per_5_min, (l_extendedprice - 30000) / 15000 AS z, least(greatest(l_quantity, 10.0), 40.0) AS clipped FROM lineitem")
def unit_convert(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", S.per_hour("l_quantity", 10).alias("per_10_min"), S.per_hour("l_quantity", 5).alias("per_5_min"), S.z_score("l_extendedprice", 30000, 15000).alias("z"), S.clipped("l_quantity", 10.0, 40.0).alias("clipped"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(trunc((c_custkey % 37) / 37.0::DOUBLE * 99) AS INTEGER) AS x, CAST(trunc((37 - c_custkey % 37) / 37.0::DOUBLE * 99) AS INTEGER) AS y, CAST(round_even((c_custkey % 37) / 0.5::DOUBLE, 0) AS BIGINT) AS bucket FROM customer")
def cell_bucket(t: Tables) -> DataFrame:
    v = F.col("c_custkey") % 37
    return t.customer.select("c_custkey", S.cell_index(v, 0, 37, 100).alias("x"), S.cell_index(v, 0, 37, 100, descending=True).alias("y"), S.spatial_bucket(v, 0.5).alias("bucket"))


# ---- payloads, stamps, hashes


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) * 6 AS value, coalesce(json_extract_string(props, '$.missing'), '') AS image_url FROM events WHERE props IS NOT NULL")
def json_flatten(t: Tables) -> DataFrame:
    p = F.from_json("props", "k STRING, missing STRING")
    return t.events.where("props IS NOT NULL").select("event_id", S.per_hour(S.lenient_double(p["k"]), 10).alias("value"), F.coalesce(p["missing"], F.lit("")).alias("image_url"))


@query("""SELECT event_id, 'city' AS location, CAST(k AS INTEGER) AS lead_min, CAST(CASE WHEN k = 20 THEN 0.0 ELSE value END * 6 AS FLOAT) AS value_mm_per_h, '/f' || (k // 10) AS image_url FROM events, (SELECT unnest([-10, 0, 10, 20]) AS k)""")
def animation_flatten(t: Tables) -> DataFrame:
    """Payloads made from events: four frames, one with no value, one with a bad time, and one that is null."""
    e = t.events
    at = lambda m: F.concat(F.date_format(F.col("ts") + F.expr(f"INTERVAL '{m}' MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    frame = lambda m, v: F.struct(at(m).alias("time"), F.lit(f"/f{m // 10}").alias("uri"), v.cast("string").alias("value"))
    frames = F.array(*[frame(m, F.col("value") if m < 20 else F.lit(None)) for m in (-10, 0, 10, 20)], F.struct(F.lit("soon").alias("time"), F.lit("/x").alias("uri"), F.lit("1").alias("value")), F.lit(None))
    body = F.to_json(F.struct(F.struct(F.lit("10min").alias("type"), frames.alias("sequence")).alias("animation")))
    landed = e.select("event_id", F.lit("city").alias("location"), F.lit(50.8).alias("lat"), F.lit(4.3).alias("lon"), F.col("ts").cast("timestamp").alias("poll_ts"), body.alias("body"))
    rows = I.animation_rows(landed.withColumn("location", F.concat_ws("|", "location", "event_id")))
    return rows.select(F.split_part("location", F.lit("|"), F.lit(2)).cast("long").alias("event_id"), F.split_part("location", F.lit("|"), F.lit(1)).alias("location"), "lead_min", "value_mm_per_h", "image_url")


@query("SELECT o_orderkey, date_trunc('minute', o_orderdate + to_minutes(o_orderkey % 1440)) AS stamp, strftime(o_orderdate + to_minutes(o_orderkey % 1440), '%Y-%m-%dT%H-%M-%SZ') AS snapshot, o_orderdate + to_minutes(o_orderkey % 1440) AS back FROM orders")
def stamp_parse(t: Tables) -> DataFrame:
    at = S.plus_minutes("o_orderdate", F.col("o_orderkey") % 1440)
    name = F.concat(F.lit("RAD_"), F.date_format(at, "yyyyMMddHHmm"), F.lit(".h5"))
    return t.orders.select("o_orderkey", S.stamp_time(name).alias("stamp"), S.snapshot_name(at).alias("snapshot"), S.snapshot_time(S.snapshot_name(at)).alias("back"))


@query("SELECT o_orderkey, unnest(range(0, CAST(o_orderkey % 4 AS BIGINT) + 1)) * INTERVAL 15 MINUTE + o_orderdate AS at FROM orders")
def time_dim_expand(t: Tables) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.concat(F.lit("bad, "), iso(F.col("o_orderdate")), F.lit("/"), iso(S.plus_minutes("o_orderdate", F.col("o_orderkey") % 4 * 15)), F.lit("/PT15M,"), iso(F.col("o_orderdate")))
    return t.orders.select("o_orderkey", F.explode(I.expand_times(raw)).alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE (o_orderkey % 3) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 7) END AS seconds FROM orders")
def duration_parse(t: Tables) -> DataFrame:
    k = lambda n: (F.col("o_orderkey") % n).cast("string")
    text = F.when(F.col("o_orderkey") % 5 == 4, F.concat(F.lit("every "), k(9))).otherwise(F.concat(F.lit("P"), k(3), F.lit("DT"), k(24), F.lit("H"), k(60), F.lit("M"), k(7), F.lit("S")))
    return t.orders.select("o_orderkey", S.duration_seconds(text).alias("seconds"))


@query("SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 60000000.0) AS BIGINT) AS lead_min, CAST(round_even((epoch(ts)::BIGINT - epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT) / 60.0, 0) AS BIGINT) AS rounded FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def lead_minutes(t: Tables) -> DataFrame:
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    ts = S.floor_time("ts", 1)
    return t.events.select("event_id", S.lead_minutes(ts, at).alias("lead_min"), S.rounded_lead_minutes(ts, at).alias("rounded"))


@query("SELECT c_custkey, md5('salt;' || c_name || ';05/03/2024') AS key FROM customer")
def md5_key(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.signed_key("salt", F.col("c_name"), F.lit("2024-03-05").cast("date")).alias("key"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def sha256_digest(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.digest("c_name").alias("digest"))


@query("SELECT c_custkey, list_aggregate(list_filter(list_transform(string_split(' a, ,' || c_name || ' ,', ','), lambda s: trim(s)), lambda s: s <> ''), 'string_agg', '|') AS parts, CASE WHEN c_custkey % 2 = 0 THEN 'https://x/' || c_name ELSE 'http://b/' || c_name END AS url FROM customer")
def text_lists(t: Tables) -> DataFrame:
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://x/"), "c_name")).otherwise(F.concat(F.lit("/"), "c_name"))
    return t.customer.select("c_custkey", F.array_join(S.csv_list(F.concat(F.lit(" a, ,"), "c_name", F.lit(" ,"))), "|").alias("parts"), S.absolute_url(F.lit("http://b//"), url).alias("url"))


# ---- tables and sets


@query("WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM b WHERE rn = 1")
def upsert_keep_last(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id", "value")
    return I.upsert_keep_last(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def skip_existing_anti(t: Tables) -> DataFrame:
    have = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.not_yet_present(t.orders.select("o_orderkey", "o_custkey"), have, ["o_orderkey"])


@query("SELECT event_type, count(*) AS n FROM (SELECT * FROM events WHERE value < 20 UNION ALL SELECT * FROM events WHERE value < 40) GROUP BY 1")
def union_all(t: Tables) -> DataFrame:
    return t.events.where("value < 20").unionByName(t.events.where("value < 40")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS at FROM events WHERE value < 20 UNION SELECT date_trunc('hour', ts) FROM events WHERE value > 90")
def union_distinct(t: Tables) -> DataFrame:
    at = t.events.select(S.floor_time("ts", 3600).alias("at"), "value")
    return at.where("value < 20").select("at").unionByName(at.where("value > 90").select("at")).distinct()


@query("SELECT event_id, ts FROM events WHERE minute(ts) % 15 = 0")
def cadence_filter(t: Tables) -> DataFrame:
    return t.events.where(F.minute("ts") % 15 == 0).select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def window_filter(t: Tables) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.events.where(F.col("ts").between(at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"))).select("event_id", "ts")


# ---- serving


@query(f"WITH {_SHARDS} SELECT band, CAST(l.lead_min AS INTEGER) AS lead_min, max_age, count(s.rate) AS cells FROM leads l LEFT JOIN shards s USING (band, lead_min) GROUP BY 1, 2, 3")
def bands_leads(t: Tables) -> DataFrame:
    """Every lead of the bands, with how many cells the shards hold for it."""
    held = t.shards().groupBy("band", "lead_min").agg(F.count("*").alias("cells"))
    return serving.band_leads(serving.bands(t.spark)).join(held, ["band", "lead_min"], "left").select("band", "lead_min", "max_age", F.coalesce("cells", F.lit(0).cast("long")).alias("cells"))


@query(f"WITH {_SHARDS} SELECT CAST(round_even(lat / 0.1::DOUBLE, 0) AS BIGINT) AS lat_bucket, CAST(round_even(lon / 0.1::DOUBLE, 0) AS BIGINT) AS lon_bucket, count(*) AS n, round(sum(rate), 6) AS total FROM shards GROUP BY 1, 2")
def point_shards(t: Tables) -> DataFrame:
    return t.shards().groupBy("lat_bucket", "lon_bucket").agg(F.count("*").alias("n"), _round(F.sum("rate")).alias("total"))


@query(f"""WITH {_SHARDS}, near AS (SELECT * FROM shards WHERE round_even(lat / 0.1::DOUBLE, 0) BETWEEN round_even(52.49 / 0.1::DOUBLE, 0) - 2 AND round_even(52.49 / 0.1::DOUBLE, 0) + 2 AND round_even(lon / 0.1::DOUBLE, 0) BETWEEN round_even(3.08 / 0.1::DOUBLE, 0) - 2 AND round_even(3.08 / 0.1::DOUBLE, 0) + 2),
 c AS (SELECT cell FROM near ORDER BY (lat - 52.49::DOUBLE) * (lat - 52.49::DOUBLE) + (lon - 3.08::DOUBLE) * (lon - 3.08::DOUBLE), cell LIMIT 1)
 SELECT band, lead_min, TIMESTAMP '{NOW}' + to_minutes(lead_min) AS valid_time, rate, '/v1/overlay/' || band || '/' || lead_min || '.png?t=snap' AS overlay_url FROM near JOIN c USING (cell) WHERE lead_min <= 1440""")
def forecast_point(t: Tables) -> DataFrame:
    rows = serving.point_forecast(t.shards(), 52.49, 3.08, 1440, ring=2)
    return serving.forecast_frames(rows, F.lit("snap"), F.lit(NOW).cast("timestamp_ntz"))


@query(f"WITH {_SHARDS}, o AS (SELECT DISTINCT band, lead_min FROM shards WHERE rate > 100) SELECT lead_min, TIMESTAMP '{NOW}' + to_minutes(lead_min) AS valid_time, '/v1/overlay/medium/' || lead_min || '.png?t=snap' AS url FROM o WHERE band = 'medium'")
def animation_manifest(t: Tables) -> DataFrame:
    """The leads of a band for which the shards give an overlay, those where it rains hard somewhere."""
    drawn = t.shards().where("rate > 100").select("band", "lead_min").distinct()
    return serving.manifest(serving.band_leads(serving.bands(t.spark)), drawn, "medium", F.lit("snap"), F.lit(NOW).cast("timestamp_ntz"))


@query(f"WITH s AS (SELECT max(date_trunc('second', ts)) AS issued_at FROM events) SELECT CASE WHEN issued_at IS NULL THEN 'empty' WHEN epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(issued_at)::BIGINT > 900 THEN 'degraded' ELSE 'ok' END AS status, issued_at, epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(issued_at)::BIGINT AS age_seconds FROM s")
def health_status(t: Tables) -> DataFrame:
    return serving.health(t.events.select(S.floor_time("ts", 1).alias("issued_at")), F.lit(NOW).cast("timestamp_ntz"))


@query("WITH s AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') AS snapshot, o_orderdate AS d FROM orders), c AS (SELECT snapshot, day(d) % 2 = 0 AS complete FROM s) SELECT snapshot, complete, NOT complete OR row_number() OVER (PARTITION BY complete ORDER BY snapshot DESC) <= 24 AS stays FROM c")
def retention_topk(t: Tables) -> DataFrame:
    s = t.orders.select(S.snapshot_name("o_orderdate").alias("snapshot"), (F.dayofmonth("o_orderdate") % 2 == 0).alias("complete")).distinct()
    return serving.retained(s, 24)


@query("WITH n AS (SELECT DISTINCT 'RAD_' || strftime(o_orderdate, '%Y%m%d') || '0000.h5' AS name FROM orders) SELECT substr(name, 5, 6) AS month, count(*) AS files, min(name) AS first_name, max(name) AS last_name FROM n WHERE substr(name, 5, 6) < '199706' GROUP BY 1")
def month_archive_plan(t: Tables) -> DataFrame:
    names = t.orders.select(F.concat(F.lit("RAD_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("0000.h5")).alias("name")).distinct()
    plan = archive.month_plan(names, F.regexp_extract("name", r"_(\d{6})", 1), "199706")
    return plan.select("month", "files", F.get("names", 0).alias("first_name"), F.element_at("names", -1).alias("last_name"))


# ---- samples and features

_HIST = _OBS + """, c AS (SELECT DISTINCT valid_time AS t, y, x FROM obs), h AS (SELECT a.t, a.y, a.x FROM c a JOIN c b ON a.y = b.y AND a.x = b.x AND b.t BETWEEN a.t - INTERVAL 3 HOUR AND a.t GROUP BY 1, 2, 3 HAVING count(*) = 4)"""


@query(f"WITH {_HIST} SELECT y, x, t AS valid_time, t - INTERVAL 3 HOUR AS oldest, CAST(4 AS BIGINT) AS frames FROM h")
def lag_history(t: Tables) -> DataFrame:
    h = T.lagged_history(t.obs(), ["y", "x"], "valid_time", 3600, 4)
    return h.select("y", "x", "valid_time", F.array_min("history").alias("oldest"), F.size("history").cast("long").alias("frames"))


@query(f"WITH {_HIST} SELECT h.y, h.x, h.t AS valid_time, CAST(l AS INTEGER) AS lead_s, c.t AS target_time FROM h, (SELECT unnest([3600, 7200, 10800]) AS l) JOIN c ON c.y = h.y AND c.x = h.x AND c.t = h.t + to_seconds(l)")
def sample_index(t: Tables) -> DataFrame:
    return T.samples(t.obs(), ["y", "x"], "valid_time", 3600, 4, [3600, 7200, 10800]).select("y", "x", "valid_time", "lead_s", "target_time")


@query(f"WITH {_OBS}, d AS (SELECT valid_time, row_number() OVER (ORDER BY valid_time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT valid_time FROM obs)) SELECT obs.valid_time, y, x, CASE WHEN i < least(greatest(floor(n * (1 - 0.25::DOUBLE)), 1), n - 1) THEN 'train' ELSE 'val' END AS part FROM obs JOIN d USING (valid_time)")
def time_split(t: Tables) -> DataFrame:
    return T.time_split(t.obs().select("valid_time", "y", "x"), "valid_time", 0.25)


@query("SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS day_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS day_cos FROM events")
def cyclic_time_features(t: Tables) -> DataFrame:
    s, c = S.day_cycle("ts")
    return t.events.select("event_id", _round(s).alias("day_sin"), _round(c).alias("day_cos"))


@query(f"""WITH {_HIST}, s AS (SELECT h.y, h.x, h.t, CAST(3600 AS INTEGER) AS lead_s FROM h JOIN c ON c.y = h.y AND c.x = h.x AND c.t = h.t + INTERVAL 1 HOUR),
 f AS (SELECT s.*, 'frame_' || (3 - date_diff('hour', obs.valid_time, s.t)) AS channel, obs.rate AS value FROM s JOIN obs ON obs.y = s.y AND obs.x = s.x AND obs.valid_time BETWEEN s.t - INTERVAL 3 HOUR AND s.t
 UNION ALL SELECT *, 'lead', lead_s / 7200.0::DOUBLE FROM s UNION ALL SELECT *, 'day_sin', sin(2 * pi() * hour(t) / 24) FROM s UNION ALL SELECT *, 'day_cos', cos(2 * pi() * hour(t) / 24) FROM s)
 SELECT y, x, t AS valid_time, lead_s, channel, round(value, 6) AS value FROM f""")
def feature_long(t: Tables) -> DataFrame:
    obs = t.obs()
    return _rounded(X.channels(T.samples(obs, ["y", "x"], "valid_time", 3600, 4, [3600]), obs, ["y", "x"], "valid_time", "rate"), "value")


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2), b AS (SELECT *, min(loss) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
 m AS (SELECT *, best IS NULL OR loss < best AS improved FROM b), s AS (SELECT *, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY event_type ORDER BY day) AS stale FROM m)
 SELECT event_type, day, loss, best, improved, stale, max(CASE WHEN stale >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY day) = 1 AS stopped FROM s""")
def early_stop_running_best(t: Tables) -> DataFrame:
    daily = t.events.groupBy("event_type", S.floor_time("ts", 86400).alias("day")).agg(_round(F.avg("value")).alias("loss"))
    return T.early_stopping(daily, ["event_type"], "day", "loss", 5)


_REF = "TIMESTAMP '2024-01-15 00:00:00'"


def _ref():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


@query(f"WITH e AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN value ELSE 0 END AS v FROM events), f AS (SELECT user_id, {_REF} AS reference, coalesce(bool_or(ts >= {_REF} AND v > 0), false) AS rain_ahead, min(CASE WHEN ts >= {_REF} AND v > 0 THEN ts END) AS first_time FROM e GROUP BY 1) SELECT *, CAST(floor((epoch_us(first_time) // 1000000 - epoch({_REF})::BIGINT) / 60.0) AS BIGINT) AS minutes FROM f")
def first_future_rain(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", _ref().alias("reference"), F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0).alias("v"))
    return T.first_future(e, ["user_id"], "ts", "reference", "v")


@query(f"WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us({_REF})), event_id) AS rn FROM events) SELECT user_id, event_id AS nearest_event_id, ts AS nearest_ts FROM e WHERE rn = 1")
def current_index(t: Tables) -> DataFrame:
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(_ref().cast("timestamp")))
    return t.events.groupBy("user_id").agg(F.min(F.struct(gap, "event_id", "ts")).alias("b")).select("user_id", F.col("b.event_id").alias("nearest_event_id"), F.col("b.ts").alias("nearest_ts"))


@query(f"SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, CASE WHEN ts > {_REF} THEN 'forecast' ELSE 'observation' END AS kind FROM events WHERE ts >= {_REF}")
def obs_forecast_flag(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts").withColumn("_o", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("_o")
    out = T.future_index(e, ["user_id"], "ts", _ref())
    return out.withColumn("place", (F.row_number().over(w) - 1).cast("long")).drop("_o")


@query("WITH d AS (SELECT DISTINCT user_id, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, greatest(ceil(count(*) OVER (PARTITION BY user_id) / 5.0), 1) AS step FROM d) SELECT user_id, ts FROM r WHERE i % step = 0")
def tick_thinning(t: Tables) -> DataFrame:
    return T.thinned(t.events.select("user_id", "ts").distinct(), ["user_id"], "ts")


@query("WITH e AS (SELECT event_id, user_id % 25 AS k FROM events) SELECT event_id, CASE WHEN k % 3 = 0 THEN 'dry' WHEN k % 3 = 1 THEN 'raining' ELSE 'in ' || k || ' min' END AS headline, CASE WHEN k < 5 THEN 'timeout' WHEN k < 10 THEN 'client' WHEN k < 15 THEN 'server' ELSE 'unknown' END AS failure, CASE WHEN k % 2 = 0 THEN 5 ELSE 10 END AS minutes FROM e")
def client_labels(t: Tables) -> DataFrame:
    k = F.col("user_id") % 25
    minutes = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, 0).otherwise(k)
    status = F.when(k < 5, "timeout").when(k < 10, "404").when(k < 15, "503").otherwise("odd")
    return t.events.select("event_id", S.headline(minutes).alias("headline"), S.failure_kind(status).alias("failure"), S.interval_label_minutes(F.when(k % 2 == 0, "5min").otherwise("?")).alias("minutes"))


# ---- streams (run to the end of what is there, into a table)


def _drained(t: Tables, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """A streaming query over events until all files are read; its table is written to the shared folder."""
    spark = t.spark
    place = fresh_path(spark, "stream")
    events = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*" if not _is_folder(spark, f"{t.folder}/events.parquet") else f"{t.folder}/events.parquet")
    out = build(events)
    writer = out.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        run = writer.outputMode("append").format("parquet").option("path", f"{place}/rows").start()
    else:  # the last complete result replaces the one before
        run = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/rows")).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT to_timestamp(epoch(ts)::BIGINT // 300 * 300)::TIMESTAMP AS start, event_type, count(*) AS n, max(value) AS peak FROM (SELECT event_type, value, date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    return _drained(t, lambda e: ticks.tumbling(e, "ts", "value", ["event_type"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    return _drained(t, lambda e: ticks.deduplicated(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", late="60 days").select("user_id", "event_type"), "append")


from . import catalog_clients, catalog_feeds  # noqa: E402, F401 - add their queries
