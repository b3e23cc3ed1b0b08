"""The as-of join of streams holds many keys in few groups of state."""

from datetime import datetime, timedelta

import numpy as np

from skylattice.operators import temporal as T
from skylattice.plans.catalog_feeds import _ROCKS, _STORE
from skylattice.streaming import ticks
from skylattice.streaming.asof import asof_stream

EVENTS = "id int, k string, n int, t timestamp_ntz, side string, v double"


def test_many_keys_share_few_groups(spark, tmp_path):
    spark.conf.set(_STORE, _ROCKS)
    at = lambda m: datetime(2024, 5, 1) + timedelta(minutes=m)
    rng, place = np.random.default_rng(8), str(tmp_path)
    some = lambda a: a[int(rng.integers(0, len(a)))]
    rows = [(i, some(["a", "b", 'c"', None]), some([*range(20), None]), at(int(rng.integers(0, 240)) / 2), some("lr"), float(rng.integers(0, 5))) for i in range(1200)]
    rows.sort(key=lambda r: r[3] + timedelta(minutes=float(rng.integers(0, 9))))
    schema = spark.createDataFrame([], EVENTS).schema
    for batch in (rows[:600], rows[600:], [(-1, "clock", 0, at(400), "l", None)]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{place}/in")
        feed = ticks.landed(spark, f"{place}/in", schema)
        out = asof_stream(feed.where("side = 'l'").select("id", "k", "n", "t"), feed.where("side = 'r'").select("k", "n", "t", "v"), "t", ["k", "n"], ["v"], 900, "20 minutes", groups=3)
        run = out.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 30  # of 64 keys and more, each of which had lists and a timer
    df = spark.createDataFrame(rows, EVENTS)
    want = T.asof_backward(df.where("side = 'l'").select("id", "k", "n", "t"), df.where("side = 'r'").select("k", "n", "t", "v"), "t", ["k", "n"], ["v"], 900)
    got = {r.id: (r.right_t, r.v) for r in spark.read.schema(out.schema).parquet(f"{place}/out").where("id >= 0").collect()}
    assert got == {r.id: (r.right_t, r.v) for r in want.collect()} and len(got) == sum(r[4] == "l" for r in rows)
