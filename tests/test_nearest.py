"""Searches for the nearest cell where cells are crowded or far away."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import grids as G


def brute(places, cells):
    """Smallest (d2, cell) of each place, in double precision as SQL has it."""
    names, cy, cx = zip(*cells, strict=True)
    cy, cx, order = np.array(cy), np.array(cx), np.argsort(np.array(names), kind="stable")
    dy, dx = np.array([p[0] for p in places])[:, None] - cy[order], np.array([p[1] for p in places])[:, None] - cx[order]
    d2 = dy * dy + dx * dx
    at = d2.argmin(1)
    return [(float(d2[i, a]), names[order[a]]) for i, a in enumerate(at)]


@pytest.mark.parametrize("ring", [0, 1])
def test_crowded_buckets_meet_in_runs(spark, ring):
    rng = np.random.default_rng(4)
    cells = [(int(b), f"c{i:04d}", float(y), float(x)) for i, (b, y, x) in enumerate(np.c_[rng.integers(0, 3, 3000), rng.integers(0, 40, (3000, 2)) / 8])]
    places = [(int(b), float(y), float(x)) for b, y, x in np.c_[rng.integers(-1, 4, 900), rng.integers(-20, 80, (900, 2)) / 8]]
    odd = [(0, "a", None, 1.0), (0, "b", float("nan"), 1.0), (None, "d", 1.0, 1.0)]  # no coordinates, no bucket: they are near nothing
    df = G.nearest_cell(spark.createDataFrame(places + [(0, None, 1.0)], "b int, lat double, lon double"), spark.createDataFrame(cells + odd, "b int, cell string, lat double, lon double"), ["b"], ring=ring)
    assert "array_min(transform(_cells" not in df._jdf.queryExecution().toString()  # a place does not look through its bucket, nor does a sort carry the bucket's cells
    got = sorted(((r.b, r.lat, r.lon), (r.d2, r.cell)) for r in df.where("lat IS NOT NULL").collect() if r.cell)
    reach = {b: [c[1:] for c in cells if abs(c[0] - b) <= ring] for b in range(-1, 5)}
    want = sorted((p, brute([p[1:]], reach[p[0]])[0]) for p in places if reach[p[0]])
    assert got == want
    assert [(r.cell, r.d2) for r in df.where("lat IS NULL").collect()] == [(None, None)] and df.count() == len(places) + 1


def test_far_places_meet_few_cells(spark):
    """Cells fill a corner and two places elsewhere; most places are far off, where wider and wider buckets held nearly all cells."""
    from skylattice.operators import nearest as N

    rng = np.random.default_rng(5)
    cells = [(int(i), float(y), float(x)) for i, (y, x) in enumerate(np.r_[rng.integers(0, 500, (8000, 2)) / 100, [[40.0, 40.0], [40.0, 40.0], [-1e6, 3.0]]])]
    places = [(float(y), float(x)) for y, x in np.r_[rng.integers(0, 2000, (4000, 2)) / 100, [[1e9, -1e9]]]]
    got = G.nearest_anywhere(spark.createDataFrame(places, "lat double, lon double"), spark.createDataFrame(cells, "cell long, lat double, lon double")).collect()
    assert sorted(((r.lat, r.lon), (r.d2, r.cell)) for r in got) == sorted(zip(places, brute(places, cells), strict=True))
    met = []
    for n in (1, 4):  # with four times the rows in the same area a run meets fewer than four times the runs
        places, cells = rng.uniform(0, 20, (3000 * n, 2)).tolist(), [[i, *c] for i, c in enumerate(rng.uniform(0, 5, (1500 * n, 2)).tolist())]
        mine, others = (N._runs(spark.createDataFrame(rows, schema), [], 32) for rows, schema in ((places, "lat double, lon double"), (cells, "cell long, lat double, lon double")))
        met.append(N._candidates(mine, others, [], [], 0).agg(F.avg(F.size("met"))).first()[0])
    assert met[1] < 3 * met[0]


def test_distance_over_blocks_of_rows_grows_no_frame_to_the_end(spark, monkeypatch):
    """Tall fields with zeros in few blocks, a key that is NULL and one without zeros; every frame of the plan starts at the first row and ends before the last."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(G, "_ROWS", 5)
    cells = [(k, int(y), x, 0.0 if k != 2 and rng.random() < (0.2 if 20 <= y < 26 or y == 47 else 0) else 1.0) for k in (1, 2, None) for y in range(-8, 60) for x in range(4)]
    df = G.distance_to_zero(spark.createDataFrame(cells, "k int, y int, x int, value double"), ["k"], 2.0, 3.0)
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    got = {(r.k, r.y, r.x): r.distance for r in df.collect()}
    assert len(got) == len(cells)
    for k, y, x, _ in cells:
        ways = [(y - b) ** 2 * 4.0 + (x - c) ** 2 * 9.0 for a, b, c, v in cells if a == k and v == 0]
        assert got[k, y, x] == (pytest.approx(min(ways) ** 0.5) if ways else None)
