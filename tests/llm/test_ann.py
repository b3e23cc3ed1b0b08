"""The multi-index against brute force; copies, ties and unusable vectors."""

import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import ann


def brute(rows, asked, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, u in ok:
        if asked(q):
            near = [(-round(float(u @ v / math.sqrt((u @ u) * (v @ v))), 12), i) for i, v in ok if i != q and len(v) == len(u)]
            out[q] = heapq.nsmallest(k, near)
    return out


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    index = ann.MultiIndex(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)), rng.integers(0, 3, 35))
    u = rng.normal(size=8)
    met = index.walk(u, 10**9)
    a, b = ((index.first - u[:4]) ** 2).sum(1), ((index.second - u[4:]) ** 2).sum(1)
    cost = (a[:, None] + b[None]).ravel()
    assert sorted(met) == np.flatnonzero(index.held).tolist()
    assert (np.diff(cost[met]) >= -1e-12).all()


def test_whole_walk_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # one vector many times
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0, None] * 4), (None, rows[0][1]), (1050, [1.0, 2.0]), (1051, [2.0, 1.0]), (1100, [3.0, 1.0])]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, ids int")
    got = {}
    for r in ann.nearest_neighbours(d, F.col("vec_id") % 50 == 0, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(want[q]) + 1))
        assert np.allclose([n[2] for n in near], [-w[0] for w in want[q]])
        assert [n[1] for n in near] == [w[1] for w in want[q]]


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(9)
    d = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    run = lambda: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.nearest_neighbours(d, F.col("vec_id") % 10 == 0, share=1.0).collect())
    whole = run()
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert run() == whole and len(whole) == 100
    assert ann.nearest_neighbours(d.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def recall(spark, rows, every):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda i: i % every == 0)
    got = {}
    for r in ann.nearest_neighbours(d, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(got.get(q, set()) & {i for _, i in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(spark, [(r.vec_id, list(r.embedding) if r.embedding else None) for r in d.select("vec_id", "embedding").collect()], 50) >= 0.9


def test_recall_of_walks_that_meet_a_part(spark, monkeypatch):
    """The share is fitted: small for clustered vectors, larger for vectors without clusters, and 0.9 is found either way."""
    shares = []
    fit = ann._share
    monkeypatch.setattr(ann, "_share", lambda *args: shares.append(fit(*args)) or shares[-1])
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 16))
    clustered = middle[rng.integers(0, 60, 6000)] + 0.2 * rng.normal(size=(6000, 16))
    assert recall(spark, list(enumerate(clustered.tolist())), 50) >= 0.9
    assert recall(spark, list(enumerate(rng.normal(size=(6000, 16)).tolist())), 50) >= 0.9
    assert shares[0] < 0.1 and shares[0] < shares[1] < 0.6
