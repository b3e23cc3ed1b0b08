"""Hard negatives against all pairs, with ties, copies, odd rows and other lengths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, positives=5, negatives=10):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, x, label in {(i, tuple(v), y) for i, v, y in usable if i % 10 == 0}:
        near = [(-sum(p * q for p, q in zip(x, v)), i, y) for i, v, y in usable if len(v) == len(x) and i != a]
        for s, p, _ in sorted(r for r in near if r[2] == label)[:positives]:
            fits = sorted(r for r in near if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)[:negatives]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    found = hardnegatives.hard_negatives(df, F.col("vec_id") % 10 == 0, scale=256, **more)
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(tuple(r) for r in found.collect())


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(600):
        v = centres[i % 12] + rng.normal(size=16) * 0.4
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(0, 4))))
    rows += [(1000 + i, rows[5][1], i % 4) for i in range(80)]  # copies
    rows += [(2000 + i, [0.5] * 8, i % 2) for i in range(7)]  # another length
    rows += [(3000, None, 1), (3010, [float("nan")] * 16, 1), (3020, [None] * 16, 1), (3030, rows[1][1], None), (3040, [0.0] * 16, 2), (None, rows[2][1], 1), (3050, [], 1), (3051, [], 1), (3052, [], 2)]
    want = brute(rows)
    assert len(want) > 1000
    assert mined(spark, rows) == want


@pytest.mark.parametrize("block", [7, 64])
def test_small_blocks_and_long_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-40, 40, 5) * rng.integers(1, 60)).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_scores_past_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_copies_are_one_entry_and_an_anchor_is_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(24, 8)).astype(np.float32).tolist()
    rows = [(i, kinds[i % 24], i // 24 % 2) for i in range(1200)] + [(1200 + i, rng.normal(size=8).astype(np.float32).tolist(), i % 2) for i in range(100)]
    seen = {"blocks": [], "wanted": []}

    def written(df, name, write=hardnegatives.written):
        out = write(df, name)
        if name in seen:
            seen[name].append(out.selectExpr("sum(octet_length(vectors))").first()[0] if name == "blocks" else out.count())
        return out

    monkeypatch.setattr(hardnegatives, "written", written)
    want = brute(rows)
    assert mined(spark, rows) == want
    assert seen["blocks"] == [(24 * 2 + 100) * 8 * 2]  # a number of 2 bytes for each component of an entry
    assert seen["wanted"] == [len({r[0] for r in want})]


@pytest.mark.parametrize("more", [{}, {"sample": 5}, {"positives": 2, "negatives": 3}])
@pytest.mark.parametrize("labels", [3, 200])
def test_many_groups_small_blocks_and_shared_ids(spark, labels, more, monkeypatch):
    for name, value in (("GROUP", 3000), ("BLOCK", 256), ("CHUNK", 8)):
        monkeypatch.setattr(hardnegatives, name, value, raising=False)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 6))
    rows = [(i // 2 * 2 if i % 9 == 0 else i, (centres[i % 40] + rng.normal(size=6) * 0.1).astype(np.float32).tolist(), int(rng.integers(0, labels))) for i in range(800)]
    rows += [(900 + i, [float(x) for x in rng.integers(-1, 2, 6) / 16], i % labels) for i in range(400)]  # many ties
    assert mined(spark, rows, **more) == brute(rows, **{k: v for k, v in more.items() if k != "sample"})


def test_scores_past_the_whole_numbers_of_doubles(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-300_000, 300_000, 5)).astype(float).tolist(), i % 3) for i in range(300)]
    want = brute(rows)
    assert max(r[4] for r in want) > 2**53
    assert mined(spark, rows) == want
