"""Line dedup against an exact search for repeated runs; odd inputs."""

import random

import numpy as np
import pytest

from skylattice.llm import linededup


def words(n, rng, pool=2000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def brute(rows, least=50):
    """Lines (by number among those with words) inside a run of ``least`` words that occurs earlier."""
    first, gone = {}, {}
    for i, text in sorted(rows):
        units = [tuple(x.lower().split()) for x in text.split("\n") if x.split()]
        out = set()
        for a in range(len(units)):
            total = 0
            for b in range(a, len(units)):
                total += len(units[b])
                if total >= least:
                    key = tuple(units[a : b + 1])
                    if key in first:
                        out.update(range(a, b + 1))
                    first.setdefault(key, (i, a))
        gone[i] = out, units
    return gone


def test_repeated_passages_go_and_others_stay(spark):
    rng = random.Random(2)
    passages = [[words(rng.randrange(51, 90), rng)] for _ in range(4)] + [[words(rng.randrange(10, 40), rng) for _ in range(6)] for _ in range(4)]
    short = words(9, rng)
    rows = []
    for i in range(60):
        parts = [[words(rng.randrange(3, 60), rng)] for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        parts.insert(rng.randrange(len(parts) + 1), [short])
        rows.append((i, "\n".join(line for part in parts for line in part)))
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lines int")
    got = {r.doc_id: r for r in linededup.dedup_lines(d).collect()}
    for i, (out, units) in brute(rows).items():
        left = [tuple(x.lower().split()) for x in got[i].text.split("\n") if x.split()]
        # the short line beside a passage goes only with the copy that the passage is compared with
        known = tuple(short.split())
        assert [u for u in left if u != known] == [u for k, u in enumerate(units) if k not in out and u != known]
        assert got[i].lines_removed == len(units) - len(left) and got[i].words_removed == sum(map(len, units)) - sum(map(len, left))
        assert len(left) >= len(units) - len(out)
    assert sum(r.lines_removed > 0 for r in got.values()) > 20


def test_odd_inputs(spark):
    rng = random.Random(3)
    long = words(60, rng)
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, long + "\n\n" + long.upper() + "\nend"), (5, long), (5, long), (6, "x\n" + long.replace(" ", "\t")), (None, long), (7, "a\n" * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.lines_removed) for r in linededup.dedup_lines(d).collect())
    text = {(i, n): t for i, t, n in got}
    assert text[-1, 0] == long  # no id comes first
    assert (1, None, 0) in got and (2, "", 0) in got and (3, "\n \n", 0) in got
    assert (4, "end", 2) in got and got.count((5, "", 1)) == 2 and (6, "x", 1) in got
    assert any(i == 7 and n > 2900 for i, _, n in got)  # a line repeated within one document
    assert linededup.dedup_lines(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(d.withColumnRenamed("doc_id", "lines_removed"), id_col="lines_removed")


def test_equal_runs_share_a_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(3, 12))
        shared, size = rng.integers(0, 2**62, n).astype(np.uint64), rng.integers(5, 30, n)
        if size.sum() < 50:
            continue
        prints = []
        for _ in range(2):
            before, after = (rng.integers(0, 2**62, int(rng.integers(0, 5))).astype(np.uint64) for _ in range(2))
            h = np.concatenate([before, shared, after])
            w = np.concatenate([rng.integers(5, 30, len(before)), size, rng.integers(5, 30, len(after))])
            low, high, key = linededup.windows(h, w, np.zeros(len(h), np.int64), 50)
            spot = linededup.winnowed(h, low, high)
            assert all(spot[i] == low[i] + np.argmin(h[low[i] : high[i]]) for i in range(len(low)))
            prints.append(dict(zip(key.tolist(), h[spot].tolist(), strict=True)))
        both = prints[0].keys() & prints[1].keys()
        assert both and all(prints[0][k] == prints[1][k] for k in both)


def assert_as_brute(spark, rows):
    """No line more and no line less than brute() is deleted; how many were."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(d).collect()}
    gone = 0
    for i, (out, units) in brute(rows).items():
        assert [tuple(x.lower().split()) for x in got[i].text.split("\n") if x.split()] == [u for k, u in enumerate(units) if k not in out]
        assert (got[i].lines_removed, got[i].words_removed) == (len(out), sum(len(units[k]) for k in out))
        gone += len(out)
    return gone


def test_whole_copies_after_a_short_excerpt(spark):
    rng = random.Random(11)
    rows = []
    for k in range(8):
        passage = [words(3, rng) for _ in range(20)]
        rows.append((100 * k, "\n".join([words(7, rng), *passage[2:18], words(7, rng)])))  # 48 words of it
        rows += [(100 * k + i, "\n".join([words(7, rng), *passage, words(7, rng)])) for i in range(1, 21)]
    assert assert_as_brute(spark, rows) == 8 * 19 * 20


def test_every_line_matches_brute_force(spark):
    rng = random.Random(12)
    passages = [[words(rng.randrange(1, 9), rng) for _ in range(30)] for _ in range(5)] + [[words(rng.randrange(20, 70), rng) for _ in range(5)] for _ in range(5)]
    common = words(4, rng)
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            lines += [words(rng.randrange(1, 20), rng)] * rng.randrange(2) + p[a : a + rng.randrange(1, len(p))] + [common] * rng.randrange(3)
        rows.append((i, "\n".join(lines)))
    rows.append((150, "one word\n" * 200))
    assert assert_as_brute(spark, rows) > 500
