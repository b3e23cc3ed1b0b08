"""Near duplicates against all pairs; sketches; components."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import neardup
from skylattice.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text, k))
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for n, (i, s) in enumerate(flat):
        for j, t in flat[:n]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in sets}


def near_group(seed, n, words=120):
    """Copies of one text with a few up to a quarter of its words changed, cut or added."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 15])):
            at = rng.randrange(len(copy))
            kind = rng.random()
            if kind < 0.5:
                copy[at] = f"x{rng.randrange(40)}"
            elif kind < 0.8:
                del copy[at]
            else:
                copy.insert(at, f"y{rng.randrange(40)}")
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_groups_match_all_pairs(spark, k):
    rng = random.Random(k)
    texts = near_group(1, 70) + near_group(2, 30, 30) + [" ".join(f"z{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += [texts[0]] * 5 + ["one", "one", "One two", "one TWO", "", None, "  \n ", "a b", "b a"]
    rows = list(enumerate(texts))
    random.Random(9).shuffle(rows)
    d = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, kept string, id int")
    got = {r.doc_id: r for r in neardup.near_duplicates(d, words=k).collect()}
    want = brute(rows, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[i], k)) and r.kept == (i == r.component_id) for i, r in got.items())
    kept = neardup.keep_representatives(d, neardup.near_duplicates(d, words=k))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema), words=2).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (2, None), (3, "a b c"), (3, "q r s")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema), words=2).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 2, True), (3, 1, False), (3, 1, False)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = pool[:3000], pool[500:3400]
    one = lambda s: neardup.sketch(s, np.zeros(len(s), np.int64), 1)[0]
    x, y, both = one(a), one(b), one(np.unique(np.concatenate([a, b])))
    assert (np.maximum(x, y) == both).all()
    j = neardup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([len(a)]), np.array([len(b)]))
    assert abs(j[0] - 2500 / 3400) < 0.1
    owner = np.repeat([0, 1], [len(a), 3])
    two = neardup.sketch(np.concatenate([a, pool[:3]]), owner, 2)
    assert (two[0] == x).all() and (two[1] == one(pool[:3])).all()


def test_components_are_those_of_a_graph(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    parent = {}

    def top(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    d = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(d).collect()} == {i: top(i) for i in parent}
    assert components(d.where(F.lit(False))).count() == 0


def test_one_bucket_of_members_unlike_their_hub(spark, monkeypatch):
    """Everything in one bucket: groups far from the hub, chains that leave it, and members unlike all others."""

    def one_key(values, rows=5):
        return np.ones((len(values), 1), np.uint64)

    monkeypatch.setattr(neardup, "band_keys", one_key)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(50)]
    texts = []
    for c in range(6):  # a chain from the base: each text is linked with the next one, the ends are not
        words = list(base)
        for i in range(9):
            for at in (4 * i + c % 3, 4 * i + 1 + c % 3):
                words[at % 50] = f"c{c}_{at}"
            texts.append(" ".join(words))
    texts += near_group(5, 40, 40) + near_group(6, 25, 80)
    for _ in range(120):  # a common frame with so many words of one's own that no two are linked
        words = list(base)
        for at in rng.sample(range(50), 7):
            words[at] = f"r{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(30)]
    texts += [" ".join(base[:n]) for n in range(20, 50, 3)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    want = brute(rows, 2)
    assert got == want and 100 < len(set(want.values())) < len(rows) - 60
