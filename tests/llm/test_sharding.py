"""The filled table: turns, balance, small changes; placement of odd keys."""

from collections import Counter

import pytest

from skylattice.llm import sharding


def brute(shards, size):
    import hashlib

    order = sorted(range(len(shards)), key=lambda i: shards[i])
    wish = {}
    for i in order:
        d = hashlib.md5(shards[i].encode()).hexdigest()
        offset, skip = int(d[:15], 16) % size, int(d[15:30], 16) % (size - 1) + 1
        wish[i] = iter([(offset + j * skip) % size for j in range(size)])
    taken = {}
    while len(taken) < size:
        for i in order:
            slot = next((s for s in wish[i] if s not in taken), None)
            if slot is not None:
                taken[slot] = i
    return [taken[s] for s in range(size)]


@pytest.mark.parametrize("n", [1, 2, 7, 13])
def test_turns(n):
    names = [f"s{i}" for i in range(n)]
    assert sharding.fill_table(names, 101) == brute(names, 101)


def test_balance_and_disruption():
    names = [f"s{i}" for i in range(20)]
    before = sharding.fill_table(names)
    share = Counter(before)
    assert max(share.values()) - min(share.values()) <= 1
    after = sharding.fill_table(names[:-1])
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.1 * len(before)


def test_bad_arguments():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)


def test_rows(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, None)] + [(None, str(i)) for i in range(200)]
    d = spark.createDataFrame(rows, "k long, t string")
    out = sharding.assign_shards(d, ["k"], [f"s{i}" for i in range(8)], size=101)
    got = out.collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.k == 1}) == 1
    assert len({r.shard for r in got if r.k is None}) == 8  # rows without a key spread
    assert all(r.shard == f"s{r.shard_id}" for r in got)
    assert sharding.assign_shards(d.limit(0), ["k"], ["s"], size=101).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(d.withColumnRenamed("t", "slot"), ["k"], ["s"], size=101)
    assert "shard" in sharding.assign_shards(d.withColumnRenamed("t", "slot"), ["k"], ["s"], size=101, prefix="new_").columns[-1]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
