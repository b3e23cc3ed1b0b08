"""Leaks against a plain search; re-parameterised questions; slot clashes."""

import random

from skylattice.llm import decontaminate as D


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_templates_and_slots(spark):
    items = [(1, "If Tom has 5 apples and buys 7 kg of pears how many does Tom own"), (2, "too short"), (3, "What is the capital city"), (4, None)]
    docs = [
        (10, "so now If Anna has 12 apples and buys 9 kg of pears how many does Anna own ok"),
        (11, "so now If Anna has 12 apples and buys 9 kg of pears how many does Berta own ok"),
        (12, "clean text about other things entirely and nothing more than that"),
        (13, None),
        (14, "we ask what is the capital city now"),
        (15, "then if Tom has 5 apples and buys 7 kg of pears how many does Tom own?"),
        (None, items[0][1]),
    ]
    d, b = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(d, b).collect()}
    assert set(got) == {(10, 1), (14, 3), (15, 1)}
    assert got[10, 1].slots_differ and not got[15, 1].slots_differ
    kept = sorted(str(r.doc_id) for r in D.remove_leaking(d, D.leaks(d, b)).collect())
    assert kept == ["11", "12", "13", "None"]
    assert D.leaks(d, b.limit(0)).count() == 0 and D.leaks(d.limit(0), b).count() == 0


def test_plain_passages_match_brute_force(spark):
    rng = random.Random(6)
    say = lambda n: [f"v{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}{'uvwxyz'[rng.randrange(6)]}" for _ in range(n)]
    items = [(i, say(rng.randrange(9, 40))) for i in range(20)]
    docs = []
    for i in range(80):
        text = say(rng.randrange(0, 60))
        if rng.random() < 0.5:
            _, item = rng.choice(items)
            part = item[: max(1, int(len(item) * rng.choice([0.3, 0.6, 1.0])))]
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((i, text))
    want = set()
    for i, text in docs:
        grams = {tuple(text[k : k + 8]) for k in range(len(text) - 7)}
        for j, item in items:
            mine = {tuple(item[k : k + 8]) for k in range(len(item) - 7)}
            if len(mine & grams) >= 0.4 * len(mine):
                want.add((i, j))
    d = frame(spark, [(i, " ".join(t), "x") for i, t in docs], "doc_id long, text string, hash string")
    b = frame(spark, [(i, " ".join(t)) for i, t in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()} == want and want


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}{c}" for c in "abcdefghijklmnop").replace("0", "o").replace("1", "i").replace("2", "z").replace("3", "e")) for i in range(4)]
    docs = [(i, f"start here {t} end") for i, t in items]
    d, b = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    whole = sorted(map(tuple, D.leaks(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK", 10)
    d = d.union(frame(spark, [(100 + i, f"r{i} s{i} t{i} u{i} v{i} w{i} x{i} y{i} z{i}") for i in range(50)], "doc_id long, text string"))
    assert sorted(map(tuple, D.leaks(d, b).collect())) == whole and len(whole) == 4


def test_items_of_slots_and_short_items_are_found_literally(spark):
    items = [
        (1, "What is 12 + 34 - 5 * 6"),
        (2, "3 1 4 1 5 9 2 6 5 3 5 8 9 7"),
        (3, "list Anna Berta Carla Dora Emma Frida Greta Hanna Ida"),
        (4, "quux 77"),
        (5, "sum up the first few of these odd things 3 5 7 9 11 13 15 17 19 21 23 25 27"),
        (6, "--"),
    ]
    docs = [(10 * i, f"some words before, {t} and after") for i, t in items]
    docs += [
        (11, "some words, What is 13 + 34 - 5 * 6"),  # other numbers in what is found literally only
        (21, "3 1 4 1 5 9 2 7 5 3 5 8 9 7"),
        (41, "quux 78 and 77 quux"),
        (51, "Sum up the first few of these odd things 4 6 8"),  # the template alone
        (61, "-- clean --"),
    ]
    d, b = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(d, b).collect()}
    assert set(got) == {(10, 1), (20, 2), (30, 3), (40, 4), (50, 5), (51, 5)}
    assert got[20, 2].coverage == 1.0 and not got[20, 2].slots_differ


def test_names_that_open_a_sentence(spark):
    items = [(1, "Alice has seven red apples in the old basket"), (2, "Where does the river end")]
    docs = [
        (1, "So it is. Boris has seven red apples in the old basket"),
        (2, "we saw that Boris has seven red apples in the old basket"),
        (3, "tell me where does the river end"),
        (4, "Boris has seven red apples. In the old basket"),
    ]
    d, b = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in D.leaks(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 1)} and got[1, 1] == got[2, 1] == 1.0


def test_repeated_ids_and_long_texts(spark):
    item = "Tom sells 12 green boats to 3 men and then 4 old blue boats to Anna"
    other = item.replace("12", "19").replace("Tom", "Per")
    docs = [(1, "nothing here"), (1, f"x {item}"), (2, "pad out " * 30_000 + other + " pad out" * 30_000), (3, None), (3, ""), (2, other)]
    d = spark.createDataFrame([(*r, "h", 1) for r in docs], "doc_id long, text string, hash string, place int")
    b = frame(spark, [(7, item), (7, item), (None, item), (8, "")], "item_id long, text string")
    rows = D.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id, r.coverage, r.slots_differ) for r in rows} == {(1, 7, 1.0, False), (2, 7, 1.0, True)} and len(rows) == 2
    kept = D.remove_leaking(d, D.leaks(d, b))
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [3, 3]
