"""Words, lines and windows made of Thue-Morse sequences: sums of powers modulo 2**64 can't tell them apart."""

import math

import numpy as np
import pytest

from skylattice.llm import decontaminate, linededup, lmscore, neardup
from skylattice.llm.textbytes import TextSlice, folded_bytes, folded_ranges


def thue_morse(n: int, zero: str, one: str) -> list[str]:
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def pair(n: int) -> tuple[str, str]:
    return "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))


@pytest.mark.parametrize("n", [8, 64, 256, 1024, 4096, 65_536])
def test_words_of_any_length_have_their_own_hashes(n):
    a, b = pair(n)
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    starts, ends, _ = TextSlice(data, np.array([0, len(data)])).words()
    for family in (0, 1):
        h = folded_bytes(data, starts, ends, family)
        assert h[0] != h[1] and h[0] == h[2]
    assert folded_bytes(data, starts, ends, 0)[0] != folded_bytes(data, starts, ends, 1)[0]


@pytest.mark.parametrize("n", [8, 50, 2048])
def test_sequences_of_values_have_their_own_hashes(n):
    a, b = (np.array([ord(x) for x in "".join(thue_morse(n, *ab))], np.uint64) for ab in ("xy", "yx"))
    values = np.concatenate([a, b, a])
    at = np.arange(3) * n
    h = folded_ranges(values, at, at + n)
    assert h[0] != h[1] and h[0] == h[2]


def test_bytes_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 255, 256, 257, 1000):
        word = rng.integers(0, 256, n).astype(np.uint8)
        data = np.concatenate([rng.integers(0, 256, 3).astype(np.uint8), word, rng.integers(0, 256, 5).astype(np.uint8), word])
        h = folded_bytes(data, np.array([3, 8 + n]), np.array([3 + n, 8 + 2 * n]))
        assert h[0] == h[1]


@pytest.mark.parametrize("n", [1024, 65_536])
def test_line_dedup_keeps_what_never_occurred(spark, n):
    shared = " ".join(f"word{i}" for i in range(59))
    a, b = pair(n)
    docs = spark.createDataFrame([(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"{shared} {b}")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.lines_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (f"{shared} {a}", 0), 2: (f"{shared} {b}", 0), 3: ("", 1)}
    lines = [" ".join(thue_morse(n // 16, *ab)) for ab in (("x", "y"), ("y", "x"))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.lines_removed for r in linededup.dedup_lines(docs).collect()] == [0, 0]


@pytest.mark.parametrize("n", [1024, 65_536])
def test_near_duplicates_do_not_link_strangers(spark, n):
    a, b = pair(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs, words=2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (2, False)}


@pytest.mark.parametrize("n", [1024, 65_536])
def test_counts_of_words_and_lines_are_exact(spark, n):
    a, b = pair(n)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.score_texts(docs, docs.doc_id > 0).collect()}
    # 4 tokens, 3 distinct: each word once, the end twice
    want = math.log10(2 / (4 + 4)) + math.log10(3 / (4 + 4))
    assert all(abs(r.base_score - want) < 1e-9 and r.train_tokens == 4 for r in got.values())


@pytest.mark.parametrize("n", [1024, 65_536])
def test_no_leak_of_a_word_that_is_not_the_items(spark, n):
    a, b = pair(n)
    item = "which of these rivers flows past the old town {} into the sea"
    docs = spark.createDataFrame([(1, item.format(b)), (2, item.format(a))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item.format(a)), (8, a)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.leaks(docs, bench, coverage=0.8).collect()}
    assert set(got) == {(2, 7), (2, 8)}
