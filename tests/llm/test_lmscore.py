"""Language-model scores: exact unigram base, codes, odd inputs, held-out bits."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import lmscore as L
from skylattice.llm.shared import fold
from skylattice.llm.textbytes import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_code_is_a_prefix_code_for_every_byte_before():
    code = L.Code.build(np.random.default_rng(1).integers(0, 9, (L.SYMBOLS, L.SYMBOLS)))
    for before in (0, 97, L.END):
        size = code.size[before * L.SYMBOLS : (before + 1) * L.SYMBOLS]
        assert math.isclose(sum(2.0 ** -float(s) for s in size), 1.0) and size.min() >= 1


def fitted(texts, seed=9):
    """A code and tables with noise in the hashed ones."""
    pairs = np.zeros(L.SYMBOLS**2)
    for _, _, t in slices(pa.array(texts)):
        s, f, _ = L.symbols_of(t)
        pairs += np.bincount(L.previous(s, f, 1) * L.SYMBOLS + s, minlength=L.SYMBOLS**2)
    pairs = pairs.reshape(L.SYMBOLS, L.SYMBOLS)
    code = L.Code.build(pairs)
    rng = np.random.default_rng(seed)
    return code, [rng.integers(-6000, 6000, 1 << b).astype(np.int16) for b in L.SLOT_BITS]


def test_probabilities_are_a_distribution():
    """After a text, with the weights learned from it, the probabilities of all next symbols sum to 1."""
    code, tables = fitted(["abab abba baab", "abba abab"])
    (_, _, t), = slices(pa.array(["abba ab baba abab ab"]))
    symbol, first, _ = L.symbols_of(t)
    one, hashed = L.contexts(symbol, first)
    hashed = [L.lines(h, k) for k, h in enumerate(hashed)]
    n, at = len(symbol), len(symbol) - 1
    weights, fixes = np.repeat(L.START[:, None], L.GATES, axis=1), np.zeros(L.CELLS, np.float32)
    L.advance(code, tables, symbol[:at], one[:at], [h[:at] for h in hashed], np.array([at]), weights, fixes)
    assert np.abs(weights - L.START[:, None]).max() > 0.01 and n > 16
    every = np.arange(L.SYMBOLS)
    same = lambda x: np.full(L.SYMBOLS, x[at])
    logs = L.advance(code, tables, every, same(one), [same(h) for h in hashed], np.ones(L.SYMBOLS, np.int64), np.tile(weights, L.SYMBOLS), np.tile(fixes, L.SYMBOLS))
    assert math.isclose((10.0**logs).sum(), 1.0, rel_tol=2e-3)  # probabilities of decisions are kept from 0


@pytest.mark.parametrize("head", [50, 400_000])
def test_base_is_exact(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD_WORDS", head)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "the THE x \x0b y"), (10**6 + 3, "q" * 5000)], "doc_id long, text string")
    d = d.union(odd)
    rows = [(r.doc_id, r.text or "") for r in d.collect()]
    got = {r.doc_id: r for r in L.score_texts(d, fold("doc_id", 7) != 2).collect()}
    tokens = {i: [*WORD.findall(t.translate(LOW)), None] for i, t in rows}
    counts = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        want = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        assert math.isclose(got[i].base_score, want, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert got[i].score < 0
    bits = -sum(r.score for r in got.values()) / math.log10(2) / sum(r.bytes for r in got.values())
    assert bits < 3.2


def test_order_and_slices_do_not_matter(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(120)], "doc_id long, text string")
    a = {r.doc_id: r.score for r in L.score_texts(d, F.col("doc_id") % 2 == 0).collect()}
    b = {r.doc_id: r.score for r in L.score_texts(d.repartition(5), F.col("doc_id") % 2 == 0).collect()}
    assert all(math.isclose(a[i], b[i], rel_tol=1e-5) for i in a)


def test_no_training_rows(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    rows = L.score_texts(d, F.lit(False)).collect()
    assert {r.n_known for r in rows} == {0} and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert L.score_texts(d.limit(0), F.lit(True)).count() == 0


def one_by_one(code, tables, text):
    """log10 of a text's probability, decision by decision; four sets of weights learn after each block, from its start to its end."""
    (_, _, t), = slices(pa.array([text]))
    symbol, first, _ = L.symbols_of(t)
    one, hashed = L.contexts(symbol, first)
    of, node, bit = L.decisions(code, symbol, one)
    x = [tables[k][L.slots(L.lines(h, k), of, node, k)] for k, h in enumerate(hashed)]
    x = np.column_stack([*(v / 2048 for v in x), np.full(len(of), 0.3)])
    w, fix, total = [L.START.astype(float) for _ in range(L.GATES)], [0.0] * L.CELLS, 0.0
    bounds = L.blocks(len(symbol))
    for low, high in zip(bounds, bounds[1:], strict=False):
        slope, turn, tug, hits = [np.zeros(4) for _ in w], [0] * L.GATES, [0.0] * L.CELLS, [0] * L.CELLS
        for row, y in zip(x[(of >= low) & (of < high)], bit[(of >= low) & (of < high)].tolist(), strict=True):
            k = int(abs(row[1]) > 1) + 2 * int(abs(row[2]) > 1)
            s = float(row @ w[k])
            cell = int(min(max(s + 4, 0), 7))
            p = 1 / (1 + math.exp(-s - fix[cell]))
            slope[k] += row * (y - p)
            turn[k] += 1
            tug[cell] += y - p
            hits[cell] += 1
            total += math.log10(min(max(1 - abs(y - p), 1e-5), 1 - 1e-5))
        w = [v + float(L.RATE) * d / math.sqrt(1 + m / 16) for v, d, m in zip(w, slope, turn, strict=True)]
        fix = [v + float(L.REFINE) * d / math.sqrt(1 + m / 16) for v, d, m in zip(fix, tug, hits, strict=True)]
    return total


def say(rng, n):
    return " ".join("".join("abcdefgh"[c] for c in rng.integers(0, 8, rng.integers(1, 7))) for _ in range(n))


def test_learning_goes_on_to_the_end_of_long_texts():
    rng = np.random.default_rng(9)
    texts = [say(rng, 1500), "", say(rng, 3), say(rng, 60) + " and so on" * 300, say(rng, 200)]
    code, tables = fitted(texts)
    want = [one_by_one(code, tables, t) for t in texts]
    size = [len(t) + 1 for t in texts]
    for parts in ([texts], [texts[:2], texts[2:]]):
        logs = L.log_probabilities(code, tables, [t for p in parts for _, _, t in slices(pa.array(p))]).astype(float)
        got = np.add.reduceat(logs, np.cumsum(size) - size)
        assert np.allclose(got, want, rtol=1e-3)


@pytest.mark.parametrize("head", [2, 100_000])
def test_lines_are_remembered(spark, monkeypatch, head):
    """The score is that of a plain mixture of each line's decisions and its share among the other texts' training lines."""
    plain = L.log_probabilities

    monkeypatch.setattr(L, "HEAD_LINES", head)
    rng = np.random.default_rng(4)
    lines = [say(rng, 6) for _ in range(30)]
    rows = [(i, "\n".join(lines[j] for j in rng.integers(0, 30, i % 5))) for i in range(60)]
    rows += [(100, lines[0] + "\n" + lines[0]), (101, "alone here"), (102, None), (103, "two\n\n\n"), (103, "two\n")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train string")
    train = F.col("doc_id") % 3 != 0
    tables = []
    gather = L._gather_decisions
    monkeypatch.setattr(L, "_gather_decisions", lambda t, code: tables.append((code, gather(t, code))) or tables[-1][1])
    got = sorted((r.doc_id, r.bytes, r.score) for r in L.score_texts(d, train).collect())
    code, hashed = tables[0]
    counts = Counter(x for i, t in rows if i % 3 for x in (t or "").split("\n"))
    n = sum(counts.values())
    share = sum(c for c in counts.values() if c > 1) / (n + 1)
    want = []
    for i, t in rows:
        t = t or ""
        logs = plain(code, hashed, [p for _, _, p in slices(pa.array([t]))]).astype(float)
        total, at, own = 0.0, 0, Counter(t.split("\n") if i % 3 else ())
        for x in t.split("\n"):
            value = logs[at : at + len(x) + 1].sum()
            at += len(x) + 1
            total += math.log10((1 - share) * 10**value + share * (counts[x] - own[x]) / n)
        want.append((i, len(t), total))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4)
