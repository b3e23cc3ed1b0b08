"""Collocations against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skylattice.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest=3, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in f.items():
        frequent = {p: a for p, a in found.items() if a >= least and len(p) > 1}
        gone = {q for p, a in frequent.items() for k in range(2, len(p)) for q in (p[i : i + k] for i in range(len(p) - k + 1)) if 100 * a >= 50 * frequent[q]}
        kept = []
        for p, a in frequent.items():
            if p not in gone:
                score, _, l, r = min((1000000 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    found = phrases.collocations(df, **more)
    assert found.dtypes == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    return sorted(tuple(r) for r in found.collect())


def texts(seed=1, n=400):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "city", "a", "ab", "b", "éa", "Éa", "x\x0by", "z\x85z", "\x00", "ß", "日本", "co-op", "zeta"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ", ", "\n", "; ", "?", "\r\n", "!a:"]
    for i in range(n):
        k = int(rng.integers(0, 40))
        yield i, "".join(words[int(rng.zipf(1.5)) % len(words)] + ends[int(rng.integers(0, len(ends)))] for _ in range(k)), [None, "en", "de", "und", ""][int(rng.integers(0, 5))]


@pytest.mark.parametrize("shard", [200, 1 << 22])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_plain_counting(spark, shard, longest, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rows = [*texts(), (900, None, "en"), (901, "", "en"), (902, "new york " * 3000, "en"), (903, "new york " * 3000, "en"), (904, "aa aa aa aa aa aa aa aa aa aa aa aa", None), (None, "of the new york city", "en")]
    want = brute(rows, longest)
    assert len(want) > 50
    assert mined(spark, rows, longest=longest) == want


def test_caps_by_language_and_ties(spark):
    rows = [(i, " . ".join(f"w{j} v{j}" for j in range(60)), lang) for i in range(10) for lang in ("en", "de")]
    for most in (1, 7, 59):
        assert mined(spark, rows, most=most) == brute(rows, most=most)


def test_empty_tables_and_rare_words(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None), (2, "", "en"), (3, " \t\n.,", "en")]) == []
    assert mined(spark, [(1, "one two three", "en")]) == []


def test_products_past_64_bits(spark):
    rows = spark.createDataFrame([(5_000_000_000, 7_000_000_001, 6_000_000_007)], "a long, l long, r long")
    got = rows.selectExpr("CAST((1000000 * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT) AS s").first().s
    assert got == 1_000_000 * 5_000_000_000**2 // (7_000_000_001 * 6_000_000_007)
