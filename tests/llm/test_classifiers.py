"""Toxicity and quality: exactness of the search, held-out accuracy, odd inputs."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import quality, toxicity
from skylattice.llm.shared import fold
from skylattice.llm.textbytes import slices


@pytest.mark.parametrize("common", [2.0, 0.15, 0.0])
def test_block_max_search_is_exact(common):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((300, 40)) < 0.15, rng.random((300, 40)), 0)
    dense[:20] = dense[0]  # ties
    norm = np.sqrt((dense**2).sum(1, keepdims=True))
    dense = dense / np.where(norm > 0, norm, 1)
    ids = np.random.default_rng(4).permutation(300) * 3
    row, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.build(ids, row, term, dense[row, term], 40, width=16, common=common)
    q, place, cosine = index.nearest(row, term, dense[row, term], 300, 5, skip=ids)
    full = np.round(dense @ dense.T, 12)
    np.fill_diagonal(full, 0)
    for i in range(300):
        want = [j for j in np.lexsort((ids, -full[i])) if full[i, j] > 0][:5]
        mine = q == i
        assert index.ids[place[mine]].tolist() == ids[want].tolist() and np.allclose(cosine[mine], full[i, want], atol=1e-9)


def plain_terms(text):
    flat = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", flat))


def test_toxicity_against_all_examples(spark):
    """Neighbours and scores of every text by a plain scalar version; without neighbours are only texts without a known term."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where(fold("doc_id", 5) != 0)
    extra = spark.createDataFrame([(-1, "zzz qqq"), (-2, None), (-3, "...")], "doc_id long, text string")
    d = d.select("doc_id", "text").union(extra)
    voter = toxicity.fit_toxicity(d, labels)
    texts, toxic = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    known = [i for i in sorted(toxic) if i in texts]
    held = {i: plain_terms(texts[i]) for i in texts}
    n = len(known)
    smallest = {i: min((toxicity.mix(h) for h in hashed_terms(texts[i])), default=None) for i in known}
    share = {i: 1 / sum(smallest[j] == smallest[i] for j in known) for i in known}
    weight = {}
    for term in {t for i in known for t in held[i]}:
        have = [i for i in known if term in held[i]]
        a = sum(share[i] * toxic[i] for i in have)
        b = sum(share[i] for i in have) - a
        c = sum(share[i] * toxic[i] for i in known) - a
        e = sum(share.values()) - a - b - c
        weight[term] = math.log(n / len(have)) * (0.02 + abs(a * e - b * c) / math.sqrt(max((a + b) * (c + e) * (a + c) * (b + e), 1e-9)))

    def vector(i):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in held[i].items() if weight.get(t, 0) > 0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in texts}
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, voter).collect()}
    assert got[-1].nearest == got[-2].nearest == got[-3].nearest == []
    for i in sorted(texts):
        cosines = {j: round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 9) for j in known}
        mine = got[i].nearest
        assert bool(mine) == any(c > 0 for c in cosines.values())
        best = sorted((c for c in cosines.values() if c > 0), reverse=True)[:15]
        assert np.allclose([cosines[j] for j in mine], best, atol=1e-8) and np.allclose(got[i].cosines, best, atol=1e-8)
        if mine:
            w = [1 / (1.05 - c) for c in got[i].cosines]
            raw = sum(x * toxic[j] for x, j in zip(w, mine, strict=True)) / sum(w)
            assert abs(got[i].score - np.interp(raw, *voter.knots)) < 1e-9


def hashed_terms(text):
    column = pa.array([text or ""])
    return next((toxicity.term_counts(t)[1] for _, _, t in slices(column)), np.zeros(0, np.uint64))


def test_quality_against_all_examples(spark):
    """Latent vectors and votes of every text by a plain scalar version."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    d = d.union(spark.createDataFrame([(-1, ""), (-2, "One\ttwo two."), (-3, "né 12 né")], "doc_id long, text string"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where(fold("doc_id", 5) != 0)
    voter = quality.fit_voter(d, labels)
    texts, truth = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    known = [i for i in sorted(truth) if i in texts]
    assert voter.labels.tolist() == [float(truth[i]) for i in known]
    place = {int(h): quality.FEATURES + i for i, h in enumerate(voter.vocabulary)}

    def latent(text):
        data = (text or "").encode()
        kind = [int(quality._CLASS[b]) for b in data]
        pairs = Counter(a * quality._CLASSES + b for a, b in zip(kind, kind[1:], strict=False))
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        lower = [w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        shapes = Counter()
        for i, w in enumerate(words):
            size = (len(w) > 2) + (len(w) > 6) + (len(w) > 12)
            again = int(i > 0 and lower[i] == lower[i - 1])
            shapes[quality._PAIRS + ((int(quality._COARSE[w[0]]) * quality._CLASSES + int(quality._CLASS[w[-1]])) * 4 + size) * 2 + again] += 1
        terms = Counter()
        for w, k in Counter(lower).items():
            (h,) = next(t.hashes(*t.words()[:2]) for _, _, t in slices(pa.array([w.decode()])))
            if int(h) in place:
                terms[place[int(h)]] = k
        out = np.zeros(voter.basis.shape[1])
        for block in (pairs, shapes, terms):
            v = {c: math.log1p(k) * voter.weight[c] for c, k in block.items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            for c, x in v.items():
                out += x / norm * voter.basis[c]
        return out / (np.linalg.norm(out) or 1)

    vectors = {i: latent(texts[i]) for i in texts}
    assert np.allclose(np.abs(np.array([vectors[i] @ voter.examples[n] for n, i in enumerate(known)])), 1, atol=1e-4)
    for r in quality.score_quality(d, voter).collect():
        cosine = [round(float(vectors[r.doc_id] @ e), 12) for e in voter.examples]
        best = sorted(range(len(cosine)), key=lambda j: (-cosine[j], j))[: voter.k]
        w = [max(0.0, min(1.0, cosine[j])) ** voter.power for j in best]
        want = sum(x * voter.labels[j] for x, j in zip(w, best, strict=True)) / sum(w) if sum(w) else voter.prior
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_quality_ties_go_to_the_smaller_id():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]])
    assert quality._largest(cosine, 3).tolist() == [[0, 1, 2], [0, 1, 2]]


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def accuracy(scored, labels, label):
    both = scored.join(labels.where(fold("doc_id", 5) == 0), "doc_id")
    right = both.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= right[1] <= right[2] <= 1 and right[3] > 100
    return right[0]


def test_toxicity_held_out(docs):
    d, labels = docs
    voter = toxicity.fit_toxicity(d, labels.where(fold("doc_id", 5) != 0))
    assert accuracy(toxicity.score_toxicity(d, voter), labels, "toxic") > 0.97


def test_quality_held_out(docs):
    d, labels = docs
    voter = quality.fit_voter(d, labels.where(fold("doc_id", 5) != 0))
    assert accuracy(quality.score_quality(d, voter), labels, "quality") > 0.97
    assert quality.keep(d, voter).columns == d.columns


def test_quality_keeps_rows_as_they_are(spark):
    d = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    kept = quality.keep(d, quality.fit_voter(d, labels))
    assert kept.columns == d.columns and kept.count() == len(ODD)
    assert quality.keep(d.limit(0), quality.fit_voter(d, labels)).count() == 0
    assert quality.keep(d, quality.fit_voter(d, labels.withColumn("quality", F.lit(0)))).count() < len(ODD)


ODD = [(1, None), (2, ""), (3, "a"), (None, "x y"), (4, "word " * 40_000), (5, "same"), (5, "same"), (6, "\x00\x01 é")]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_inputs(spark, module):
    fit, score = (quality.fit_voter, quality.score_quality) if module is quality else (toxicity.fit_toxicity, toxicity.score_toxicity)
    d = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    voter = fit(d, labels)
    rows = score(d, voter).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(d.limit(0), voter).count() == 0
    unlabelled = fit(d, labels.limit(0))
    assert {r.score for r in score(d, unlabelled).collect()} == {0.5}
