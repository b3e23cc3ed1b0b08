"""The pipeline's stages and the registered queries."""

import hashlib
import random

import corpus_pipeline
import pytest
import test_linededup
import test_neardup

import __spark_entry__ as entry
from skylattice.llm import bpe


def test_stages_keep_columns_and_shrink(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}"
        out.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        assert 0 < after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "benchmark decontamination", "byte-level BPE"]


@pytest.mark.parametrize("n", range(1, 11))
def test_a_query_for_each_operator(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


def sentence(rng, n, pool=5000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def test_stages_against_plain_versions(spark, tmp_path):
    """Line dedup, near duplicates, decontamination and encoding of one small table, each stage on what the one before kept."""
    rng = random.Random(21)
    passage = [sentence(rng, 15) for _ in range(4)]
    item = "Rosa packs 14 kg of plums into 7 boxes and then carries every single box over to Bruno"
    rows = []
    for i in range(40):
        lines = [sentence(rng, rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))]
        if i % 5 == 1:
            lines[1:1] = passage
        if i % 7 == 3:
            lines.append("so it goes: " + (item if i % 2 else item.replace("14", "25").replace("Rosa", "Greta")))
        rows.append((i, "\n".join(lines)))
    base = sentence(rng, 40).split()
    for i in range(40, 60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            copy[rng.randrange(40)] = f"z{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    rows += [(60, "\n".join(passage)), (61, ""), (62, None), (63, rows[0][1]), (64, "one"), (64, "one"), (65, "x " * 30_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, hash string, lines_removed boolean"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "h", False) for i, t in rows], schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    cut = stages["line dedup"](spark, docs, str(tmp_path))
    want, gone = [], test_linededup.brute([(i, t or "") for i, t in rows])
    for i, t in rows:
        out, units = gone[i]
        lines = [x for x in (t or "").split("\n") if x.split()]
        left = [x for k, x in enumerate(lines) if k not in out]
        if not out:
            want.append((i, t))
        elif left:
            want.append((i, "\n".join(left)))
    assert cut.columns == docs.columns and plain(cut) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") for r in cut.collect()) and 60 not in {i for i, _ in want}

    single = stages["near-duplicates"](spark, cut, str(tmp_path))
    top = test_neardup.brute(want, 5)
    want = [(i, t) for i, t in want if top[i] == i]
    assert single.columns == docs.columns and plain(single) == sorted(want, key=str) and 63 not in {i for i, _ in want}

    clean = stages["benchmark decontamination"](spark, single, str(tmp_path))
    leaking = {i for i, t in want if t and ("packs 14 kg of plums" in t or "packs 25 kg of plums" in t)}
    want = [(i, t) for i, t in want if i not in leaking]
    assert clean.columns == docs.columns and plain(clean) == sorted(want, key=str) and leaking

    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = sorted((r.doc_id, list(r.ids)) for r in stages["byte-level BPE"](spark, clean, str(tmp_path)).collect())
    assert ids == sorted((i, library.encode_ordinary(t or "")) for i, t in want)


def test_stages_of_empty_tables_and_null_ids(spark, folder, tmp_path):
    spark.createDataFrame([(1, "some item of the benchmark that nobody has")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "first text here", "en", "s", 15), (None, "without an id", "en", "s", 13), (None, None, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "None", "None"], name
