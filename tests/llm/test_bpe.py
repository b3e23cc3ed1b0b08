"""Encoding against the tiktoken library, and round trips."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
CODEC = bpe.SegmentTreeBpe(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", "a", "  \n\n x", "a" * 3000, "ab" * 20_000, "ß" * 333, "😀é" * 40, "\x00\x01" * 30, "<|endoftext|>", "Don't stop 12345"]


def test_same_as_the_library():
    assert bpe.CachedEncoder(CODEC).encode(ODD) == [LIBRARY.encode_ordinary(x) for x in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=30))
def test_any_text(texts):
    got = bpe.CachedEncoder(CODEC, most=5).encode(texts)
    assert got == [LIBRARY.encode_ordinary(x) for x in texts]
    assert [CODEC.decode(x).decode() for x in got] == texts


def test_both_tree_forms_agree():
    pieces = [bytes([97 + (i * j) % 7 for j in range(2 + i % 30)]) for i in range(200)]
    for width in (2, 4, 8, 16, 32):
        part = [p for p in pieces if 1 << (len(p) - 1).bit_length() == width]
        assert CODEC._merge(part, width) == [CODEC._merge_one(p, width) for p in part]


def test_table(spark):
    rows = [(i, x, 1) for i, x in enumerate(ODD)] + [(None, None, 1), (0, "again", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.encode_decode(d, RANKS, P.PATTERN, ids=True)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for _, x, _ in rows:
        ids = LIBRARY.encode_ordinary(x or "")
        want.append((len(ids), sha(",".join(map(str, ids)).encode()), sha((x or "").encode())))
    assert got == sorted(want)
    back = bpe.decode_table(out, RANKS)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((x or "").encode() for _, x, _ in rows)
    assert bpe.encode_decode(d.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("piece", [b"q" * 2, b"zzzzzzzz"])
def test_every_byte_is_known(piece):
    assert CODEC.decode(CODEC.merge_all([piece])[0]) == piece
