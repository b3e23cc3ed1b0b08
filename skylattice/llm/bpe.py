"""Byte-level BPE encoding and decoding.

Each pre-token is merged on a segment tree over its byte positions.  A leaf holds
rank * width + position of the pair that starts there (or nothing), an inner node the
smaller of its children, so the root is the leftmost pair of lowest rank.  A merge
changes three leaves: the merged pair, the pair before it and the swallowed one; each
change climbs one path.  The trees of many pre-tokens of the same width are rows of one
array and advance together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbytes import bounded_batches

_NONE = np.int64(1 << 62)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank.  The path is read by the driver; the file is of vocabulary size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class SegmentTreeBpe:
    """Encodes and decodes by a table of ranks; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or a number above all ranks."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (right >= 0), self.pair_rank[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece, none of which is empty."""
        out: list[list[int]] = [[]] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            else:
                widths.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in widths.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                if len(part) < 16:  # too few rows to advance together
                    for i in part:
                        out[i] = self._merge_one(pieces[i], width)
                    continue
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n, size = len(pieces), np.array([len(p) for p in pieces], np.int64)
        token = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width) < size[:, None]
        token[:, :width][inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(1, width + 1)[None, :].repeat(n, 0), size[:, None])  # the next live part; at the end the size, then -1 as token
        before = np.arange(-1, width - 1)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        leaf = self.rank_of(token[:, :width], token[:, 1:])
        place = np.arange(width)
        tree[:, width:] = np.where(inside & (leaf < _NONE), leaf * width + place, _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # from here on flat views: wide rows of token, after and before, and of the trees
        parts, nodes = width + 1, 2 * width
        after = np.concatenate([after, np.full((n, 1), width)], axis=1).ravel()
        before = np.concatenate([before, np.full((n, 1), -1)], axis=1).ravel()
        flat, heap = token.ravel(), tree.ravel()
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            base, root = row * parts, row * nodes
            rank, here = np.divmod(heap[root + 1], width)
            gone = after[base + here]
            next_ = after[base + gone]
            flat[base + here], flat[base + gone], after[base + here] = rank, -1, next_
            inner = np.flatnonzero(next_ < size[row])
            before[base[inner] + next_[inner]] = here[inner]
            rank_right = self.rank_of(rank, np.where(next_ < size[row], flat[base + next_], -1))
            prior = before[base + here]
            some = np.flatnonzero(prior >= 0)
            p = prior[some]
            rank_left = self.rank_of(flat[base[some] + p], rank[some])
            leaf = np.concatenate([gone + root, here + root, p + root[some]]) + width
            heap[leaf] = np.concatenate([np.full(len(row), _NONE), np.where(rank_right < _NONE, rank_right * width + here, _NONE), np.where(rank_left < _NONE, rank_left * width + p, _NONE)])
            self._climb(heap, nodes, width, leaf)
            row = row[heap[root + 1] < _NONE]
        live = token[:, :width] >= 0
        ids, cut = token[:, :width][live].tolist(), np.cumsum(live.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def _merge_one(self, piece: bytes, width: int) -> list[int]:
        """The same on plain lists, for a lone or very long piece."""
        n, none, pairs = len(piece), int(_NONE), self.pairs
        token = [*map(self.single.tolist().__getitem__, piece), -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 32 | token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value

        while tree[1] < none:
            rank, here = divmod(tree[1], width)
            gone = after[here]
            next_ = after[gone]
            token[here], token[gone], after[here] = rank, -1, next_
            put(gone, none)
            if next_ < n:
                before[next_] = here
                right = pairs.get(rank << 32 | token[next_])
                put(here, none if right is None else right * width + here)
            else:
                put(here, none)
            prior = before[here]
            if prior >= 0:
                left = pairs.get(token[prior] << 32 | rank)
                put(prior, none if left is None else left * width + prior)
        return [x for x in token if x >= 0]

    @staticmethod
    def _climb(heap: np.ndarray, nodes: int, width: int, leaf: np.ndarray) -> None:
        """After point updates: the nodes on the paths from these leaves to their roots."""
        root, at = leaf - leaf % nodes, leaf % nodes
        while width > 1:
            at >>= 1
            child = root + 2 * at
            heap[root + at] = np.minimum(heap[child], heap[child + 1])
            width >>= 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class CachedEncoder:
    """Encodes texts; the ids of pre-tokens seen are kept, at most ``most`` of them."""

    def __init__(self, codec: SegmentTreeBpe, most: int = 200_000):
        self.codec, self.most, self.known = codec, most, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = list(map(self.codec.pattern.findall, texts))
        if len(self.known) > self.most:
            self.known.clear()
        fresh = list({piece for pieces in split for piece in pieces if piece not in self.known})
        self.known.update(zip(fresh, map(tuple, self.codec.merge_all([p.encode() for p in fresh])), strict=True))
        return [list(chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in split]


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids themselves.

    A null or empty text has no tokens and the digest of nothing.  Repeated ids give repeated rows;
    columns other than the two named are not read.  The ranks are of vocabulary size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((ranks, pattern))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        encoder = CachedEncoder(SegmentTreeBpe(*sent.value))
        text_of = [str(i) for i in range(max(encoder.codec.bytes_of) + 1)]
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for at in range(0, len(texts), 512):
                encoded = encoder.encode(texts.slice(at, 512).to_pylist())
                columns = [
                    batch.column(0).slice(at, 512),
                    pa.array(list(map(len, encoded)), pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(text_of.__getitem__, x)).encode()).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(encoder.codec.decode(x)).hexdigest() for x in encoded]),
                ]
                if ids:
                    columns.append(pa.array(encoded, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def decode_table(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (the bytes) of rows of ids; null ids give no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches):
        table = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(table[i] for i in x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, data binary")
