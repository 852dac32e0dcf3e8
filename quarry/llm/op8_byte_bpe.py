"""Byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding.

A pre-token is a doubly linked list of its bytes. Each neighbouring pair whose
join is in the vocabulary waits in the bucket of its rank; a three-level bitmap
over the ranks gives the lowest bucket that isn't empty by find-first-set.
Positions leave a bucket from the left. An entry whose pair has changed since
is stale and skipped. Each merge changes two pairs, so a pre-token of n bytes
takes O(n log n) steps however long it is.

Defined cases: null text counts as empty (no ids). Special tokens' strings are
ordinary text. Empty tables give empty results; repeated rows are each encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free

#: Pre-tokens that a worker remembers before it starts afresh: bounds its memory, not the result.
REMEMBERED = 900_000
#: Longer pre-tokens aren't remembered.
LONGEST_KEY = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Positions in buckets by rank. Bit r of ``low`` is set while bucket r holds any; bit w of
    ``mid`` while word w of ``low`` isn't zero; bit j of ``top`` while word j of ``mid`` isn't."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        b = self.buckets[rank]
        if b:
            heappush(b, position)
            return
        b.append(position)
        i, j = rank >> 6, rank >> 12
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position. The queue isn't empty."""
        j = (self.top & -self.top).bit_length() - 1
        m = self.mid[j]
        i = (j << 6) | ((m & -m).bit_length() - 1)
        w = self.low[i]
        rank = (i << 6) | ((w & -w).bit_length() - 1)
        b = self.buckets[rank]
        if len(b) > 1:
            return rank, heappop(b)
        self.low[i] = w = w & (w - 1)
        if not w:
            self.mid[j] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, b.pop()


class Encoder:
    """Ids are kept as packed int32, so that those of a text are one join."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        import regex

        self.ranks = dict(ranks)
        self.packed = {k: pack("<i", v) for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.known: dict[str, bytes] = {}
        self.most = REMEMBERED

    def merge(self, piece: bytes) -> bytes:
        """Ids of one pre-token."""
        packed = self.packed
        if piece in packed:
            return packed[piece]
        n = len(piece)
        get, queue = self.ranks.get, self.queue
        push, pop = queue.push, queue.pop
        end = list(range(1, n + 1))  # the token at i is piece[i:end[i]]; its neighbour begins at end[i]
        before = list(range(-1, n - 1))
        pair = [get(piece[i:i + 2], -1) for i in range(n)]  # rank of the pair that begins at i
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        while queue.top:
            r, i = pop()
            if pair[i] != r:
                continue  # stale
            gone = end[i]
            end[i] = e = end[gone]
            pair[gone] = q = -1
            if e < n:
                before[e] = i
                if (q := get(piece[i:end[e]], -1)) >= 0:
                    push(q, i)
            pair[i] = q
            if (p := before[i]) >= 0:
                pair[p] = q = get(piece[p:e], -1)
                if q >= 0:
                    push(q, p)
        out, i = [], 0
        while i < n:
            out.append(packed[piece[i:end[i]]])
            i = end[i]
        return b"".join(out)

    def lookup(self, token: str) -> bytes:
        ids = self.known.get(token)
        if ids is None:
            ids = self.merge(token.encode("utf-8", "surrogatepass"))
            if len(token) <= LONGEST_KEY:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[token] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        tokens = self.find(text)
        ids = list(map(self.known.get, tokens))
        if None in ids:
            ids = [self.lookup(t) if x is None else x for t, x in zip(tokens, ids, strict=True)]
        return np.frombuffer(b"".join(ids), "<i4")


@cache
def default_encoder(path: str | None = None, pattern: str | None = None, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker and vocabulary; tasks that follow in the worker find what it remembers."""
    import public_tokenizers as P

    encoder = Encoder(read_ranks(path or P.path("byte_bpe_multi_50k.tiktoken")), pattern or P.PATTERN)
    encoder.most = remembered
    return encoder


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None,
           remembered: int = REMEMBERED) -> DataFrame:
    """The columns of ``keep`` (all by default) and ``out``, the ids of the whole text as array<int>. No shuffle.
    A worker remembers the ids of up to ``remembered`` pre-tokens."""
    keep = df.columns if keep is None else keep

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = default_encoder(path, pattern, remembered)
        for b in it:
            ids = [encoder.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(ids)], [*keep, out])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free("__text", keep)))
    return own.mapInArrow(batches, f"{fields}, `{out}` array<int>")


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """The columns of ``df`` and ``out``, the bytes that its ids stand for."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as P

        ranks = read_ranks(path or P.path("byte_bpe_multi_50k.tiktoken"))
        piece = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            piece[v] = k
        for b in it:
            col = b.column(b.schema.get_field_index(ids_col))
            flat, ends = col.flatten().to_numpy(), np.concatenate(([0], np.cumsum(col.value_lengths().fill_null(0).to_numpy())))
            texts = [b"".join(map(piece.__getitem__, flat[s:e].tolist())) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(batches, f"{fields}, `{out}` binary")


def with_digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the other columns but the decoded bytes."""
    return encoded.withColumns({
        "n_tokens": F.size(ids_col).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(decoded_col, 256),
    }).drop(decoded_col)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return with_digests(decode(encode(docs, keep=["doc_id"], path=path), path=path)).drop("ids")
