"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by one probe of a minimal perfect hash over the vocabulary's byte
strings. A miss is merged by a heap of ranked pairs over a doubly linked list of its bytes. What a task has met is remembered
up to a bound, so both tiers see mostly new pre-tokens."""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

from almanac.llm.common import fresh, widen

#: Most pre-tokens and pairs that a task remembers; beyond, it forgets all and begins anew.
REMEMBERED = 300_000


MASK, ODD, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9  # multipliers of well-known 64-bit mixers


class PerfectHash:
    """A minimal perfect hash of n byte strings: hash and displace. Strings fall into n / 3 buckets; by falling size, a bucket
    gets the first displacement that puts all its strings into free slots; buckets of one string name their slot outright."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = hashes % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        slot, shift = np.full(self.n, -1, np.int64), np.zeros(self.buckets, np.int64)
        single = [int(g[0]) for g in groups if len(g) == 1]
        for group in sorted((g for g in groups if len(g) > 1), key=len, reverse=True):
            for start in range(0, 1 << 30, 512):
                tries = np.arange(start, start + 512, dtype=np.uint64)[:, None]
                at = (((hashes[group] ^ (tries * np.uint64(ODD))) * np.uint64(MIX)) >> np.uint64(32)) % np.uint64(self.n)
                apart = np.sort(at, axis=1)
                good = (slot[at.astype(np.int64)] < 0).all(1) & (apart[:, 1:] != apart[:, :-1]).all(1)
                if good.any():
                    first = int(np.argmax(good))
                    slot[at[first].astype(np.int64)] = group
                    shift[int(bucket[group[0]])] = start + first
                    break
        for i, x in zip(single, np.flatnonzero(slot < 0).tolist(), strict=True):
            slot[x], shift[int(bucket[i])] = i, -x - 1
        self.slot, self.shift = slot.tolist(), shift.tolist()
        self.keys = [keys[i] for i in self.slot]

    def __call__(self, key: bytes) -> int:
        """The index of ``key``, or -1."""
        h = xxhash.xxh64_intdigest(key)
        shift = self.shift[h % self.buckets]
        x = -shift - 1 if shift < 0 else ((h ^ (shift * ODD & MASK)) * MIX & MASK) // 4294967296 % self.n
        return self.slot[x] if self.keys[x] == key else -1


class Tokenizer:
    """``vocabulary``: the byte string of each rank, which is its id too. All 256 single bytes must be among them."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary, self.pattern = vocabulary, pattern
        self.find = PerfectHash(vocabulary)
        self.byte = [self.find(bytes([b])) for b in range(256)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "pairs": {}}

    def _rank(self, pair: int) -> int:
        """The rank of what a pair (a * size + b) makes, or -1; remembered."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = divmod(pair, len(self.vocabulary))
        rank = self.pairs[pair] = self.find(self.vocabulary[a] + self.vocabulary[b])
        return rank

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Always the pair of lowest rank, of several the leftmost. The heap holds rank << 32 | place; an entry counts only while
        the pair at its place still has that rank."""
        size, known, rank = len(self.vocabulary), self.pairs.get, self._rank
        byte = self.byte
        ids = [byte[b] for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [r if (r := known(pair)) is not None else rank(pair) for pair in [a * size + b for a, b in zip(ids, ids[1:])]]
        ranks.append(-1)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[j], ranks[i] = r, -1, -1, -1
            if k < n:
                before[k] = i
                pair = r * size + ids[k]
                x = known(pair)
                x = ranks[i] = x if x is not None else rank(pair)
                if x >= 0:
                    heappush(heap, x << 32 | i)
            h = before[i]
            if h >= 0:
                pair = ids[h] * size + r
                x = known(pair)
                x = ranks[h] = x if x is not None else rank(pair)
                if x >= 0:
                    heappush(heap, x << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def token(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.find(raw)
        ids = (whole,) if whole >= 0 else self.merge(raw)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, token = self.known.get, self.token
        return list(chain.from_iterable([known(p) or token(p) for p in _pattern(self.pattern).findall(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_patterns: dict[str, regex.Pattern] = {}


def _pattern(pattern: str) -> regex.Pattern:
    if pattern not in _patterns:
        _patterns[pattern] = regex.compile(pattern)
    return _patterns[pattern]


def load(path: str, pattern: str) -> Tokenizer:
    """A tokenizer from a file of lines "base64 rank", ranks from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return Tokenizer([ranks[i] for i in range(len(ranks))], pattern)


def encode(docs: DataFrame, tokenizer: Tokenizer) -> tuple[DataFrame, str]:
    """``docs`` (text and any others) with a column array<int>, whose name is returned too. Null texts are empty: no ids."""
    shared, name = docs.sparkSession.sparkContext.broadcast(tokenizer), fresh(docs.columns, "ids")

    def factory():
        own = shared.value
        return lambda texts: [own.encode(t) for t in texts]

    return widen(docs, name, "array<int>", factory), name


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids") -> tuple[DataFrame, str]:
    """``df`` with a binary column of the bytes that ``ids`` stands for, whose name is returned too; null ids: none."""
    shared, name = df.sparkSession.sparkContext.broadcast(tokenizer), fresh(df.columns, "decoded")

    def run(batches):
        own = shared.value
        for batch in batches:
            made = pa.array([own.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())])), name


DIGEST = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"


def digest(docs: DataFrame, tokenizer: Tokenizer) -> tuple[DataFrame, str]:
    """``docs`` with a struct column, whose name is returned too: the number of ids, the digest of the ids, and that of the
    bytes that the ids decode to, all from one pass of each text through the encoder and the decoder."""
    shared, name = docs.sparkSession.sparkContext.broadcast(tokenizer), fresh(docs.columns, "tokens")

    def factory():
        own = shared.value
        digits = [b"%d" % i for i in range(len(own.vocabulary))]

        def one(text: str) -> dict:
            ids = own.encode(text)
            return {
                "n_tokens": len(ids),
                "ids_sha256": hashlib.sha256(b",".join(map(digits.__getitem__, ids))).hexdigest(),
                "decoded_sha256": hashlib.sha256(own.decode(ids)).hexdigest(),
            }

        return lambda texts: list(map(one, texts))

    return widen(docs, name, DIGEST, factory), name


def for_session(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> Tokenizer:
    import public_tokenizers

    return load(public_tokenizers.path(name), public_tokenizers.PATTERN)
