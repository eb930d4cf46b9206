import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return byte_bpe.load(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(pair):
    own, _ = pair
    assert sorted(own.find.slot) == list(range(len(own.vocabulary)))
    assert all(own.find(k) == i for i, k in enumerate(own.vocabulary))
    assert own.find(b"surely not a token") == own.find(b"") == -1
    for n in (1, 2, 3, 50):
        keys = [b"%d" % i for i in range(n)]
        assert [byte_bpe.PerfectHash(keys)(k) for k in keys] == list(range(n))


@given(text=st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(text, pair):
    own, public = pair
    ids = own.encode(text)
    assert ids == public.encode_ordinary(text) and own.decode(ids).decode() == text


def test_long_and_odd_texts(pair):
    own, public = pair
    rng = random.Random(1)
    parts = ["\x00", "\x1c", "\x85", "​", "﻿", " ", "  ", "\n", "\t", "ß", "漢字", "\U0001f600", "'s", "'LL", "12345", "...", "<|endoftext|>", "é"]
    texts = ["x" * 60_000, "".join(rng.choices("abcdefgh", k=40_000)), " " * 9000, "é" * 5000] + ["".join(rng.choices(parts, k=50)) for _ in range(200)]
    for t in texts:
        assert own.encode(t) == public.encode_ordinary(t), t[:40]


def test_frames(spark, pair):
    own, public = pair
    rows = [(1, "hello world", "c", 1), (1, "hello world", "c", 1), (2, None, "c", 2), (3, "", None, 3), (None, "ünïcode\n" * 300, "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, ids int")
    coded, ids = byte_bpe.encode(docs, own)
    decoded, out = byte_bpe.decode(coded, own, ids)
    assert (ids, out) == ("ids_", "decoded")
    got = decoded.collect()
    assert len(got) == 5 and all(r[out].decode() == (r.text or "") and r[ids] == public.encode_ordinary(r.text or "") for r in got)
    table, name = byte_bpe.digest(docs, own)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in table.collect():
        want = public.encode_ordinary(r.text or "")
        assert tuple(r[name]) == (len(want), sha(",".join(map(str, want)).encode()), sha((r.text or "").encode()))
    assert byte_bpe.digest(docs.limit(0), own)[0].count() == 0
