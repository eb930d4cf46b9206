import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from almanac.llm import token_files
from almanac.llm.queries import QUERIES
from almanac.llm.wavelet import BLOCK, Shard, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


def made(ids, docs=1):
    ends = np.linspace(0, len(ids), docs + 1).astype(int)[1:]
    return Shard(pack(np.array(ids, np.uint32), list(range(docs)), ends))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=120), st.integers(0, 5))
def test_wavelet_matrix_against_a_list(ids, token):
    s = made(ids)
    assert s.ids().tolist() == ids and [s.access(i) for i in range(len(ids))] == ids
    for t in {token, *ids[:5]}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert [s.rank(t, e) for e in range(len(ids) + 1)] == [sum(p < e for p in places) for e in range(len(ids) + 1)]
        assert [s.select(t, k) for k in range(len(places) + 1)] == [*places, -1]


def test_wavelet_matrix_over_many_blocks():
    ids = np.minimum(np.random.default_rng(4).zipf(1.4, 5 * 8 * BLOCK + 17), 40_000).astype(np.uint16)
    data = pack(ids, [None, 5], np.array([70_000, len(ids)]))
    s = Shard(data)
    assert (s.ids() == ids).all() and s.doc_ids == [None, 5] and s.ends.tolist() == [70_000, len(ids)]
    for t in (1, 2, 77, int(ids.max())):
        places = np.flatnonzero(ids == t)
        assert s.rank(t) == len(places) and s.rank(t, 99_999) == (places < 99_999).sum()
        assert [s.select(t, k) for k in (0, len(places) // 2, len(places) - 1)] == [int(places[k]) for k in (0, len(places) // 2, len(places) - 1)]
    assert [s.access(i) for i in (0, 32_767, 32_768, len(ids) - 1)] == ids[[0, 32_767, 32_768, -1]].tolist()
    assert (s.document(69_999), s.document(70_000)) == (0, 1)
    assert len(data) < 0.75 * ids.nbytes
    with pytest.raises(ValueError):
        Shard(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])
    with pytest.raises(IndexError):
        s.access(len(ids))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBéÉ×%#\"(-_´'́ \t\n\x0b\x0c\x1c\x85\xa0 <|endoftext|>1٣ß中Σς"), max_size=40))
def test_words_apart_give_the_library_s_ids(text):
    public = Tokenizer.from_file(PATH) if not hasattr(test_words_apart_give_the_library_s_ids, "model") else test_words_apart_give_the_library_s_ids.model
    test_words_apart_give_the_library_s_ids.model = public
    with open(PATH, encoding="utf-8") as f:
        encode = test_words_apart_give_the_library_s_ids.__dict__.setdefault("own", token_files.Encoder(f.read()))
    assert np.frombuffer(encode([text.encode()])[0], encode.kind).tolist() == public.encode(text, add_special_tokens=False).ids


class Asked(dict):
    """Ids of words that counts what is asked."""

    def __init__(self, make):
        super().__init__()
        self.make, self.n = make, Counter()

    def __getitem__(self, word):
        self.n[word] += 1
        return self.make(word)


def test_a_batch_asks_for_each_distinct_word_once(public):
    with open(PATH, encoding="utf-8") as f:
        encode = token_files.Encoder(f.read())
    encode.words = Asked(encode.words.__getitem__)
    texts = ["the cat, the dog " * 500, "The CAT,\x0bthe\x1cdog", "", " \t", "  the dog  ", "<|endoftext|> The cat, É e\u0301", "the cat, " * 500]
    got = encode([t.encode() for t in texts])
    assert set(encode.words.n.values()) == {1} and encode.words.n[b"the"] == encode.words.n[b"cat,"] == 1
    assert [np.frombuffer(g, encode.kind).tolist() for g in got] == [public.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_runs_go_to_the_model_alone(public):
    with open(PATH, encoding="utf-8") as f:
        encode = token_files.Encoder(f.read())
    words = [a + b + c for a in "xqzß" for b in map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]) for c in ("", "zq", "ÿjx")]
    assert [np.frombuffer(encode._run(w.encode()), encode.kind).tolist() for w in words] == [public.encode(w, add_special_tokens=False).ids for w in words]
    encode.model = encode.bare = None  # the tokenizers with their steps before the model
    assert all(encode._run(w.encode()) for w in words)


def test_bytes_that_are_no_text_are_replaced_as_before(public):
    with open(PATH, encoding="utf-8") as f:
        encode = token_files.Encoder(f.read())
    texts = [b"\xff\xfe abc", b"a\xc3", b"\xed\xa0\x80 x", b"\x00 a\x00b", b"\xc3\x9f\xc3"]
    assert [np.frombuffer(g, encode.kind).tolist() for g in encode(texts)] == [public.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]


def expected(public, rows):
    """rows: (doc_id, text), as they stand in the files."""
    out, start = [], 0
    for d, t in rows:
        ids = [*public.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_public_library(spark, public):
    rows = sorted((d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist())
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001").collect())) == expected(public, rows)


@pytest.mark.parametrize("apart", [True, False])
def test_files_answer_for_all(spark, public, apart):
    texts = ["the cat and the dog", None, "", "  ", "the " * 3000, "<|endoftext|> it's", "x" * 5000]
    rows = [(i * 3 % 101, texts[i % len(texts)] if i % 4 else f"the {i} cats") for i in range(101)] + [(7, "the cat")] * 3 + [(None, "no id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, ids string, row int, tie int").repartition(5)
    folder, manifest = token_files.write(df, PATH, 2, shard=4000, apart=apart)
    got = sorted(map(tuple, token_files.documents(spark, folder, manifest).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    said = {(d, *expected(public, [(d, t)])[0][2:]): t for d, t in rows}
    ordered = [(d, said[d, n, crc]) for d, _, n, crc in got]
    assert Counter(ordered) == Counter((d, said[(d, *expected(public, [(d, t)])[0][2:])]) for d, t in rows)
    assert got == expected(public, ordered) and manifest.count() > 4
    ids = [x for _, t in ordered for x in [*public.encode(t or "", add_special_tokens=False).ids, 2]]
    the, cat = (public.encode(w, add_special_tokens=False).ids[0] for w in ("the", "cat"))
    assert {r.token: r.n for r in token_files.counts(spark, folder, [the, cat, 2, 49_000, cat]).collect()} == {t: ids.count(t) for t in (the, cat, 2, 49_000)}
    places = token_files.occurrences(spark, folder, manifest, cat).collect()
    assert sorted(r.place for r in places) == [i for i, x in enumerate(ids) if x == cat]
    starts = {(g[0], g[1]) for g in got}
    assert all((r.doc_id, r.place - r["at"]) in starts for r in places)
    n = len(ids)
    assert {r.place: r.token for r in token_files.window(spark, folder, manifest, n - 300, 900).collect()} == {i: ids[i] for i in range(n - 300, n)}


def test_no_documents(spark):
    folder, manifest = token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert manifest.count() == token_files.documents(spark, folder, manifest).count() == token_files.counts(spark, folder, [2]).count() == 0
