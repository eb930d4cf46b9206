import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import piece_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    public = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return piece_counts.load(PATH), lambda texts: [len(x) for x in public.encode(texts, num_threads=1)]


@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\nthein")), max_size=60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text(texts, pair):
    own, public = pair
    assert piece_counts.counts(own, texts) == public(texts)


def test_odd_texts(pair):
    own, public = pair
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "ngng", "é", "漢", "\U0001f600", "▁", "\x00", "<s>", "<0x41>", "</s>", "aaa", "12", "\x85", "​", " " * 17]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k for k in range(80)] + [" " * k + "the" for k in range(40)] + ["x" * 3000, "ab" * 2000, "".join(rng.choices("ingths", k=2500)), "漢" * 3000, "x" * 30_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "a " + "th" * 9000 + "\U0001f600" * 500 + " b", "  " + "in" * 300]
    assert piece_counts.counts(own, texts) == public(texts)


def test_forgetting_changes_nothing(pair, monkeypatch):
    own, public = pair
    monkeypatch.setattr(piece_counts, "REMEMBERED", 3)
    for texts in (["one two three"], ["four five", "one two"], ["one"], []):
        assert piece_counts.counts(own, texts) == (public(texts) if texts else [])


def test_frames(spark, pair):
    own, public = pair
    rows = [(1, "hello world", "c"), (1, "hello world", "c"), (2, None, "d"), (3, "", None), (None, "é " * 5000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, count string")
    table, name = piece_counts.count_tokens(docs, own)
    assert name == "count_"
    for r in table.collect():
        n = public([r.text or ""])[0]
        assert tuple(r[name]) == (len((r.text or "").encode()), n, n > 4096)
    assert piece_counts.count_tokens(docs.limit(0), own)[0].count() == 0
