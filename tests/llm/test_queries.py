"""The queries of this subpackage against SQL where there is some, and their columns."""

import hashlib
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
import tiktoken.load

from almanac.llm.queries import ORACLES, QUERIES
from tests.compare import duck, duck_rows, spark_rows
from tests.llm.test_simhash import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_text": {"page_id": "bigint", "text": "string"},
    "op6_warc_revisits": {"record_id": "bigint", "outcome": "string", "source_id": "bigint", "headers": "string", "payload_sha256": "string"},
    "op2_bit_sliced_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op3_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_simhash_groups": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_piece_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op11_centroid_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op12_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op13_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op10_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert COLUMNS[name].items() <= dict(QUERIES[name](spark, SF).dtypes).items()


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows_of(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_byte_bpe_against_the_public_library(spark, documents):
    got = rows_of(spark, "op4_byte_bpe")
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    public = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d in documents:
        ids = public.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((d["text"] or "").encode()))
    assert len(got) == len(documents)


def test_piece_counts_against_the_public_library(spark, documents):
    public, got = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), rows_of(spark, "op8_piece_counts")
    want = {d["doc_id"]: (len((d["text"] or "").encode()), n := len(public.encode(d["text"] or "")), n > 4096) for d in documents}
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == want


def test_simhash_groups_against_brute_force(spark, documents):
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op7_simhash_groups"](spark, SF).collect()]
    assert sorted(got, key=str) == brute_groups([(d["doc_id"], brute_fp(d["text"])) for d in documents])


def test_toxicity_on_held_out_rows(spark, documents):
    got = rows_of(spark, "op5_toxicity")
    text = {d["doc_id"]: d["text"] or "" for d in documents}
    assert set(got) == set(text)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        assert all(0 <= a < b <= len(text[k]) for a, b in spans) and spans == sorted(spans)
    labels = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["toxic"] is not None and x["doc_id"] in got}
    held = [k for k in labels if got[k].held_out]
    assert held and sum(got[k].predicted == labels[k] for k in held) >= 0.9 * len(held)


def test_a_query_for_every_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
