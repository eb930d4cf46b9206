import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from almanac.llm import byte_bpe, simhash, toxicity
from almanac.llm.queries import QUERIES
from tests.llm.test_mixing import brute_mix
from tests.llm.test_simhash import brute_fp, brute_groups
from tests.llm.test_simhash_texts import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of each stage, written and read as the pipeline does."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "source_mixing", "byte_bpe_encoding"]
    assert all(df.columns == stages[0].columns and df.count() for df in stages[:-1])


def test_quality_against_brute_force(spark, stages):
    """The kept rows are those that op3's verdict keeps, over the same documents."""
    verdict = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    before, after = stages[0].collect(), stages[1].collect()
    assert Counter(map(str, after)) == Counter(str(r) for r in before if verdict[r.doc_id])
    assert 0 < len(after) < len(before)
    assert all(len((r.text or "").encode().split()) >= 50 for r in after)


def test_near_dedup_against_brute_force(stages):
    """Five-word shingles and a similarity of 0.8 or more, by every pair of texts."""
    before, after = stages[2].collect(), stages[3].collect()
    assert Counter(r.doc_id for r in after) == brute_kept([(r.doc_id, r.text) for r in before])
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)


def test_near_dedup_by_fingerprints_against_brute_force(stages):
    """The groups of op7, which the operator keeps one row of if asked to."""
    before, after = stages[2].collect(), simhash.near_dedup(stages[2]).collect()
    least = {c for _, _, c in brute_groups([(r.doc_id, brute_fp(r.text)) for r in before])}
    assert Counter(r.doc_id for r in after) == Counter(least)
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)


def test_toxicity_is_the_models_verdict(spark, stages):
    docs, labels = stages[1], spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    own = toxicity.Scorer(toxicity.learn(docs, labels))
    kept = {d for d, t in rows.items() if own.score([t])[0][0] < 0.5}
    assert {r.doc_id for r in stages[2].collect()} == kept
    assert any(zlib.crc32(str(d).encode()) % 5 == 0 for d in kept)


def test_mixture_against_brute_force(stages):
    want = {d: n for d, _, _, n in brute_mix([(r.doc_id, r.text, r.source) for r in stages[3].collect()]) if n}
    got = defaultdict(int)
    for r in stages[4].collect():
        got[str(r.doc_id)] += len(r.text.encode().split())
    assert got == want


def test_encoding_round_trip(spark, stages):
    own = byte_bpe.for_session(spark)
    texts = Counter((r.doc_id, r.text) for r in stages[4].collect())
    assert Counter((r.doc_id, own.decode(r.ids).decode()) for r in stages[5].collect()) == texts


def test_run_is_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    key = lambda df: Counter((r.doc_id, r.n_tokens) for r in df.collect())
    assert out.columns == stages[-1].columns and key(out) == key(stages[-1])


@pytest.mark.parametrize("rows", [0, 1, 90])
def test_run_over_null_and_repeated_rows_and_clashing_columns(spark, tmp_path, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(rows).collect()
    made = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs] + [x for r in docs[:1] for x in ((None, r.text, None, None, None), (r.doc_id, r.text, r.lang, r.source, 5), (r.doc_id, None, "en", "s", 0), (None, None, None, None, None), (-1, "", "", "", 0), (-2, " \n", "en", "s", 2))]
    clash = "ids long, n_tokens string, row int, spot int, signature string, tokens int, mix string, size int, node int"
    table = spark.createDataFrame([(*m, 1, "x", 2, 3, "y", 4, "z", 5, 6) for m in made], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    table.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("true" if rows > 1 else "false").write.parquet(f"{tmp_path}/labels.parquet")
    own = byte_bpe.for_session(spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {(m[0], (m[1] or "")[:40]) for m in made}
    assert all((r.doc_id, own.decode(r.ids).decode()[:40]) in known and r.n_tokens == len(r.ids) for r in got)
    assert len({(r.doc_id, own.decode(r.ids)) for r in got if r.doc_id is None}) <= 1 and (bool(got) or rows < 2)
