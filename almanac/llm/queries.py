"""The registered query of each operator: its contract's columns over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import byte_bpe, centroids, chat, divergence, html_text, mixing, piece_counts, quality, simhash, token_files, topk, toxicity, warc
from almanac.llm.common import cut, read
from almanac.llm.oracles import SQL


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, name = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("q"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, name = quality.measured(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return quality.judge(cut(wide.drop("text")), name, read(spark, sf_dir, "labels")).select("doc_id", f"{name}.*").drop("failed_rules")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = byte_bpe.digest(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe.for_session(spark))
    return docs.select("doc_id", f"{name}.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    tagged, name = toxicity.tag(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    offsets = F.array_join(F.transform(f"{name}.spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return tagged.select("doc_id", (toxicity.remainder() == 0).alias("held_out"), f"{name}.score", f"{name}.predicted", offsets.alias("spans"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", "canonical", "outcome", "source_id", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = piece_counts.load(public_tokenizers.path("piece_bpe_32k.model"))
    docs, name = piece_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return docs.select("doc_id", f"{name}.*")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long"), F.lit(i).cast("long"), F.lit(role), F.lit(said)) for i, role in enumerate(("user", "assistant"))])).alias("conv_id", "turn", "role", "text"))
    return chat.digest(chat.format_conversations(turns.unionByName(more)))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "mix.*")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings").select("vec_id", centroids.quantise(F.col("embedding")).alias("q")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = token_files.write(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.documents(spark, folder, manifest)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_html_text,
        op2_bit_sliced_top_k,
        op3_quality_rules,
        op4_byte_bpe,
        op5_toxicity,
        op6_warc_revisits,
        op7_simhash_groups,
        op8_piece_counts,
        op9_chat_format,
        op10_mix,
        op11_centroid_clusters,
        op12_token_files,
        op13_source_divergence,
    )
}
ORACLES = SQL
