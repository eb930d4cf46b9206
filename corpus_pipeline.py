"""The corpus pipeline: five stages over ``documents``, each of which calls an operator of ``almanac.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import byte_bpe, mixing, quality, simhash_texts, toxicity
from almanac.llm.common import read
from almanac.session import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs, read(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model fitted on labelled documents of this stage's input."""
    return toxicity.toxicity_filter(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id: five-word shingles, a similarity of 0.8 or more."""
    return simhash_texts.dedup_texts(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a row for each epoch of a document that is taken."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and their number."""
    coded, ids = byte_bpe.encode(docs.select("doc_id", "source", "text"), byte_bpe.for_session(spark))
    return coded.select("doc_id", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe_encoding", encoding),
]

#: The toxicity stage is a fitted model, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared checkpoint folder and read again. The result is read
    from there too, so the folder is left to its owner, like checkpoints."""
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
