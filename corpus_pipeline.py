"""The corpus pipeline: documents in, token ids of the mixed corpus out.

Each stage works on the rows that the stage before it kept, written as Parquet in the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm.bpe import default_tokenizer, encode_texts
from inkfold.llm.common import prepare, table
from inkfold.llm.mixing import mix_sources, take_copies
from inkfold.llm.near_dedup import keep_one
from inkfold.llm.secret_scan import mask_secrets
from inkfold.llm.toxicity import drop_toxic, fit_toxicity
from inkfold.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones that are not held out, does not call toxic."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the scan reports masked."""
    prepare(spark)
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepare(spark)
    return take_copies(docs, mix_sources(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, with their count and digests."""
    prepare(spark)
    return encode_texts(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("bpe", bpe),
]

# Training, sketches and the tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
