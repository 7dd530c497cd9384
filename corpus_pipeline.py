"""The corpus pipeline: recognised languages, one of each near-duplicate group, no benchmark text, mixed sources, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stopclock.llm import decontaminate, language, mixing, neardup, tokens
from stopclock.llm.shared import output_folder

#: While all sources last, none gets more than about this share of the mixture, unless there are too few sources for it.
SOURCE_CAP = 0.2
ORDER_KEY = 20240229
#: Documents whose sequences are shuffled among one another; more than many blocks of the mixture, fewer than a shard has.
WINDOW = 1 << 13


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: far less likely than all texts a language was learned from, or without a letter."""
    del spark, sf_dir
    return language.known_language(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8, the one with the least id stays."""
    del spark, sf_dir
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark text goes."""
    return decontaminate.without_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mixture; what sources above the cap have beyond it comes last."""
    del spark, sf_dir
    return mixing.in_mixture_order(docs, SOURCE_CAP)


def materialised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; one row per record as read from the files.

    Sequences are shuffled inside windows of the mixture's order, which is that of the files it was written to: the shares of
    the sources hold in the shards.
    """
    del sf_dir
    path = output_folder(spark, "pipeline-tokens")
    return tokens.training_order(docs, path, key=ORDER_KEY, window=WINDOW)


STAGES = [
    ("language", recognise),
    ("near_dedup", deduplicate),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", materialised),
]

#: Segmentation models, suffix automata and schedules have no SQL form; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = output_folder(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
