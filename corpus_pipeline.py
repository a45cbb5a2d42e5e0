"""A corpus cleaning pipeline over ``documents``: each stage applies one of the
training-data operators to all that the stage before it kept.

All stages but the last return the columns of ``documents``; ``n_chars`` stays
the length of the original text.  Every stage's result is written as Parquet in
the session's shared folder and read again, so a lost executor repeats at most
the stage that runs.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from ragscope.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from ragscope.llm.jobs import read, saved


#: Documents of an Arrow batch.
BATCH_ROWS, _SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, BATCH_ROWS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    _small_batches(spark)
    return quality_rules.keep_good(docs, quality_rules.learn(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are cut, except where they occur first; emptied documents go."""
    _small_batches(spark)
    return line_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    _small_batches(spark)
    return ngram_join.keep_one(docs, n=5, t=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut; documents with no other word go."""
    _small_batches(spark)
    return decontaminate.cut(decontaminate.find(docs, read(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: The rules are learned, and chunk boundaries, greedy windows and tokens come from
#: procedures that SQL cannot state; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
