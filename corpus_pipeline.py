"""A training corpus in five stages, each over all that the stage before kept.

run(spark, sf_dir) applies STAGES to the documents table; every stage's rows are written as Parquet in the
shared folder and read again by the next one. Stages keep all columns, whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import decontaminate, mixing, neardup, quality, sharding
from cohortlake.llm.shared import Tables, read

WEIGHTS = [5.0, 2.0, 1.0]
SHARDS = 8
#: Words of a benchmark window.
WINDOW = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A null or empty text fails the base rules; null languages and sources are values of their own; a row that
    repeats is judged alike and stays as often; very long texts are judged whole."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id (nulls last), then the least text: shingles of five words, similarity
    0.8 or more. Texts without words are alike to none and stay; rows that repeat are copies of each other."""
    return neardup.keep_first(docs, shingle=5, num=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Texts without words stay, as all do where the benchmark is empty."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), WINDOW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, 0 to 3 times. A null source is a source of its own; documents without words stay once;
    rows that agree in doc_id and text come equally often."""
    return mixing.mixed_rows(docs, WEIGHTS, key=["doc_id", "text"])


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, which replace columns of these names; null ids come first in the order that is permuted."""
    return sharding.shard(docs, SHARDS, ["doc_id"])


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_sources),
    ("sharding", shard_rows),
]

#: Similarity, suffix arrays and robust estimates are not expressible; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.put(stage(spark, docs, sf_dir), f"stage-{k}")
        tables.keep(f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
