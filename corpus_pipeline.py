"""The corpus pipeline: stages over documents, each written as a table and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Quality
rules and the benchmark come from the tables beside the documents.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from jobspan.llm import decontaminate, line_dedup, pieces, quality_rules, shingles, text_stats
from jobspan.llm.checks import labels, piece_model
from jobspan.llm.common import delete_tables, kept_tables, stored
from jobspan.session import scratch_folder, ship

_USED: list[str] = []  # scratch tables of the last stage


def stage(fn):
    """A stage: its scratch tables are deleted when the next one begins, whose documents are its written rows."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        delete_tables(spark, _USED)
        before = set(kept_tables())
        out = fn(spark, docs, sf_dir)
        _USED[:] = [path for path in kept_tables() if path not in before]
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the learned decision list rejects go."""
    stats = stored(text_stats.statistics(docs), "statistics")
    return quality_rules.passing(docs, stats, quality_rules.learn(text_stats.labelled(stats, labels(spark, sf_dir))))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly, go, but for those without a word; every document stays."""
    return line_dedup.without_repeats(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id: texts are linked from a similarity of 0.8
    on, over shingles of five words. Those whose SimHash fingerprints differ in at most four of 64 bits are compared first; near copies
    that fingerprints lose are found by the shingles themselves."""
    return shingles.keep_one(docs, least=0.8, words=5, bits=4)


@stage
def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    return decontaminate.without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text, and what they decode to."""
    return pieces.encode(docs, piece_model())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_copies),
    ("sentencepiece", token_ids),
]

# Learned rules, edit distances, XXH64 fingerprints, alignments and pieces can't be said in SQL; tests/llm compares every stage
# with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each over the rows of the one before, written and read again. Documents without an id can't be named
    in a decision and stay until the last stage; null texts are empty; repeated rows share a fate; other columns pass unread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
