"""Registered queries of the operators, each over its whole tables, and the SQL of those that SQL can express."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspan.llm import (decontaminate, fill_in_middle, importance, language_id, licences, line_dedup, pieces, pseudonyms,
                         quality_rules, rule_ensemble, sharding, simhash, text_stats, token_files)
from jobspan.llm.common import documents, held_out, stored
from jobspan.session import scratch_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op1_rule_ensemble(spark, sf_dir):
    stats = stored(text_stats.statistics(documents(spark, sf_dir)), "statistics")
    outside = held_out(F.col("doc_id"), 5, 0)
    model = rule_ensemble.learn(text_stats.labelled(stats.where(~outside), labels(spark, sf_dir)))
    return rule_ensemble.classify(stats, model).select("doc_id", outside.alias("held_out"), "score", "predicted")


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    outside = held_out(F.col("doc_id"), 3, 1)
    filters = language_id.learn(docs.where(~outside))
    return language_id.predict(docs, filters).select("doc_id", outside.alias("held_out"), "lang_pred", "score")


@query
def op4_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymize(documents(spark, sf_dir), key="corpus key of the checks")


@query
def op5_licences(spark, sf_dir):
    return licences.summary(licences.scan(documents(spark, sf_dir)))


@query
def op6_line_dedup(spark, sf_dir):
    return line_dedup.report(documents(spark, sf_dir))


@query
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op8_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir), shards=40)


@query
def op9_decision_list(spark, sf_dir):
    stats = stored(text_stats.statistics(documents(spark, sf_dir)), "statistics")
    return quality_rules.judge(stats, quality_rules.learn(text_stats.labelled(stats, labels(spark, sf_dir))))


@query
def op10_pieces(spark, sf_dir):
    return pieces.digests(pieces.encode(documents(spark, sf_dir), piece_model()))


@query
def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(fill_in_middle.transform(documents(spark, sf_dir)))


ORACLES["op11_fill_in_middle"] = fill_in_middle.SQL


@query
def op12_importance(spark, sf_dir):
    drawn = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_importance"] = importance.SQL


@query
def op13_token_files(spark, sf_dir):
    import public_tokenizers

    path = scratch_folder(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digests(token_files.read(spark, path))
