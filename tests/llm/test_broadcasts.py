"""Tables that grow with the documents are not broadcast for their size as Spark guesses it before an explode."""
import re

from pyspark.sql import functions as F

from jobspan.llm import line_dedup, shingles, simhash


def test_lists_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans, stored = {}, simhash.stored

    def seen(df, purpose):
        plans[f"{purpose}-{len(plans)}"] = df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, purpose)

    monkeypatch.setattr(simhash, "stored", seen)
    fps = spark.range(400).select(F.xxhash64("id").alias("fp"))
    near = fps.unionByName(fps.where("fp % 3 = 0").select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp")))
    found = {(r.a, r.b) for r in simhash.linked(near.distinct(), 4).collect()}
    assert found == {tuple(sorted((r.fp, r.fp ^ 5))) for r in fps.where("fp % 3 = 0").collect()}
    lists = [p for name, p in plans.items() if name.startswith("simhash-lists")]
    assert len(lists) == 2 and not any("BroadcastHashJoin" in p for p in lists)


def test_lists_of_keys_are_not_broadcast(spark, monkeypatch):
    plans = []
    for module in (shingles, line_dedup):
        def seen(df, purpose, stored=module.stored):
            if purpose in ("line-pairs", "shingle-pairs"):
                plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return stored(df, purpose)

        monkeypatch.setattr(module, "stored", seen)
    docs = spark.createDataFrame([(k, f"one line of some words {k}\nanother line of text, number {k}") for k in range(40)], "doc_id long, text string")
    line_dedup.without_repeats(docs).count()
    line_dedup.report(docs).count()
    shingles.keep_one(docs, bits=4).count()
    pairs = re.compile(r"(\w+Join) \[key#[^\n]*a_h1#")
    met = [kind for plan in plans for kind in pairs.findall(plan)]
    assert len(met) >= 3 and {*met} == {"SortMergeJoin"}
