"""Scores of the rule ensemble and verdicts of the decision list against plain Python over the same statistics."""
import math

import pytest
from pyspark.sql import functions as F

from jobspan.llm import checks, quality_rules, rule_ensemble, text_stats
from jobspan.llm.common import held_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stats(spark):
    out = text_stats.statistics(checks.documents(spark, SF)).cache()
    yield out
    out.unpersist()


def test_scores_equal_the_rules(spark, stats):
    outside = held_out(F.col("doc_id"), 5, 0)
    model = rule_ensemble.learn(text_stats.labelled(stats.where(~outside), checks.labels(spark, SF)))
    assert model.rules and len(model.rules) == len(model.weights)
    rows = {r.doc_id: r.asDict() for r in stats.collect()}

    def plain(row):
        total = model.intercept
        for path, w in zip(model.rules, model.weights, strict=True):
            if all(low < row[model.features[f]] <= high for f, low, high in path):
                total += w
        return 1 / (1 + math.exp(-total))

    got = {r.doc_id: r for r in checks.QUERIES["op1_rule_ensemble"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    for i, row in rows.items():
        assert abs(got[i].score - plain(row)) < 1e-9 and got[i].predicted == (plain(row) >= 0.3)


def test_verdicts_equal_the_list(spark, stats):
    rules = quality_rules.learn(text_stats.labelled(stats, checks.labels(spark, SF)), least_worth=0.5, least_share=0.0)
    assert rules
    got = {r.doc_id: (r.kept, r.rule) for r in quality_rules.judge(stats, rules).collect()}
    for r in stats.collect():
        row = r.asDict()
        hit = next((k for k, rule in enumerate(rules, 1) if all(
            row[n] <= t if side == "<=" else row[n] > t for n, side, t in rule.conditions)), None)
        failed = row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"]
        assert got[r.doc_id] == (not failed and hit is None, hit)
