"""Quality rules as a learned decision list, in DataFrame expressions throughout.

Sequential covering: a rule, a conjunction of thresholds on text statistics, is grown on two thirds of the labelled rows by the
largest information gain, cut back on the other third to the part with the best worth there, and what it covers is taken out
before the next one is grown. Each step is one aggregate over all labelled rows: counts of both labels per statistic and
threshold. The rules come out as one ordered conditional expression.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import stored
from jobspan.llm.text_stats import FEATURES


@dataclass
class Rule:
    conditions: list[tuple[str, str, float]] = field(default_factory=list)  # (statistic, "<=" or ">", threshold)
    worth: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, side, t in self.conditions:
            out = out & (F.col(name) <= F.lit(t) if side == "<=" else F.col(name) > F.lit(t))
        return out

    def __str__(self):
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.conditions)


def _bins(name: str, thresholds: list[float]) -> Column:
    """How many thresholds lie below the value: the bin that ``value > t`` for the first so many."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(name) > t)) if thresholds else F.lit(0)


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(rows: DataFrame, features: list[str] = FEATURES, thresholds: int = 64, most_conditions: int = 4, most_rules: int = 16,
          least_worth: float = 0.9, least_share: float = 0.0005) -> list[Rule]:
    """Rules that reject, in their order, from (doc_id, label, features): label 0 is to be rejected.

    A rule is taken if, on the pruning rows, at least ``least_worth`` of what it covers has label 0, and it covers at least
    ``least_share`` of all growing rows. No labelled rows, or none of one label, give no rules. Equal gains: the first
    statistic, then the smallest threshold.
    """
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"), (F.col("label") == 0).cast("long").alias("bad"), *features)
    at = [float(k) / thresholds for k in range(1, thresholds)]
    cuts = rows.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in features}
    binned = stored(rows.select("part", "bad", *[_bins(f, cuts[f]).alias(f) for f in features]), "rule-rows")

    def column(rule: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for f, side, k in rule:  # bin k and below: value <= cuts[k]
            out = out & (F.col(f) <= k if side == "<=" else F.col(f) > k)
        return out

    def counts(df: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        """Of both labels per statistic and bin: at most features x thresholds rows."""
        each = F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in features]))
        out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
        for r in df.select("bad", each).groupBy("f", "k").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect():
            out[r.f][r.k] = (r.p, r.n - r.p)
        return out

    rules, covered = [], F.lit(False)
    left = binned
    for _ in range(most_rules):
        grow, prune = left.where("part > 0"), left.where("part = 0")
        rule: list[tuple[str, str, int]] = []
        while len(rule) < most_conditions:
            got = counts(grow.where(column(rule)))
            p0, n0 = map(sum, zip(*got[features[0]].values())) if got[features[0]] else (0, 0)
            if not rule:
                least = max(2.0, least_share * (p0 + n0))
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in features:
                p = n = 0
                for k in range(len(cuts[f])):
                    a, b = got[f].get(k, (0, 0))
                    p, n = p + a, n + b
                    for side, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if x + y >= least and (g := _gain(p0, n0, x, y)) > best[0] + 1e-9:
                            best = (g, (f, side, k))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # The worth of each beginning of the rule on the rows it was not grown on, in one aggregate.
        parts = [rule[:k + 1] for k in range(len(rule))]
        got = prune.agg(*[F.coalesce(F.sum(F.when(column(r), x)), F.lit(0)).alias(f"{name}{k}") for k, r in enumerate(parts)
                          for name, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((got[f"p{k}"] + 1) / (got[f"p{k}"] + got[f"n{k}"] + 2), -k) for k in range(len(parts))]
        value, k = max(worth)
        rule = parts[-k]
        if value < least_worth:
            break
        rules.append(Rule([(f, side, cuts[f][k]) for f, side, k in rule], value))
        covered = covered | column(rule)
        left = binned.where(~covered)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that rejects, else null: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(rule.column(), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def judge(stats: DataFrame, rules: list[Rule], least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """doc_id, the five counts, base_failed (fewer than ``least_words`` words, or over ``most_repeats`` percent of the words in
    repeated windows), kept, and the rule that rejected.

    A null or empty text has no words and fails the base. Repeated rows are judged alike, ids may be null.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rule = verdict(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                        (~base & rule.isNull()).alias("kept"), rule.alias("rule"))


def passing(docs: DataFrame, stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with all their columns. Rows without an id can't be named and stay."""
    gone = judge(stats, rules).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
