"""Quality classifier: a sparse ensemble of rules.

Trees are grown by Spark's random forest over text statistics; every path from a root to a node is a conjunctive rule. A
logistic regression with an absolute penalty weighs the rules, which leaves most of them out, and what is left is compiled
into one column expression.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import stored
from jobspan.llm.text_stats import FEATURES

Path = tuple[tuple[int, float, float], ...]  # (feature, above, at most), by feature

_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(description: str) -> list[Path]:
    """The conjunctions of all nodes but the root, from a tree's printed form; bounds of one feature are merged."""
    held: list[tuple[int, int, str, float]] = []
    out = []
    for line in description.splitlines():
        m = _NODE.match(line)
        if not m:
            continue
        depth = len(m[1])
        held = [h for h in held if h[0] < depth] + [(depth, int(m[3]), m[4], float(m[5]))]
        bounds: dict[int, tuple[float, float]] = {}
        for _, f, side, t in held:
            low, high = bounds.get(f, (-math.inf, math.inf))
            bounds[f] = (low, min(high, t)) if side == "<=" else (max(low, t), high)
        out.append(tuple((f, low, high) for f, (low, high) in sorted(bounds.items())))
    return out


def rule_column(path: Path, features: list[str]) -> Column:
    out = F.lit(True)
    for f, low, high in path:
        if low > -math.inf:
            out = out & (F.col(features[f]) > F.lit(low))
        if high < math.inf:
            out = out & (F.col(features[f]) <= F.lit(high))
    return out


@dataclass
class Ensemble:
    features: list[str]
    rules: list[Path]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The chance of label 1 as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for path, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule_column(path, self.features), F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def learn(rows: DataFrame, features: list[str] = FEATURES, trees: int = 20, depth: int = 3, penalty: float = 0.002,
          seed: int = 7) -> Ensemble:
    """From (label 0 or 1, features), all labelled rows. No rows give a score of 0.5, rows of one label alone that label's share,
    smoothed by one row of each."""
    rows = stored(rows.select(F.col("label").cast("double").alias("label"), *features), "ensemble-rows")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    constant = math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return Ensemble(features, [], [], constant)
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed,
                                    subsamplingRate=0.7, featureSubsetStrategy="0.5")
    grown = forest.fit(VectorAssembler(inputCols=features, outputCol="x").transform(rows).select("label", "x"))
    paths = sorted({p for t in grown.trees for p in tree_paths(t.toDebugString)})
    if not paths:
        return Ensemble(features, [], [], constant)
    names = [f"r{k}" for k in range(len(paths))]
    fired = rows.select("label", *[rule_column(p, features).cast("double").alias(c) for p, c in zip(paths, names, strict=True)])
    fired = VectorAssembler(inputCols=names, outputCol="x").transform(fired).select("label", "x")
    lasso = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=penalty, standardization=False,
                               maxIter=100).fit(fired)
    kept = [(p, float(w)) for p, w in zip(paths, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return Ensemble(features, [p for p, _ in kept], [w for _, w in kept], float(lasso.intercept))


def classify(stats: DataFrame, model: Ensemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on). An empty or null text has statistics of zero and is scored
    like any other; repeated rows are scored alike, ids may be null."""
    return (stats.select("doc_id", model.score().alias("score"))
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
