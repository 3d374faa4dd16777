"""Questions about the market, answered from aggregates.

Classified questions are a small list of parameters (one dict per question); the data stays in DataFrames.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.operators import insights as I

OFF_TOPIC = "off_topic"


@dataclass
class Question:
    category: str
    role: str = ""
    skills_known: tuple[str, ...] = ()


def normal_role(role: str | None) -> str:
    """Role in lower case without one trailing generic word (the parameter form of ``normalize_role``)."""
    return re.sub(vocab.ROLE_ENDING_PATTERN, "", (role or "").strip().lower()).strip()


def answer_data(postings: DataFrame, q: Question) -> DataFrame | None:
    """The aggregate behind a question, or None when it is off topic or lacks the role it needs."""
    role = normal_role(q.role)
    if q.category == "top_skills":
        return I.popular_skills(postings, 30)
    if q.category == "top_companies":
        return I.top_companies(postings, 25, role or None)
    if not role:
        return None
    if q.category == "skills_for_role":
        return I.popular_skills(postings, 25, role)
    if q.category == "role_overview":
        return I.role_overview(postings, role)
    if q.category == "skill_gap":
        return I.skill_gap(postings, role, list(q.skills_known))
    return None


def answer_context(postings: DataFrame, q: Question) -> DataFrame | None:
    """One row for the answering model: the data as JSON lines in order, the number of postings, and whether there is
    anything to ground an answer on. The data is a ranked report of at most 30 rows."""
    data = answer_data(postings, q)
    if data is None:
        return None
    line = F.to_json(F.struct(*data.columns))
    if q.category == "role_overview":
        grounded = data.select(
            ((F.size("top_skills") > 0) | (F.size("top_companies") > 0) | (F.col("matching_jobs") > 0)).alias("g"),
            line.alias("data"))
        out = grounded.select(F.col("g").alias("grounded"), "data")
    else:
        # Rows of a report come in its order: counts downwards, then names; the sides of a gap by their places.
        order = ["side", "place"] if "place" in data.columns else [-F.col("cnt"), data.columns[0]]
        lines = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") if isinstance(c, str) else c.alias(f"o{k}")
                                                       for k, c in enumerate(order)], line.alias("line"))))
        out = data.agg((F.count("*") > 0).alias("grounded"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("data"))
    return out.withColumn("n_jobs", postings.select(F.count("*").alias("n")).scalar())
