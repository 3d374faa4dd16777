"""Incremental enrichment: skills and years, embedding input, years backfill.

The answers of the outside model come as tables keyed by posting id, so every pass is joins and projections over the
whole backlog; a row whose text or answer is missing stays pending and is picked up by the next pass.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.functions import answers as A
from jobspan.functions.scores import instant
from jobspan.functions.skills import extract_skills
from jobspan.functions.text import embed_text, extract_years, html_to_text, if_any, section_text, trim_ws
from jobspan.operators.admission import data_tech_title, pending
from jobspan.sources.readers import resolve_descriptions

_STR = "array<string>"


def backlog(postings: DataFrame, target: str, texts: DataFrame | None = None, html: bool = True, **which) -> DataFrame:
    """Pending rows with their plain text (null when it cannot be read or is blank)."""
    rows = pending(postings, target, **which)
    rows = rows.withColumn("text", F.col("description")) if texts is None else resolve_descriptions(rows, texts)
    if html:
        rows = rows.withColumn("text", html_to_text(F.col("text")))
    return rows.withColumn("text", F.when(trim_ws(F.col("text")) != "", F.col("text")))


def _on_topic(titles: list[str] | None):
    return data_tech_title(F.col("title"), titles) if titles else data_tech_title(F.col("title"))


def skill_requests(rows: DataFrame, titles: list[str] | None = None) -> DataFrame:
    """Requests for backlog rows; off-topic titles get none."""
    return rows.where(_on_topic(titles) & F.col("text").isNotNull()).select(
        "id", A.request_text("skills", F.col("text")).alias("request"))


def enrich(rows: DataFrame, responses: DataFrame, now, broad: DataFrame | None = None,
           titles: list[str] | None = None, **skill_options) -> DataFrame:
    """Backlog rows with ``skills``, ``experience_years``, ``enriched_at`` and ``outcome`` (ok, empty, error).

    ``responses`` is (id, raw), unique by id. Off-topic titles become empty without a request. Rows in error keep null
    skills and so stay pending.
    """
    given = rows.select("id", "company_name", "text", _on_topic(titles).alias("on_topic")).join(
        responses.select("id", "raw"), "id", "left")
    given = given.withColumn("__a", A.skills_answer(F.col("raw")))
    given = given.withColumn("stated", F.col("__a.skills"))
    if broad is not None:
        extra = broad.select("id", A.skills_answer(F.col("raw"))["skills"].alias("broad"))
        given = given.join(extra, "id", "left")
    found = extract_skills(given, "text", "company_name", "stated", "broad" if broad is not None else None,
                           out="found", **skill_options)
    good = F.col("text").isNotNull() & F.coalesce(F.col("__a.ok"), F.lit(False))
    skills = F.when(~F.col("on_topic"), F.array().cast(_STR)).when(good, F.col("found"))
    years = F.when(F.col("on_topic") & good, F.coalesce(F.col("__a.years"), extract_years(F.col("text"))))
    return found.select(
        "id", skills.alias("skills"), years.alias("experience_years"),
        F.when(skills.isNotNull(), instant(now)).alias("enriched_at"),
    ).withColumn("outcome", F.when(F.col("skills").isNull(), "error").when(F.size("skills") > 0, "ok").otherwise("empty"))


def embed_inputs(postings: DataFrame, texts: DataFrame | None = None, max_chars: int | None = None, sections: dict = {},
                 **which) -> DataFrame:
    """(id, embed_text) of the postings that wait for a vector; blank ones are left out."""
    rows = backlog(postings, "embedding", texts, html=False, **which)
    parsed = section_text(F.col("text"), **sections)
    return rows.where(F.col("text").isNotNull()).select(
        "id", if_any(embed_text(F.col("title"), parsed, max_chars)).alias("embed_text"))


def backfill_years(rows: DataFrame, responses: DataFrame | None = None, **patterns) -> DataFrame:
    """Backlog rows with ``experience_years`` and ``outcome``: rule, then answer, else null; skip without text."""
    if responses is None:
        given = rows.select("id", "text").withColumn("raw", F.lit(None).cast("string"))
    else:
        given = rows.select("id", "text").join(responses.select("id", "raw"), "id", "left")
    years, origin = A.two_tier(extract_years(F.col("text"), **patterns), A.years_answer(F.col("raw")))
    readable = F.col("text").isNotNull()
    return given.select(
        "id", F.when(readable, years).alias("experience_years"),
        F.when(~readable, "skip").otherwise(
            F.when(origin == "rule", "regex").when(origin == "model", "llm").otherwise("null")).alias("outcome"),
    )
