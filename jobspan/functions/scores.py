"""Ranking scores of a posting for a search. ``now`` is always given, never read from the clock."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions.text import let

_STR = "array<string>"


def instant(now) -> Column:
    """A timestamp column from a column, a datetime or text."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def hours_since(posted: Column, now) -> Column:
    """Whole hours: seconds rounded to whole ones, then integer division."""
    diff = F.bround(_seconds(instant(now)) - _seconds(posted)).cast("long")
    return (diff / 3600).cast("int")


def epoch_hours(ts) -> Column:
    """Hours since the epoch, rounded."""
    return F.bround(_seconds(instant(ts)) / 3600).cast("int")


def recency_score(hours: Column, half_life: float = vocab.RECENCY_HALF_LIFE_HOURS) -> Column:
    return F.coalesce(F.exp(hours * (-math.log(2)) / half_life), F.lit(vocab.RECENCY_UNKNOWN))


def experience_score(years: Column, min_years) -> Column:
    """Fit of the stated years to the wanted minimum; ``min_years`` is a number, a column or None."""
    if min_years is None:
        return F.lit(1.0)
    want = min_years if isinstance(min_years, Column) else F.lit(min_years)
    return (
        F.when(want.isNull(), 1.0).when(years.isNull(), vocab.EXPERIENCE_UNKNOWN).when(years >= want, 1.0)
        .otherwise(F.round(years / want, 4))
    )


def _as_array(skills) -> Column | None:
    if skills is None or isinstance(skills, Column):
        return skills
    return F.array(*[F.lit(s) for s in skills]) if skills else None


def _matched(job_skills: Column, wanted: Column) -> Column:
    lowered = F.transform(F.coalesce(job_skills, F.array().cast(_STR)), F.lower)
    return let(lowered, lambda have: F.size(F.filter(wanted, lambda s: F.array_contains(have, F.lower(s)))))


def manual_skill_score(job_skills: Column, wanted) -> Column:
    """Share of the wanted skills the posting names; 1 when none are wanted."""
    wanted = _as_array(wanted)
    if wanted is None:
        return F.lit(1.0)
    return F.when(F.size(wanted) > 0, _matched(job_skills, wanted) / F.size(wanted)).otherwise(1.0)


def resume_skill_score(job_skills: Column, owned, share: float = vocab.RESUME_SKILL_SHARE) -> Column:
    """Covered skills over a share of what the posting asks, at most 1; 0 for a posting without skills."""
    owned = _as_array(owned)
    if owned is None:
        return F.lit(1.0)
    asked = F.coalesce(F.size(job_skills), F.lit(0))
    need = F.greatest(F.ceil(asked * F.lit(share)), F.lit(1))
    score = F.when(asked <= 0, 0.0).otherwise(F.least(_matched(job_skills, owned) / need, F.lit(1.0)))
    return F.when(F.size(owned) > 0, score).otherwise(1.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({vocab.TOKEN_PATTERN})"), F.lit(1))
    )


def query_tokens(query: Column, stopwords: list[str] = vocab.QUERY_STOPWORDS) -> Column:
    return F.array_except(tokens(query), F.array(*[F.lit(w) for w in stopwords]))


def overlap_score(wanted: Column, job_skills: Column, title: Column) -> Column:
    """Share of the query's tokens found among the skills and the title words; 0 for a query without tokens."""
    have = F.array_union(F.transform(F.coalesce(job_skills, F.array().cast(_STR)), F.lower), tokens(title))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, have)) / F.size(wanted)).otherwise(0.0)


def lexical_score(wanted: Column, title: Column, company: Column) -> Column:
    """Our own text rank: half the share of the query's tokens present in title and company, doubled, at most 1."""
    words = tokens(F.concat_ws(" ", title, company))
    share = F.size(F.array_intersect(wanted, words)) / F.size(wanted)
    return F.when(F.size(wanted) > 0, F.least(share * 0.5 * 2.0, F.lit(1.0))).otherwise(0.0)


def weights(has_skills: bool, has_years: bool) -> tuple[float, ...]:
    key = (("skills",) if has_skills else ()) + (("years",) if has_years else ())
    return vocab.WEIGHTS[key]


def weighted(parts: list[Column], weights: list[Column | float]) -> Column:
    """Sum of the parts times their weights."""
    total = F.lit(0.0)
    for part, weight in zip(parts, weights):
        total = total + part * (weight if isinstance(weight, Column) else F.lit(float(weight)))
    return total


def match_percent(score: Column) -> Column:
    return F.greatest(F.least(F.round(score * 100), F.lit(100.0)), F.lit(0.0)).cast("int")


def match_band(percent: Column) -> Column:
    return F.when(percent >= 85, "excellent").when(percent >= 70, "good").when(percent >= 50, "fair").otherwise("weak")


def posted_label(hours: Column) -> Column:
    days = F.floor(hours / 24)
    return (
        F.when(hours.isNull(), "Recently posted").when(hours < 1, "Just posted")
        .when(hours < 24, F.format_string("Posted %dh ago", hours))
        .when(days == 1, "Posted 1 day ago").when(days < 30, F.format_string("Posted %d days ago", days))
        .otherwise("Posted 30+ days ago")
    )
