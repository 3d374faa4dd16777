"""Aggregates over postings. All combine before the shuffle; rankings break ties by name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions.names import ilike_any


def for_role(postings: DataFrame, role: str | None) -> DataFrame:
    return postings.where(ilike_any(F.col("title"), [role])) if role else postings


def _top(df: DataFrame, key: str, n: int | None) -> DataFrame:
    out = df.groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), key)
    return out.limit(n) if n else out


def popular_skills(postings: DataFrame, n: int | None = 100, role: str | None = None) -> DataFrame:
    """Most named skills (skill, cnt), for one role when given. Postings without skills do not count."""
    return _top(for_role(postings, role).select(F.explode("skills").alias("skill")), "skill", n)


def top_companies(postings: DataFrame, n: int | None = 25, role: str | None = None) -> DataFrame:
    named = for_role(postings, role).where(F.col("company_name").isNotNull())
    return _top(named.select(F.col("company_name").alias("company")), "company", n)


def average_years(postings: DataFrame, role: str | None = None) -> DataFrame:
    """Average stated years (0 when none) and how many postings state them."""
    return for_role(postings, role).agg(
        F.round(F.coalesce(F.avg("experience_years"), F.lit(0.0)), 1).alias("avg_experience_years"),
        F.count("experience_years").alias("matching_jobs"),
    )


def role_overview(postings: DataFrame, role: str, skills: int = 15, companies: int = 10) -> DataFrame:
    """One record: ranked skills, ranked companies, average years, number of postings with years."""
    rows = for_role(postings, role)
    # One scan: each posting gives its skills, its company and one row for its years.
    part = lambda kind, name, years: F.struct(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), years.cast("double").alias("years"))
    none = F.lit(None)
    each = F.concat(
        F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: part("skill", s, none)),
        F.array(part("company", F.col("company_name"), none), part("years", none, F.col("experience_years"))))
    counts = rows.select(F.inline(each)).where("kind <> 'company' or name is not null").groupBy("kind", "name").agg(
        F.count("*").alias("cnt"), F.count("years").alias("stated"), F.sum("years").alias("total"))
    w = Window.partitionBy("kind").orderBy(F.desc("cnt"), "name")
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(skills, companies))

    def listed(kind: str, most: int) -> Column:
        own = F.when((F.col("kind") == kind) & (F.col("place") <= most), F.struct("place", "name", "cnt"))
        return F.transform(F.array_sort(F.collect_list(own)), lambda r: F.struct(r["name"].alias(kind), r["cnt"].alias("count")))

    years = F.col("kind") == "years"
    average = F.sum(F.when(years, F.col("total"))) / F.nullif(F.sum(F.when(years, F.col("stated"))), F.lit(0))
    return top.agg(
        listed("skill", skills).alias("top_skills"), listed("company", companies).alias("top_companies"),
        F.round(F.coalesce(average, F.lit(0.0)), 1).alias("avg_experience_years"),
        F.coalesce(F.sum(F.when(years, F.col("stated"))), F.lit(0)).alias("matching_jobs"),
    ).select(F.lit(role).alias("role"), "top_skills", "top_companies", "avg_experience_years", "matching_jobs")


def roles_of(title: Column, patterns: dict[str, list[str]] = vocab.ROLE_PATTERNS) -> Column:
    """Every role one of whose phrases the title contains. An expression, so no join of patterns and titles."""
    return F.array_compact(F.array(*[F.when(ilike_any(title, p), F.lit(role)) for role, p in patterns.items()]))


def role_matches(postings: DataFrame, patterns: dict[str, list[str]] = vocab.ROLE_PATTERNS) -> DataFrame:
    """One row per posting and role."""
    return postings.withColumn("role", F.explode(roles_of(F.col("title"), patterns)))


def role_samples(postings: DataFrame, patterns: dict[str, list[str]] = vocab.ROLE_PATTERNS, n: int = 5) -> DataFrame:
    """First n described postings of each role. The rank filter keeps n per role and task before the shuffle."""
    rows = role_matches(postings.where(F.col("description").isNotNull()), patterns)
    w = Window.partitionBy("role").orderBy("id")
    return rows.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= n)


def role_requests(samples: DataFrame, chars: int | None = None) -> DataFrame:
    """One text per role from its few sample postings, in sample order, for a request (see ``answers.request_text``); ``chars``
    cuts each description."""
    text = F.substring("description", 1, chars) if chars else F.col("description")
    one = F.concat(F.lit("Title: "), "title", F.lit("\nCompany: "), F.coalesce("company_name", F.lit("")),
                   F.lit("\n\nDescription:\n"), text)
    ordered = F.array_sort(F.collect_list(F.struct("sample", one.alias("text"))))
    return samples.groupBy("role").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n---\n\n").alias("postings"))


def roles_overview(postings: DataFrame, patterns: dict[str, list[str]] = vocab.ROLE_PATTERNS, skills: int = 15,
                   companies: int = 10) -> DataFrame:
    """Overview of all roles in long form: (role, kind, name, cnt, place)."""
    # One scan: skills and the company of a posting in one array; the limits are literals, so each task keeps the first few.
    kinds = F.concat(
        F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.struct(F.lit("skill").alias("kind"), s.alias("name"))),
        F.when(F.col("company_name").isNotNull(), F.array(F.struct(F.lit("company").alias("kind"), F.col("company_name").alias("name"))))
        .otherwise(F.array().cast("array<struct<kind:string,name:string>>")))
    rows = role_matches(postings.select("title", "skills", "company_name"), patterns)
    counts = rows.select("role", F.inline(kinds)).groupBy("role", "kind", "name").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("role", "kind").orderBy(F.desc("cnt"), "name")
    ranked = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(skills, companies))
    return ranked.where(F.col("place") <= F.when(F.col("kind") == "skill", skills).otherwise(companies))


def skill_gap(postings: DataFrame, role: str, known: list[str], depth: int = 20, n: int = 10) -> DataFrame:
    """A role's top skills, split by whether they are known (ignoring case): first n of either side."""
    top = popular_skills(postings, depth, role)
    have = F.lower("skill").isin([s.lower() for s in known]) if known else F.lit(False)
    side = F.when(have, "you_have").otherwise("consider_learning")
    w = Window.partitionBy("side").orderBy(F.desc("cnt"), "skill")
    return (
        top.withColumn("side", side).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
        .select("side", "place", "skill", "cnt")
    )


def totals(postings: DataFrame) -> DataFrame:
    return postings.agg(
        F.count("*").alias("postings"), F.count_if(F.coalesce("description", F.lit("")) != "").alias("described")
    )


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return df.groupBy(outcome).agg(F.count("*").alias("cnt"))


def distinct_names(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct non-empty names in order."""
    out = df.select(column).where(F.col(column) != "").distinct().orderBy(column)
    return out.limit(limit) if limit else out


def repeatable_sample(df: DataFrame, n: int, seed: int = 0, row_id: str = "id") -> DataFrame:
    """n rows in an order that looks random but is the same every time: by the MD5 of id and seed."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed)))), row_id).limit(n)
