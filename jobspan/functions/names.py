"""Company names, board slugs, career-site URLs, cohorts and roles."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions.text import collapse_ws, contains_any, trim_ws


def _suffixes(words: list[str], dot: bool) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b" + (r"\.?" if dot else "")


def clean_company(name: Column, suffixes: list[str] = vocab.CORPORATE_SUFFIXES) -> Column:
    """Lower case, "&" spelled out, corporate suffixes and punctuation dropped."""
    low = F.replace(F.lower(trim_ws(name)), F.lit("&"), F.lit(" and "))
    return F.trim(
        collapse_ws(F.regexp_replace(F.regexp_replace(low, _suffixes(suffixes, True), " "), "[^a-z0-9 -]", " "))
    )


def slug_variants(name: Column, suffixes: list[str] = vocab.CORPORATE_SUFFIXES) -> Column:
    """Plausible board slugs of a company, distinct, most likely first."""
    base = F.coalesce(F.nullif(clean_company(name, suffixes), F.lit("")), F.lower(trim_ws(name)))
    words = F.split(base, " ", -1)
    two = F.when(F.size(words) >= 2, F.slice(words, 1, 2))

    def swap(a: str, b: str) -> Column:
        return F.replace(base, F.lit(a), F.lit(b))

    forms = F.array(
        base, swap(" ", ""), swap(" ", "-"), swap("-", ""), swap("_", "-"), F.get(words, F.lit(0)),
        F.concat(base, F.lit("inc")), F.concat(base, F.lit("-inc")), F.array_join(two, ""), F.array_join(two, "-"),
    )
    return F.array_distinct(F.filter(forms, lambda v: F.length(v) >= 2))


def slug_candidates(name: Column, suffixes: list[str] = vocab.SHORT_SUFFIXES) -> Column:
    """First word, words joined, words hyphenated; empty when nothing is left of the name."""
    bare = F.lower(F.regexp_replace(name, _suffixes(suffixes, False), ""))
    words = F.filter(F.split(F.regexp_replace(bare, r"[^a-z0-9\s]", ""), r"\s+", -1), lambda w: w != "")
    return F.when(
        F.size(words) > 0,
        F.array_distinct(F.array(F.get(words, F.lit(0)), F.array_join(words, ""), F.array_join(words, "-"))),
    ).otherwise(F.array().cast("array<string>"))


def career_site(path: Column, skip: list[str] = vocab.CAREER_SKIP_PATHS) -> Column:
    """First path segment that names a career site, after an optional locale."""
    parts = F.split(F.regexp_replace(path, "(?i)^/[a-z]{2}[-_][a-z]{2}/", "/"), "/", -1)
    return F.get(F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(skip)), F.lit(0))


def career_site_fallbacks(slug: Column, fixed: list[str] = vocab.CAREER_FALLBACKS) -> Column:
    """Names to try when no career site is known: the usual ones, then the slug capitalised and as it is."""
    capital = F.concat(F.upper(F.substring(slug, 1, 1)), F.lower(F.substring(slug, F.lit(2), F.length(slug))))
    return F.array_distinct(F.array(*[F.lit(v) for v in fixed], capital, slug))


def board_from_url(url: Column, pattern: str = vocab.BOARD_URL_PATTERN,
                   skip: list[str] = vocab.BOARD_SKIP_PATHS) -> Column:
    """struct(tenant, wd_num, career_site) of a board URL, or null."""
    site = F.regexp_extract(url, pattern, 3)
    return F.when(
        (site != "") & ~F.lower(site).isin(skip),
        F.struct(
            F.lower(F.regexp_extract(url, pattern, 1)).alias("tenant"),
            F.regexp_extract(url, pattern, 2).cast("int").alias("wd_num"),
            site.alias("career_site"),
        ),
    )


def board_url(tenant: Column, wd_num: Column, career_site: Column) -> Column:
    return F.concat(F.lit("https://"), tenant, F.lit(".wd"), wd_num.cast("string"),
                    F.lit(".myworkdayjobs.com/en-US/"), career_site)


def cohort_key(cohort: Column, seasons: dict[str, int] = vocab.SEASON_ORDER) -> Column:
    """Sortable struct(year, season) of "Winter 2024"; (0, 0) when it does not read that way."""
    parts = F.filter(F.split(cohort, r"\s+"), lambda p: p != "")
    year = F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("int"))
    season = F.lit(0)
    for name, order in seasons.items():
        season = F.when(F.get(parts, F.lit(0)) == name, order).otherwise(season)
    return F.struct(
        F.coalesce(year, F.lit(0)).alias("year"), F.when(year.isNotNull(), season).otherwise(0).alias("season")
    )


def display_name(slug: Column) -> Column:
    """Words of a slug, each with a capital."""
    runs = F.regexp_extract_all(F.replace(slug, F.lit("-"), F.lit(" ")), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalize_role(role: Column) -> Column:
    """Lower case without one trailing generic word."""
    return trim_ws(F.regexp_replace(F.lower(trim_ws(role)), vocab.ROLE_ENDING_PATTERN, ""))


def guess_company(text: Column, patterns: list[str] = vocab.COMPANY_GUESS_PATTERNS, head: int | None = None) -> Column:
    """Company named in a description, or in its first ``head`` characters: the first pattern whose match has a sensible length."""
    start = F.substring(text, 1, head) if head else text
    names = [trim_ws(F.regexp_extract(start, p, 1)) for p in patterns]
    return F.coalesce(*[F.when((F.length(n) > 2) & (F.length(n) < 50), n) for n in names])


def canonical_link(href: Column, base: str, html: Column | None = None) -> Column:
    """Link without its query, absolute; else built from a numeric job id in the HTML."""
    path = F.split_part(href, F.lit("?"), F.lit(1))
    link = F.when(path.contains("/jobs/"), F.when(path.startswith("/"), F.concat(F.lit(base), path)).otherwise(path))
    if html is None:
        return link
    job_id = F.nullif(F.regexp_extract(html, r"/jobs/view/(\d+)", 1), F.lit(""))
    return F.coalesce(link, F.concat(F.lit(base + "/jobs/view/"), job_id))


def job_key_link(job_key: Column, href: Column, base: str) -> Column:
    """Link from a job key, else the absolute or completed href; null when there is neither."""
    key, ref = F.nullif(job_key, F.lit("")), F.nullif(href, F.lit(""))
    return F.coalesce(
        F.concat(F.lit(base + "/viewjob?jk="), key),
        F.when(ref.startswith("http"), ref).otherwise(F.concat(F.lit(base), ref)),
    )


def ilike_any(col: Column, phrases: list[str]) -> Column:
    """Substring test ignoring case; ``%`` and ``_`` in a phrase stand for themselves."""
    return contains_any(F.lower(col), [p.lower() for p in phrases])
