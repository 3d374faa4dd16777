"""Job boards: candidates to try, boards found in crawls, refresh and ordering."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions.names import board_from_url, board_url, cohort_key, slug_candidates, slug_variants
from jobspan.functions.text import if_any
from jobspan.operators.keys import apply_updates, unknown_only, without_known_candidates


def active_boards(boards: DataFrame) -> DataFrame:
    return boards.where("active")


def board_candidates(names: DataFrame, known: DataFrame, numbers: list[int] = vocab.SERVER_NUMBERS,
                     suffixes: list[str] = vocab.LONG_SUFFIXES, name: str = "name", tenant: str = "tenant"
                     ) -> DataFrame:
    """(name, slug, wd_num) to try for companies none of whose slugs is a known tenant."""
    rows = names.select(F.col(name).alias("name")).distinct()
    rows = rows.withColumn("slugs", slug_candidates(F.col("name"), suffixes))
    fresh = without_known_candidates(rows, known.withColumnRenamed(tenant, "slug"), "name", "slugs", "slug")
    return fresh.select("name", F.explode("slugs").alias("slug")).withColumn(
        "wd_num", F.explode(F.array(*[F.lit(n) for n in numbers])))


def search_terms(terms: DataFrame, countries: list[str], term: str = "term") -> DataFrame:
    """Every term for every country."""
    return terms.select(F.explode(F.array(*[F.lit(c) for c in countries])).alias("country"), term)


def frequent_sites(urls: DataFrame, url: str = "url", parse: Column | None = None) -> DataFrame:
    """Most frequent career site of every (tenant, wd_num) in crawled URLs; equal counts go to the smaller name.

    Counted per site first, so a tenant with a third of all URLs arrives at its group as a handful of counts.
    """
    board = board_from_url(F.col(url)) if parse is None else parse
    sites = urls.select(if_any(board).alias("b")).select("b.*")
    counts = sites.groupBy("tenant", "wd_num", "career_site").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("career_site"))).alias("w")
    return counts.groupBy("tenant", "wd_num").agg(best).select(
        "tenant", "wd_num", F.col("w.career_site").alias("career_site"), (-F.col("w.n")).alias("urls"))


def discover_boards(crawls: list[DataFrame], known: DataFrame, url: str = "url", parse: Column | None = None
                    ) -> DataFrame:
    """Boards named in one or several crawl indices and not known by tenant yet."""
    urls = reduce(DataFrame.unionByName, [c.select(url) for c in crawls])
    return unknown_only(frequent_sites(urls, url, parse), known, "tenant")


def candidate_slugs(sources: list[DataFrame], name: str = "name", position: str = "pos") -> DataFrame:
    """Distinct slug variants of names from several lists, in order of list, position in it and variant.

    ``rank_list``, ``rank_pos`` and ``rank_variant`` keep where a slug came up first. A name is taken apart once, at its first
    place: each of its variants comes up first there. So the variants are made after a shuffle of names, not in the tasks that read them.
    """
    rows = reduce(DataFrame.unionByName, [
        s.select(F.lit(i).alias("rank_list"), F.col(position).cast("long").alias("rank_pos"), F.col(name).alias("n"))
        for i, s in enumerate(sources)])
    rows = rows.groupBy("rank_list", "n").agg(  # a place that is not known comes before others
        F.when(F.count("rank_pos") == F.count("*"), F.min("rank_pos")).alias("rank_pos"))
    rows = rows.select("rank_list", "rank_pos", F.posexplode(slug_variants(F.col("n"))).alias("rank_variant", "slug"))
    first = rows.groupBy("slug").agg(F.min(F.struct("rank_list", "rank_pos", "rank_variant")).alias("f"))
    return first.select("slug", "f.*")


def newest_cohort_first(companies: DataFrame, cohort: str = "batch") -> DataFrame:
    """Companies by cohort, newest first (then by name)."""
    key = cohort_key(F.col(cohort))
    return companies.withColumn("cohort", key).orderBy(
        F.desc("cohort.year"), F.desc("cohort.season"), "name")


def cohort_names(companies: DataFrame, cohort: str = "batch") -> DataFrame:
    """Slug and, when it differs, name of every company, newest cohort first: (name, pos)."""
    slug, name = F.nullif("slug", F.lit("")), F.nullif("name", F.lit(""))
    both = F.array_compact(F.array(slug, F.when(~F.lower(slug).eqNullSafe(F.lower(name)), name)))
    # newest first as one increasing number; a name's place in its cohort is not fixed beyond that
    rows = companies.withColumn("__key", cohort_key(F.col(cohort))).withColumn("name", F.explode(both))
    return rows.select((-(F.col("__key.year") * 10 + F.col("__key.season"))).alias("pos"), "name")


def boards_by_jobs(boards: DataFrame, min_jobs: int = 0) -> DataFrame:
    return boards.where(F.col("jobs") >= min_jobs).orderBy(F.desc("jobs"), "slug")


def active_first(boards: DataFrame) -> DataFrame:
    return boards.where(F.col("jobs") > 0).orderBy(F.desc("jobs"), "name")


def active_split(boards: DataFrame) -> DataFrame:
    """How many boards have postings and how many are empty, with their postings."""
    return boards.groupBy((F.col("jobs") > 0).alias("active")).agg(
        F.count("*").alias("boards"), F.sum("jobs").cast("long").alias("jobs"))


def refresh_boards(boards: DataFrame, admitted: DataFrame, at, key: str = "key") -> DataFrame:
    """Boards with the number of postings inserted in this run and the time it read them."""
    when = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    seen = admitted.groupBy(key).agg(
        F.count_if(F.col("status") == "inserted").cast("int").alias("job_count")
    ).withColumn("last_scraped", when)
    return apply_updates(boards, seen, key, ["job_count", "last_scraped"])


def export_rows(boards: DataFrame) -> DataFrame:
    """Boards as exported: most postings first, with the board's address."""
    return boards.select(
        "company_name", "tenant", "wd_num", "career_site", "job_count",
        board_url(F.col("tenant"), F.col("wd_num"), F.col("career_site")).alias("board_url"),
    ).orderBy(F.desc("job_count"), "tenant", "wd_num")
