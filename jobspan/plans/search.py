"""Searches: one hybrid search, and whole batches of résumés."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions import scores as S
from jobspan.functions.vectors import cosine_to
from jobspan.operators import retrieval as R
from jobspan.operators.admission import not_staffing
from jobspan.operators.keys import salted_lookup
from jobspan.session import written

_STR = "array<string>"
RESULT = ["id", "title", "company", "location", "experience_years", "skills", "link", "source", "hours_since_posted"]
SCORES = ["vec_score", "hybrid_score", "skill_overlap", "filter_score", "exp_score"]


@dataclass
class Filters:
    """What a searcher asked for besides the query; None and [] mean no wish."""

    min_years: int | None = None
    skills: list[str] = field(default_factory=list)
    location: str | None = None
    max_hours_old: int | None = None
    sources: list[str] = field(default_factory=list)
    title_aliases: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.min_years is not None and not 0 <= self.min_years <= 30:
            raise ValueError("min_years must be 0 to 30")
        if self.max_hours_old is not None and self.max_hours_old < 0:
            raise ValueError("max_hours_old must not be negative")


def filters_from_form(experience: str = "any", recency: str = "any", location: str = "", remote: bool = False,
                      skills: list[str] = (), sources: list[str] = (),
                      all_sources: list[str] = vocab.SEARCH_SOURCES) -> Filters:
    """Form values to filters: "any" is no wish, and so is a choice of every source."""
    place = location.strip() or None
    return Filters(
        min_years=None if experience == "any" else int(experience),
        max_hours_old=None if recency == "any" else int(recency),
        location=place, skills=list(skills),
        sources=[] if len(sources) == len(all_sources) else list(sources),
    )


@dataclass
class Search:
    """A validated search."""

    query: str
    filters: Filters = field(default_factory=Filters)
    resume_skills: list[str] = field(default_factory=list)
    top_n: int = 20
    candidates: int = 250
    page: int = 1

    def __post_init__(self):
        if not self.query or not self.query.strip():
            raise ValueError("a query or resume text is needed")
        for name, (low, high) in LIMITS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be {low} to {high}")


def check_ids(ids: list[int]) -> list[int]:
    if not 1 <= len(ids) <= 30:
        raise ValueError("1 to 30 ids")
    return list(ids)


def check_question(question: str) -> str:
    if not 3 <= len(question) <= 500:
        raise ValueError("a question has 3 to 500 characters")
    return question


LIMITS = {"top_n": (1, 100), "candidates": (10, 500), "page": (1, 10)}


def request_fault(query: Column, top_n: Column, candidates: Column, page: Column) -> Column:
    """The first parameter of a table of searches that ``Search`` would refuse, or null."""
    out = F.when(F.coalesce(F.trim(query), F.lit("")) == "", "query")
    for (name, (low, high)), value in zip(LIMITS.items(), (top_n, candidates, page), strict=True):
        out = out.when(~F.coalesce(value.between(low, high), F.lit(False)), name)
    return out


def question_ok(question: Column) -> Column:
    return F.coalesce(F.length(question).between(3, 500), F.lit(False))


def ids_ok(ids: Column) -> Column:
    return F.coalesce(F.size(ids).between(1, 30), F.lit(False))


def form_filters(forms: DataFrame, all_sources: list[str] = vocab.SEARCH_SOURCES) -> DataFrame:
    """Rows of form values as ``filters_from_form`` reads them: min_years, max_hours_old, location, skills and sources take the place
    of experience, recency, location, remote, skills and sources."""
    number = lambda c: F.when(F.col(c) != "any", F.col(c).cast("int"))
    empty = F.array().cast(_STR)
    given = F.coalesce("sources", empty)
    return forms.withColumns({
        "min_years": number("experience"), "max_hours_old": number("recency"), "location": F.nullif(F.trim("location"), F.lit("")),
        "skills": F.coalesce("skills", empty), "sources": F.when(F.size(given) == len(all_sources), empty).otherwise(given),
    }).drop("experience", "recency", "remote")


def query_vector(vectors: DataFrame, vector_id: int, key: str = "vec_id", vec: str = "embedding") -> list[float]:
    """One stored vector as the query of a search."""
    row = vectors.where(F.col(key) == vector_id).select(vec).first()
    if row is None or row[0] is None:
        raise ValueError(f"no vector {vector_id}")
    return [float(x) for x in row[0]]


def score_candidates(df: DataFrame, wanted: Column, manual, resume, min_years, use_skills: bool | Column,
                     use_years: bool) -> DataFrame:
    """Hybrid score and its parts. The weights depend only on which wishes exist (a column when that differs by row)."""
    # The parts become columns first: they are used more than once, and each costs a pass over the row's arrays.
    df = df.withColumns({
        "__filter": S.manual_skill_score(F.col("skills"), manual) * S.resume_skill_score(F.col("skills"), resume),
        "__exp": S.experience_score(F.col("experience_years"), min_years),
        "__overlap": S.overlap_score(wanted, F.col("skills"), F.col("title")),
        "__recency": S.recency_score(F.col("hours_since_posted")),
    })
    parts = [F.col(c) for c in ("vec_score", "__filter", "__exp", "__overlap", "title_score", "__recency")]
    if isinstance(use_skills, Column):
        both = zip(S.weights(True, use_years), S.weights(False, use_years))
        w = [F.when(use_skills, yes).otherwise(no) for yes, no in both]
    else:
        w = S.weights(use_skills, use_years)
    return df.withColumns({
        "skill_overlap": F.round("__overlap", 4), "filter_score": F.round("__filter", 4),
        "exp_score": F.round("__exp", 4), "hybrid_score": F.round(S.weighted(parts, w), 4),
    }).drop("__filter", "__exp", "__overlap", "__recency")


def candidates(postings: DataFrame, vec: list[float], query: str, filters: Filters, k: int, now) -> DataFrame:
    """Postings that pass the filters and are nearest to the query vector, plus title-alias hits."""
    wanted = S.query_tokens(F.lit(query))
    scored = postings.where(
        R.search_predicates(filters.location, filters.max_hours_old, filters.sources, now)
    ).select(
        "id", "title", F.col("company_name").alias("company"), "location", "experience_years",
        F.coalesce("skills", F.array().cast(_STR)).alias("skills"), "link", "source",
        S.hours_since(F.col("posted_date"), now).alias("hours_since_posted"),
        cosine_to(vec, F.col("embedding")).alias("vec_score"),
        S.lexical_score(wanted, F.col("title"), F.col("company_name")).alias("title_score"),
    )
    return R.with_aliases(R.top_k(scored, "vec_score", k), scored, filters.title_aliases)


def _ranked(df: DataFrame, per: list[str] = ()) -> DataFrame:
    """Rank by hybrid score; equal scores keep the order in which the candidates were found."""
    order = [F.desc("hybrid_score"), F.col("origin"),
             F.desc(F.when(F.col("origin") == 0, F.round("vec_score", R.SIM_DIGITS))), F.col("id")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))


def hybrid_search(postings: DataFrame, vec: list[float], search: Search, now, final_order: str = "vec_score") -> DataFrame:
    """A page of results: candidates, hybrid rank, staffing names removed, source mix, then the final order.

    The hybrid score picks the pool of five pages; the pages themselves go by ``final_order``.
    """
    f = search.filters
    found = candidates(postings, vec, search.query, f, search.candidates, now)
    scored = score_candidates(
        found, S.query_tokens(F.lit(search.query)), f.skills, search.resume_skills, f.min_years,
        bool(f.skills or search.resume_skills), f.min_years is not None,
    )
    ranked = _ranked(scored).where(not_staffing(F.col("source"), F.col("company")))
    pool = R.diversify(ranked, search.top_n * 5, [F.col("rank")])
    by = F.desc(F.round(final_order, R.SIM_DIGITS))
    out = R.page(pool.drop("rank"), search.page, search.top_n, [by, F.col("pool_rank")])
    return out.withColumn("vec_score", F.round("vec_score", 4)).select("rank", "total", *RESULT, *SCORES)


def simple_search(postings: DataFrame, vec: list[float], query: str, now, top_n: int = 10, k: int = 30,
                  filters: Filters | None = None, ranking: DataFrame | None = None) -> DataFrame:
    """Hybrid rank of the nearest postings; a ranked id list, when given, goes before it."""
    f = filters or Filters()
    found = candidates(postings, vec, query, f, k, now)
    ranked = _ranked(score_candidates(found, S.query_tokens(F.lit(query)), [], [], None, False, False))
    if ranking is not None:
        return R.rerank(ranked, ranking, top_n).select(F.col("new_rank").alias("rank"), *RESULT, *SCORES)
    return ranked.where(F.col("rank") <= top_n).select("rank", *RESULT, *SCORES)


def match_resumes(postings: DataFrame, resumes: DataFrame, now, top_n: int = 20, k: int = 250,
                  max_hours_old: int | None = 720) -> DataFrame:
    """Best postings of every résumé (resume_id, summary, skills, vec), all résumés in one job.

    Nearest postings by vector first, then the hybrid score with the résumé's skills as the wish.
    """
    fresh = postings.where(R.search_predicates(max_hours_old=max_hours_old, now=now))
    near = written(R.batch_top_k(fresh, resumes, k, query_id="resume_id"), "near")
    person = resumes.select(
        "resume_id", F.coalesce("skills", F.array().cast(_STR)).alias("owned"),
        S.query_tokens(F.col("summary")).alias("wanted"),
        S.query_tokens(F.col("summary")).alias("title_wanted"),
    )
    facts = fresh.select(
        "id", "title", F.col("company_name").alias("company"), "location", "experience_years",
        F.coalesce("skills", F.array().cast(_STR)).alias("skills"), "link", "source",
        S.hours_since(F.col("posted_date"), now).alias("hours_since_posted"),
    )
    # A posting may be near to a third of all résumés, so its facts are looked up in several tasks.
    rows = salted_lookup(near, facts, ["id"], ["resume_id"], "inner").join(person, "resume_id")
    rows = rows.withColumn(
        "title_score", S.lexical_score(F.col("title_wanted"), F.col("title"), F.col("company"))
    ).withColumn("origin", F.lit(0))
    scored = score_candidates(rows, F.col("wanted"), None, F.col("owned"), None, F.size("owned") > 0, False)
    ranked = _ranked(scored, ["resume_id"])
    return ranked.where(F.col("rank") <= top_n).select("resume_id", "rank", *RESULT, *SCORES)


def jobs_json(results: DataFrame, skills: int, per: list[str] = ("resume_id",), location: bool = False) -> DataFrame:
    """Ranked results of each query as one JSON list, for a rerank (15 skills) or explanation (12 skills, location)
    request. A result list is bounded by the search that made it."""
    fields = ["id", "title", "company"] + (["location"] if location else [])
    job = F.struct(*fields, "experience_years", F.slice("skills", 1, skills).alias("skills"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", job.alias("job"))))
    return results.groupBy(*per).agg(F.to_json(F.transform(ordered, lambda r: r["job"])).alias("jobs"))


def query_text(saved: DataFrame) -> Column:
    """Words of a saved search (skills, experience, location, remote) as one query."""
    place = F.nullif(F.trim(F.coalesce("location", F.lit(""))), F.lit(""))
    return F.concat_ws(
        " ",
        F.nullif(F.array_join(F.coalesce("skills", F.array().cast(_STR)), ", "), F.lit("")),
        F.lit("jobs"),
        F.when(F.col("experience").isNotNull(), F.concat(F.col("experience").cast("string"), F.lit("+ years"))),
        F.concat(F.lit("in "), place),
        F.when(F.col("remote"), "remote"),
    )


def merge_intent(searches: DataFrame) -> DataFrame:
    """Explicit wishes win over those read out of the query; the location is only ever explicit.

    ``searches`` has the explicit columns and the extracted ones with the prefix ``x_``.
    """
    empty = F.array().cast(_STR)
    return searches.select(
        "query_id",
        F.coalesce(F.nullif("x_query", F.lit("")), F.col("query")).alias("query"),
        F.nullif("location", F.lit("")).alias("location"),
        F.coalesce("min_years", "x_min_years").alias("min_years"),
        F.when(F.size(F.coalesce("skills", empty)) > 0, F.col("skills")).otherwise(F.coalesce("x_skills", empty))
        .alias("skills"),
        F.coalesce("max_hours_old", "x_max_hours_old").alias("max_hours_old"),
        F.coalesce("x_title_aliases", empty).alias("title_aliases"),
    )
