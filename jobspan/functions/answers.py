"""Request texts for an outside model and validation of the answers it gave.

The model itself is not part of this library: requests leave as a table and answers come back as a table
``(id, raw)``, so both ends are ordinary columns.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobspan.functions.text import trim_ws

_STR = "array<string>"
# How much of a text the model of each kind of request was given (fixed values); pass one to cut a request to it.
REQUEST_CHARS = {"skills": 4000, "years": 4000, "company": 4000, "resume": 6000, "role": 1000, "site": 2000}
TEMPLATES = {
    "skills": ("List the technical skills named in this posting and the minimum years of experience it asks for.\n"
               'Answer as JSON: {"required_skills": [...], "experience_years": n or null}\n\nPosting:\n'),
    "years": ("Give the minimum years of experience this posting asks for.\n"
              'Answer as JSON: {"experience_years": n or null}\n\nPosting:\n'),
    "company": "Describe the company behind this posting as JSON with the field company_name.\n\nPosting:\n",
    "resume": ("Read this resume.\n"
               'Answer as JSON: {"skills": [...], "experience_years": n or null, "summary": "..."}\n\nResume:\n'),
    "role": "Sum up what these postings have in common, as JSON.\n\nPosting:\n",
    "site": "Text of the company site:\n",
}


def request_text(kind: str, text: Column, max_chars: int | None = None) -> Column:
    """Template followed by the whole text, or by its first ``max_chars`` characters."""
    return F.concat(F.lit(TEMPLATES[kind]), F.substring(text, 1, max_chars) if max_chars else text)


def strip_fences(raw: Column) -> Column:
    return trim_ws(F.regexp_replace(raw, "```(?:json)?|```", ""))


def parsed(raw: Column, fences: bool = True) -> Column:
    """The answer as a variant; null when it is no JSON."""
    return F.try_parse_json(strip_fences(raw) if fences else raw)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def answer_problem(raw: Column, fences: bool = True) -> Column:
    """Why an answer cannot be used, or null."""
    return (
        F.when(raw.isNull(), "missing").when(trim_ws(raw) == "", "empty")
        .when(parsed(raw, fences).isNull(), "not json")
    )


def _kind(v: Column, path: str) -> Column:
    return F.upper(F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("")))


def text_list(v: Column, *paths: str) -> Column:
    """First of the paths that exists, as a list of its strings; [] when it is no list."""
    def at(path: str) -> Column:
        items = F.try_variant_get(v, path, "array<variant>")
        strings = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
        return F.transform(strings, lambda x: F.try_variant_get(x, "$", "string"))

    out = F.array().cast(_STR)
    for path in reversed(paths):
        here = F.try_variant_get(v, path, "variant")
        out = F.when(here.isNotNull(), F.coalesce(at(path), F.array().cast(_STR))).otherwise(out)
    return out


def year_count(v: Column, path: str = "$.experience_years", low: int = 0, high: int | None = None,
               digits: bool = True) -> Column:
    """Whole years from a number in range, or (unbounded) from the first digits of a string."""
    kind = _kind(v, path)
    number = F.try_variant_get(v, path, "double")
    good = (number >= low) & (F.lit(True) if high is None else number <= high)
    text = F.nullif(F.regexp_extract(F.try_variant_get(v, path, "string"), r"(\d+)", 1), F.lit(""))
    return (
        F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & good, number.cast("int"))
        .when((kind == "STRING") & F.lit(digits), text.try_cast("int"))
    )


def skills_answer(raw: Column) -> Column:
    """struct(ok, skills, years) of an extraction answer."""
    v = parsed(raw, fences=False)
    return F.struct(
        _is_object(v).alias("ok"),
        text_list(v, "$.required_skills", "$.skills").alias("skills"),
        year_count(v).alias("years"),
    )


def years_answer(raw: Column) -> Column:
    return year_count(parsed(raw), high=40)


def resume_answer(raw: Column, text: Column, head: int | None = None) -> Column:
    """struct(skills, experience_years, summary); without a usable answer the summary is the resume, or its first ``head``
    characters."""
    v = parsed(raw)
    summary = F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(""))
    return F.struct(
        text_list(v, "$.skills").alias("skills"),
        year_count(v, low=-2**31, digits=False).alias("experience_years"),
        F.when(_is_object(v), summary).otherwise(F.substring(text, 1, head) if head else text).alias("summary"),
    )


def company_answer(raw: Column, company: Column | None = None) -> Column:
    """Company profile as a variant's JSON text with its name; null without the required field."""
    v = parsed(raw, fences=False)
    has = _is_object(v) & F.try_variant_get(v, "$.company_name", "variant").isNotNull()
    name = F.nullif(F.try_variant_get(v, "$.company_name", "string"), F.lit(""))
    if company is not None:
        name = F.coalesce(name, company)
    return F.when(has, F.struct(name.alias("company_name"), F.to_json(v).alias("profile")))


ROLE_FIELDS = ["key_keywords", "key_skills", "key_concepts", "action_verbs"]


def role_answer(raw: Column) -> Column:
    """struct of a role profile; null when the answer is no JSON."""
    v = parsed(raw, fences=False)
    return F.when(
        v.isNotNull(),
        F.struct(
            F.try_variant_get(v, "$.role", "string").alias("role"),
            *[text_list(v, f"$.{f}").alias(f) for f in ROLE_FIELDS],
            *[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in ("experience_emphasis", "ideal_profile")],
        ),
    )


def id_list(raw: Column) -> Column:
    """A ranked list of ids; null when the answer is no list."""
    return F.try_variant_get(parsed(raw), "$", "array<bigint>")


def text_by_id(raw: Column) -> Column:
    """map id -> text of an explanation answer, empty texts dropped; {} when it is no JSON object or a key is no id."""
    none = F.create_map().cast("map<bigint,string>")
    pairs = F.from_json(strip_fences(raw), "map<string,string>")
    kept = F.map_filter(pairs, lambda k, t: F.coalesce(t, F.lit("")) != "")
    sound = F.forall(F.map_keys(kept), lambda k: k.try_cast("bigint").isNotNull())
    return F.coalesce(F.when(sound, F.transform_keys(kept, lambda k, t: k.try_cast("bigint"))), none)


CATEGORIES = ["skills_for_role", "top_skills", "top_companies", "role_overview", "skill_gap", "off_topic"]


def question_class(raw: Column) -> Column:
    """struct(category, role, skills_known) of a classified question; off topic when it cannot be read."""
    v = parsed(raw, fences=False)
    return F.struct(
        F.coalesce(F.try_variant_get(v, "$.category", "string"), F.lit("off_topic")).alias("category"),
        F.lower(trim_ws(F.coalesce(F.try_variant_get(v, "$.role", "string"), F.lit("")))).alias("role"),
        text_list(v, "$.skills_known").alias("skills_known"),
    )


def two_tier(rule: Column, answer: Column) -> tuple[Column, Column]:
    """Rule first, the answer only where the rule found nothing; value and where it came from."""
    origin = F.when(rule.isNotNull(), "rule").when(answer.isNotNull(), "model").otherwise("none")
    return F.coalesce(rule, answer), origin
