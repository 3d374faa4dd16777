"""Skill lists: vocabulary scan, guardrails, ordered union."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions.text import let, literal, norm_text, trim_ws

_STR = "array<string>"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(_STR)


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def first_wins(arr: Column) -> Column:
    """Distinct ignoring case; the first spelling stays, in order."""
    return let(F.transform(arr, F.lower), lambda lowered: F.filter(
        arr, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1))


def scan_vocabulary(lowered: Column, registry: dict[str, str] | None = None) -> Column:
    """Display names of the registry keys found in lower-case text, in registry order.

    Keys made of word characters only are found through one tokenisation of the text; the few with blanks or symbols
    are searched one by one, behind a cheap substring test.
    """
    registry = vocab.KNOWN_SKILLS if registry is None else registry
    words = [k for k in registry if k.replace("_", "a").isalnum()]
    others = [k for k in registry if k not in set(words)]
    tokens = F.regexp_extract_all(lowered, F.lit(r"(?U)(\w+)"), F.lit(1))
    found = F.array_intersect(_strings(words), tokens)
    if others:
        hits = [F.when(lowered.contains(k) & lowered.rlike(_bounded(k)), F.lit(k)) for k in others]
        found = F.concat(found, F.array_compact(F.array(*hits)))
    place = F.create_map(
        *[x for i, (k, v) in enumerate(registry.items())
          for x in (F.lit(k), F.struct(F.lit(i).alias("pos"), F.lit(v).alias("name")))]
    )
    ranked = F.array_sort(F.transform(found, lambda k: F.element_at(place, k)))
    return F.array_distinct(F.transform(ranked, lambda s: s["name"]))


def _bounded(key: str) -> str:
    """Word boundaries, or explicit neighbours when the key ends in a symbol."""
    if key[-1].isalnum() or key[-1] == "_":
        return rf"\b{literal(key)}\b"
    return rf"(?<![a-z0-9]){literal(key)}(?![a-z0-9])"


def company_words(company: Column, filler: list[str] = vocab.COMPANY_FILLER) -> Column:
    """The normalised company name and its words, which are never skills."""
    name = norm_text(company)
    parts = F.filter(F.split(name, r"[\s,.&]+"), lambda t: (t != "") & ~t.isin(filler))
    return F.coalesce(F.concat(F.array(name), parts), F.array().cast(_STR))


def guard_skills(
    raw: Column,
    lowered: Column,
    company: Column,
    blocklist: list[str] = vocab.SKILL_BLOCKLIST,
    short: list[str] = vocab.SHORT_SKILLS,
    min_len: int = vocab.SKILL_MIN_LEN,
    canonical: dict[str, str] = vocab.SKILL_CANONICAL,
) -> Column:
    """Drop short, generic, company-named and unmentioned skills, then canonical spelling, first spelling wins.

    ``lowered`` is the description in lower case; when it is null or empty, nothing is dropped as unmentioned.
    """
    fixed = lookup(canonical)

    def kept(names: Column) -> Column:
        return F.filter(
            F.transform(raw, lambda s: F.struct(trim_ws(s).alias("text"), norm_text(s).alias("norm"))),
            lambda p: (p["text"] != "")
            & ((F.length(p["norm"]) >= min_len) | p["norm"].isin(short))
            & ~p["norm"].isin(blocklist)
            & ~F.array_contains(names, p["norm"])
            & ((F.coalesce(lowered, F.lit("")) == "") | lowered.contains(p["norm"])),
        )

    named = F.transform(
        let(company_words(company), kept), lambda p: F.coalesce(F.element_at(fixed, p["norm"]), p["text"]))
    return let(named, first_wins)


def add_missing(existing: Column, extra: Column) -> Column:
    """Existing skills followed by those extra ones not present yet (ignoring case)."""
    return let(F.transform(existing, F.lower), lambda lowered: F.concat(
        existing, F.filter(extra, lambda s: ~F.array_contains(lowered, F.lower(s)))))


def extract_skills(
    df: DataFrame,
    text: str = "text",
    company: str = "company_name",
    stated: str = "stated_skills",
    broad: str | None = None,
    out: str = "skills",
    registry: dict[str, str] | None = None,
    crosscheck: str = "canonical",
    min_found: int = 2,
    **guards,
) -> DataFrame:
    """Stated skills followed by the vocabulary scan, through the guardrails; a broad list fills in when fewer than
    ``min_found`` survive.

    ``crosscheck="canonical"`` wants the display name itself in the text; ``"matched_key"`` keeps every scanned skill.
    """
    low = F.col("__low")
    df = df.withColumn("__low", F.lower(F.col(text)))
    df = df.withColumn("__scan", scan_vocabulary(low, registry))
    given = F.coalesce(F.col(stated), F.array().cast(_STR))
    if crosscheck == "canonical":
        kept = guard_skills(F.concat(given, F.col("__scan")), low, F.col(company), **guards)
    elif crosscheck == "matched_key":
        kept = add_missing(
            guard_skills(given, low, F.col(company), **guards),
            guard_skills(F.col("__scan"), F.lit(None).cast("string"), F.col(company), **guards),
        )
    else:
        raise ValueError(f"crosscheck must be 'canonical' or 'matched_key', not {crosscheck!r}")
    df = df.withColumn(out, kept)
    if broad:
        extra = guard_skills(F.coalesce(F.col(broad), F.array().cast(_STR)), low, F.col(company), **guards)
        df = df.withColumn(
            out, F.when(F.size(out) < min_found, add_missing(F.col(out), extra)).otherwise(F.col(out))
        )
    return df.drop("__low", "__scan")


def first_skills(skills: Column, n: int) -> Column:
    return F.slice(skills, 1, n)


def more_skills(skills: Column, n: int) -> Column:
    """How many skills a list shortened to n leaves out."""
    return F.greatest(F.size(F.coalesce(skills, F.array().cast(_STR))) - n, F.lit(0))
