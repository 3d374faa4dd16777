"""Table schemas (column -> type) and additive schema upgrade."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALARY = "struct<min: double, max: double, currency: string>"
POSTINGS = {
    "id": "long", "company_name": "string", "title": "string", "description": "string", "link": "string",
    "location": "string", "posted_date": "timestamp", "salary": SALARY, "source": "string",
    "skills": "array<string>", "experience_years": "int", "enriched_at": "timestamp", "embedding": "array<float>",
    "added_at": "int",
}
RAW_POSTING = {
    "company_name": "string", "title": "string", "description": "string", "link": "string", "location": "string",
    "locations": "array<string>", "posted_date": "timestamp", "salary": SALARY, "source": "string",
    "followers": "long", "employees": "long",
}
SCRAPE_LOG = {
    "keyword": "string", "cards_scraped": "long", "inserted": "long", "duplicate": "long", "blocked": "long",
    "bad_title": "long", "error": "long", "total_in_db": "long", "completed_at": "timestamp",
}
BOARDS = {
    "ats": "string", "company_name": "string", "key": "string", "wd_num": "int", "career_site": "string",
    "job_count": "int", "last_scraped": "timestamp", "active": "boolean", "discovered_at": "timestamp",
}
COMPANIES = {"name": "string", "slug": "string", "company_id": "string", "jobs": "int"}
RESPONSES = {"id": "long", "kind": "string", "raw": "string"}
AGGREGATOR = {
    "job_url": "string", "title": "string", "company": "string", "description": "string", "location": "string",
    "site": "string", "date_posted": "string", "min_amount": "double", "max_amount": "double", "currency": "string",
}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


# Landed feed payloads, one JSON document per board response.
LEVER_JOB = (
    "struct<text: string, hostedUrl: string, categories: struct<location: string, allLocations: array<string>>, "
    "descriptionPlain: string, additionalPlain: string, lists: array<struct<text: string, content: string>>, "
    "salaryRange: struct<min: double, max: double, currency: string>, createdAt: long>"
)
ASHBY_JOB = (
    "struct<id: string, title: string, location: string, locationName: string, externalLink: string, "
    "applyLink: string, publishedAt: string, updatedAt: string, createdAt: string, descriptionHtml: string>"
)
SMARTRECRUITERS_JOB = (
    "struct<id: string, name: string, releasedDate: string, location: struct<remote: boolean, city: string, "
    "region: string, country: string>, jobAd: struct<sections: struct<companyDescription: struct<title: string, "
    "text: string>, jobDescription: struct<title: string, text: string>, qualifications: struct<title: string, "
    "text: string>, additionalInformation: struct<title: string, text: string>>>>"
)
GREENHOUSE_JOB = (
    "struct<id: long, title: string, absolute_url: string, location: string, "
    "offices: array<struct<name: string, location: string>>, content: string>"
)
WORKDAY_JOB = (
    "struct<title: string, externalPath: string, locationsText: string, postedOn: string, "
    "jobDescription: string, jobPostingInfo: struct<jobDescription: string>>"
)

def conform(df: DataFrame, schema: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """The schema's columns in order and type; missing ones become nulls, unknown ones but ``keep`` are dropped."""
    have = set(df.columns)
    return df.select(
        *keep, *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in schema.items()])
