"""Tables and landed files. Schemas are always given, never inferred."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspan import schemas
from jobspan.functions.text import blank_to_null, trim_ws
from jobspan.operators.insights import distinct_names
from jobspan.operators.keys import optional_lookup
from jobspan.session import scratch_folder


def postings(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.option("mergeSchema", True).parquet(path), schemas.POSTINGS)


def postings_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int, **options
                  ) -> DataFrame:
    """Postings of a database, read in id ranges."""
    return schemas.conform(
        spark.read.jdbc(url, table, column="id", lowerBound=low, upperBound=high, numPartitions=partitions,
                        properties=options),
        schemas.POSTINGS,
    )


def boards(spark: SparkSession, path: str, only_active: bool = True) -> DataFrame:
    table = spark.read.schema(schemas.ddl(schemas.BOARDS)).parquet(path)
    return table.where("active") if only_active else table


def names(table: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct names of any table's column, in order, up to a limit."""
    return distinct_names(table, column, limit)


def company_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {name, slug or company_id, jobs}; ``key`` is whichever id is there."""
    rows = spark.read.schema(schemas.ddl(schemas.COMPANIES)).option("multiLine", True).json(path)
    return rows.withColumn("key", F.coalesce("slug", "company_id"))


def name_lines(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, blank lines dropped."""
    return spark.read.text(path).select(blank_to_null(F.col("value")).alias("name")).where("name is not null")


def crawl_urls(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """URLs of crawl index dumps (JSON lines); broken lines and empty URLs are skipped."""
    rows = spark.read.schema("url string").option("mode", "DROPMALFORMED").json(paths)
    return rows.where(F.col("url") != "")


def aggregator(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.ddl(schemas.AGGREGATOR))
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


_FEEDS = {
    "lever": f"struct<payload: array<{schemas.LEVER_JOB}>>",
    "ashby": "struct<data: struct<" + ", ".join(
        f"{k}: struct<jobPostings: array<{schemas.ASHBY_JOB}>>"
        for k in ("jobBoard", "jobBoardWithTeams", "jobPostingList")) + ">>",
    "smartrecruiters": f"struct<content: array<{schemas.SMARTRECRUITERS_JOB}>>",
    "greenhouse": f"struct<jobs: array<{schemas.GREENHOUSE_JOB}>>",
    "workday": f"struct<jobPostings: array<{schemas.WORKDAY_JOB}>>",
}


def feed_jobs(landed: DataFrame, feed: str, payload: str = "payload", position: str | None = None) -> DataFrame:
    """One row per posting (column ``job``) of landed board responses; the other columns stay.

    ``payload`` holds a board's JSON response as text, with any number of postings. ``position`` names a column for the place of
    each in its response, from 0. A response that does not parse gives no rows.
    """
    if feed not in _FEEDS:
        raise ValueError(f"unknown feed {feed!r}")
    text = F.concat(F.lit('{"payload":'), F.col(payload), F.lit("}")) if feed == "lever" else F.col(payload)
    doc = F.from_json(text, _FEEDS[feed])
    if feed == "lever":
        jobs = doc["payload"]
    elif feed == "ashby":
        lists = [doc["data"][k]["jobPostings"] for k in ("jobBoard", "jobBoardWithTeams", "jobPostingList")]
        jobs = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    else:
        jobs = doc[{"smartrecruiters": "content", "greenhouse": "jobs", "workday": "jobPostings"}[feed]]
    keep = [c for c in landed.columns if c != payload]
    if position:
        return landed.select(*keep, F.posexplode(jobs).alias(position, "job"))
    return landed.select(*keep, F.explode(jobs).alias("job"))


def description_files(spark: SparkSession, path: str) -> DataFrame:
    """Description files as (uri, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def resolve_descriptions(df: DataFrame, texts: DataFrame, prefix: str = "gs://", row_id: str = "id",
                         out: str = "text") -> DataFrame:
    """Adds the description text: looked up where the description is a URI, else as it is; a missing file gives null.

    Inline rows have no URI to join on; they are spread by id rather than sent to one task.
    """
    is_uri = F.col("description").startswith(prefix)
    keyed = df.withColumn("uri", F.when(is_uri, F.col("description")))
    found = optional_lookup(keyed, texts.select("uri", F.col("text").alias("__text")), "uri", row_id)
    return found.withColumn(out, F.when(is_uri, F.col("__text")).otherwise(F.col("description"))).drop("__text", "uri")


def _written(df: DataFrame) -> DataFrame:
    path = scratch_folder(df.sparkSession, "profiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ISLAND = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'


def page_profiles(pages: DataFrame, path: str = "$.props.pageProps.customerProfiles", html: str = "html") -> DataFrame:
    """(page, slug, name) of company profiles in the JSON island of pages, first name per page and slug.

    A page without the profile list is searched for any object with slug, name and a logo or website, at any depth. The pages are
    read once; each level is read from the one before in the shared folder, until none is left.
    """
    key = pages.columns[0]
    doc = F.try_parse_json(F.nullif(F.regexp_extract(html, ISLAND, 1), F.lit("")))
    data = _written(pages.select(key, doc.alias("doc")).where("doc is not null"))
    listed = F.coalesce(F.try_variant_get("doc", path, "array<variant>"), F.array().cast("array<variant>"))
    direct = data.where(F.size(listed) > 0).select(key, F.posexplode(listed).alias("at", "node"))
    direct = direct.withColumn("at", F.format_string("%08d", F.col("at")))
    level = data.where(F.size(listed) == 0).select(key, F.lit("").alias("at"), F.col("doc").alias("node"))
    found = direct
    while not level.isEmpty():
        shape = F.schema_of_variant("node")
        has = [F.try_variant_get("node", f"$.{f}", "variant").isNotNull() for f in ("slug", "name", "logo", "website")]
        hit = shape.startswith("OBJECT") & has[0] & has[1] & (has[2] | has[3])
        found = found.unionByName(level.where(hit).select(key, "at", "node"))
        parts = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer()).select("pos", "value"))
        inner = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        level = _written(parts.where(inner).select(
            key, F.concat("at", F.format_string("%08d", F.col("pos"))).alias("at"), F.col("value").alias("node")))
    rows = found.select(
        key, "at", trim_ws(F.try_variant_get("node", "$.slug", "string")).alias("slug"),
        trim_ws(F.try_variant_get("node", "$.name", "string")).alias("name"),
    ).where((F.col("slug") != "") & (F.col("name") != ""))
    best = rows.groupBy(key, "slug").agg(F.min(F.struct("at", "name")).alias("f"))
    return best.select(key, "slug", F.col("f.name").alias("name"))
