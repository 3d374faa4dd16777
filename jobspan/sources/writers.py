"""Sinks. Every write is one job over partitions; nothing passes through the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.functions.text import chunk_path, description_path
from jobspan.operators.boards import boards_by_jobs, export_rows


def append_postings(rows: DataFrame, path: str) -> None:
    """Appends the rows of an ingested batch (``Ingested.postings``)."""
    rows.write.mode("append").parquet(path)


def description_table(df: DataFrame, company: str = "company_name", title: str = "title", key: str = "link"
                      ) -> DataFrame:
    """Description texts keyed by their path; postings without text have none."""
    name = F.coalesce(F.nullif(F.col(company), F.lit("")), F.lit("unknown"))
    return df.where(F.coalesce("description", F.lit("")) != "").select(
        description_path(name, F.col(title), F.col(key)).alias("path"), F.col("description").alias("text"))


def text_uris(descriptions: DataFrame, text_root: str) -> DataFrame:
    """The texts of an ingested batch as (uri, text), by the address that the stored postings have."""
    return descriptions.select(F.concat(F.lit(text_root.rstrip("/") + "/"), "path").alias("uri"), "text")


def chunk_table(df: DataFrame, chunks: str = "chunks", job_id: str = "id") -> DataFrame:
    """Given chunks of descriptions keyed by their path."""
    rows = df.select(job_id, "company_name", "title", F.posexplode(chunks).alias("chunk_index", "text"))
    path = chunk_path(F.col("company_name"), F.col("title"), F.col(job_id), F.col("chunk_index"))
    return rows.select(job_id, "chunk_index", path.alias("path"), "text")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def export_csv(boards: DataFrame, path: str) -> None:
    """Boards with their address, most postings first."""
    export_rows(boards).write.mode("overwrite").option("header", True).csv(path)


def export_json(boards: DataFrame, path: str, min_jobs: int = 0) -> None:
    boards_by_jobs(boards, min_jobs).write.mode("overwrite").json(path)
