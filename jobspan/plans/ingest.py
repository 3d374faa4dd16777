"""Ingest of a batch of raw postings: admission, storage, descriptions, counters."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.operators.admission import AdmissionRules, rows_to_store, status_counts, statuses
from jobspan.sources.writers import description_table


@dataclass
class Ingested:
    statuses: DataFrame      # (id, by ..., status) of every row
    postings: DataFrame      # rows to store
    descriptions: DataFrame  # (path, text) of the stored rows
    counts: DataFrame        # counters per key


def ingest(raw: DataFrame, stored: DataFrame, ingest_ts, rules: AdmissionRules | None = None, by: list[str] = ("source",),
           admission: bool = True, row_id: str = "id", text_root: str | None = None) -> Ingested:
    """One batch. ``admission=False`` (the aggregator feed) only removes duplicates. With ``text_root``, the stored descriptions are
    addresses of the texts below that folder.

    The texts are read once to judge every row; statuses and counters come from narrow tables, and only the rows to store are
    fetched again, by id.
    """
    status, winners = statuses(raw, stored, rules, row_id, list(by), admission=admission)
    new = raw.where(F.col(row_id).isin(winners))  # unlike a semi join, a filter that Spark moves below the joins that make ``raw``
    return Ingested(status, rows_to_store(new, ingest_ts, row_id, text_root), description_table(new), status_counts(status, list(by)))
