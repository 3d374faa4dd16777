"""Job-market analytics on Spark: ingest, admit, dedupe, enrich, rank and aggregate job postings."""
