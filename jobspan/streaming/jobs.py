"""Structured Streaming forms of the incremental work, each with a batch twin that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspan.operators.admission import AdmissionRules
from jobspan.operators.keys import salted_lookup
from jobspan.plans.ingest import ingest
from jobspan.streaming import state
from jobspan.streaming.link_index import LinkIndex


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> str:
    """Process what has arrived, then stop; the next call goes on from the checkpoint. Gives the id of the stream, which its
    checkpoint keeps."""
    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return str(query.id)


def _folder(spark: SparkSession, batch_id: int) -> str:
    """A batch's own folder: of the stream that its checkpoint names, so another stream never overwrites it."""
    return f"run={spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={batch_id}"


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per stream and batch, overwritten when a batch is repeated after a failure, so nothing is counted twice."""
    rows.write.mode("overwrite").parquet(f"{path}/{_folder(rows.sparkSession, batch_id)}")


def ingest_stream(stream: DataFrame, table: str, counts: str, checkpoint: str, ingest_ts,
                  rules: AdmissionRules | None = None, by: str = "source") -> None:
    """Each micro-batch is admitted against everything that the table holds, whatever has written it, appended and counted.

    The table's links are kept in an index beside it (``<table>-links``), which reads only files that have come since the last
    batch; a batch reads only the index buckets of its own links. A repeated batch leaves its own earlier output out of what counts
    as stored.
    """
    index = LinkIndex(stream.sparkSession, table, table.rstrip("/") + "-links")

    def sink(batch: DataFrame, batch_id: int) -> None:
        index.sync()
        stored = index.known(batch, but=_folder(batch.sparkSession, batch_id))
        done = ingest(batch, stored, ingest_ts, rules, [by])
        _write_batch(done.postings, table, batch_id)
        _write_batch(done.counts, counts, batch_id)

    run_available(stream, sink, checkpoint)


def update_stream(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Enrichment of arriving postings: ``work`` turns a micro-batch into updates by id. At least once, and repeated
    batches overwrite themselves."""
    run_available(stream, lambda batch, n: _write_batch(work(batch), out, n), checkpoint)


def unique_links(stream: DataFrame, ts: str = "ts", link: str = "link", delay: str = "1 hour") -> DataFrame:
    """One event per link within the watermark, any of a batch's; later than the watermark is dropped. ``first_links`` keeps the
    first."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([link])


def status_windows(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 day",
                   delay: str = "1 hour") -> DataFrame:
    """Counters per event-time window and keys; works on a stream and on a table."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, delay) if events.isStreaming else rows
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("cnt")).select(
        F.col("w.start").alias("window_start"), *keys, "cnt")


def latest_windows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest count of every window written in update mode."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("window_start", *keys).agg(F.max_by("cnt", "batch").alias("cnt"))


def status_windows_stream(stream: DataFrame, keys: list[str], out: str, checkpoint: str, **kw) -> DataFrame:
    """Runs the windowed counters over what has arrived and returns the newest count of every window."""
    run = run_available(status_windows(stream, keys, **kw), lambda b, n: _write_batch(b, out, n), checkpoint, "update")
    return latest_windows(stream.sparkSession, f"{out}/run={run}", keys)


def fresh_only(df: DataFrame, now: Column, hours: int | None, ts: str = "posted_date") -> DataFrame:
    """Rows at most so many hours old; no bound keeps all, and undated rows go as soon as there is one."""
    if not hours:
        return df
    return df.where(F.col(ts).cast("timestamp") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


# ------------------------------------------------------------------ saved postings from toggle and remove events
def saved_set(events: DataFrame, keys: list[str], ts: str = "ts", action: str = "action", row_id: str = "event_id"
              ) -> DataFrame:
    """Keys saved after all events, with the time of the last toggle: odd toggles since the last remove.

    Events equal in time go by row id. The last remove per key is an aggregate and comes back to the events by a salted
    join, so a key with a third of all events is spread over tasks and combined again by the second aggregate.
    """
    return _toggled(events, keys, ts, action, row_id).where("n % 2 = 1").select(*keys, F.col("last").alias("saved_at"))


def _toggled(events: DataFrame, keys: list[str], ts: str, action: str, row_id: str) -> DataFrame:
    """Per key that has events: whether there was a remove, the toggles since the last one, and the time of the last of them."""
    at = F.struct(F.col(ts), F.col(row_id))
    cleared = events.where(F.col(action) == "remove").groupBy(*keys).agg(F.max(at).alias("__cleared"))
    rows = salted_lookup(events, cleared, keys, [row_id])
    live = (F.col(action) == "toggle") & (F.col("__cleared").isNull() | (at > F.col("__cleared")))
    return rows.groupBy(*keys).agg(F.count_if(F.col("__cleared").isNotNull()).alias("removes"), F.count_if(live).alias("n"),
                                   F.max(F.when(live, F.col(ts))).alias("last"))


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved_set_from_stream(stream: DataFrame, keys: list[str], out: str, checkpoint: str, ts: str = "ts", action: str = "action",
                          row_id: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Runs the saved set over what has arrived and returns the keys that are saved now.

    Each key's state is kept by the stream, so no micro-batch reads what earlier ones have written. Events may arrive in any order
    within the watermark; later ones are dropped.
    """
    with _keyed_state(stream.sparkSession):
        run = run_available(state.saved_keys(stream, keys, ts, action, row_id, delay), lambda b, n: _write_batch(b, out, n), checkpoint,
                            "update")
    spark, own = stream.sparkSession, f"{out}/run={run}"
    rows = spark.read.option("basePath", own).parquet(own)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("saved", "saved_at"), "batch").alias("s"))
    return last.where("s.saved").select(*keys, F.col("s.saved_at").alias("saved_at"))


def first_links(stream: DataFrame, out: str, checkpoint: str, order: list[str], link: str = "link", ts: str = "ts",
                delay: str = "1 hour") -> DataFrame:
    """Appends the first row of every link, by ``order`` (the event time first; it tells rows apart), as soon as the watermark has
    passed it, and returns all that the stream has given so far. ``late_links`` counts the rows that came too late."""
    columns = stream.columns
    with _keyed_state(stream.sparkSession):
        firsts = state.first_rows(stream, link, order, ts, delay)
        run = run_available(firsts, lambda b, n: _write_batch(b, out, n), checkpoint)
    spark, own = stream.sparkSession, f"{out}/run={run}"
    return spark.read.option("basePath", own).parquet(own).where("late = 0").select(*columns)


def late_links(spark: SparkSession, out: str) -> DataFrame:
    """How many rows came later than the watermark or than their link's first row was given."""
    return spark.read.option("basePath", out).parquet(out).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
