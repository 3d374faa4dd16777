"""Keyed state of streams: saved postings from toggles and removes, and the first row of every link.

Both put a reduction of each Arrow batch before the state, so a key with a third of all events sends a few rows per task, and both
hold only what the watermark still allows to change.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# A processor is also loaded by a worker on the driver, which knows no shipped package: it travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


# ------------------------------------------------------------------ saved postings
BUCKETS = 1 << 14  # of keys, each with one value in the state; a checkpoint must go on with the number that it began with
PORTION = 1 << 20  # events that a task reduces at once
_PARTS = "bucket long, names array<string>, ct array<long>, cid array<long>, sizes array<long>, times array<long>, ids array<long>"


class SavedKeys(StatefulProcessor):
    """Odd toggles since the last remove, of a bucket of keys at a time: a row or a call to the state costs more than a key's own work.
    A key has its last remove, the toggles that no event can precede any more, as a number and a time, and those newer than the
    watermark, ``sizes`` of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "names array<string>, ct array<long>, cid array<long>, n array<long>, last array<long>, "
                                                 "sizes array<long>, times array<long>, ids array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held, changed = {}, {}
        for name, ct, cid, n, last, toggles in _unpacked(*(self.held.get() or [()] * 8)):
            held[name] = [None if ct is None else (ct, cid), n, last, toggles]
        for row in rows:
            for name, ct, cid, toggles in _unpacked(row.names, row.ct, row.cid, row.sizes, row.times, row.ids):
                now = changed.get(name)
                if now is None:
                    now = changed[name] = held.setdefault(name, [None, 0, None, ()])
                    now[3] = set(now[3])
                if ct is not None and ct >= mark and (now[0] is None or (ct, cid) > now[0]):
                    now[:3] = (ct, cid), 0, None
                now[3].update(x for x in toggles if x[0] >= mark)
        saved = []
        for now in changed.values():
            cleared, n, last, toggles = now
            toggles = {x for x in toggles if cleared is None or x > cleared}
            count, times = n + len(toggles), [x[0] for x in toggles] + ([] if last is None else [last])
            settled = {x for x in toggles if x[0] < mark}
            if settled:
                n, last = n + len(settled), max([x[0] for x in settled] + ([] if last is None else [last]))
            now[1:] = n, last, sorted(toggles - settled)
            saved.append(max(times) if count % 2 else None)
        at = [x[0] or (None, None) for x in held.values()]
        open_ = [y for x in held.values() for y in x[3]]
        self.held.update(([*held], [x[0] for x in at], [x[1] for x in at], *([x[k] for x in held.values()] for k in (1, 2)),
                          [len(x[3]) for x in held.values()], [x[0] for x in open_], [x[1] for x in open_]))
        yield Row(names=[*changed], saved_us=saved)

    def close(self) -> None:
        pass


def _unpacked(*columns) -> Iterator[tuple]:
    """Of lists of a value a key, and at the end the number of its toggles, all times and all ids: its values and its toggles."""
    *values, sizes, times, ids = columns
    at = 0
    for *own, size in zip(*values, sizes):
        yield *own, [*zip(times[at:at + size], ids[at:at + size])]
        at += size


def _toggled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bucket of a portion of events: of each key its last remove and the toggles after it."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PORTION:
            yield _toggled(held)
            held, n = [], 0
    if n:
        yield _toggled(held)


def _toggled(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    columns = [c.combine_chunks() for c in pa.Table.from_batches(batches).columns]
    names = columns[0].dictionary_encode()
    bucket, key, t, i = (c.to_numpy() for c in (columns[1], names.indices, *columns[2:4]))
    removes = pc.equal(columns[4], "remove").to_numpy(zero_copy_only=False)
    order = np.lexsort((removes, i, t, key, bucket))  # a toggle at the time and id of a remove is before it
    bucket, key, t, i, removes = (c[order] for c in (bucket, key, t, i, removes))
    starts = np.flatnonzero(np.diff(key, prepend=-1) | np.diff(bucket, prepend=-1))
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    last = np.maximum.reduceat(np.where(removes, np.arange(len(key)), -1), starts)  # place of each key's last remove
    live = ~removes & (np.arange(len(key)) > last[of])
    sizes = np.bincount(of[live], minlength=len(starts))
    firsts = np.flatnonzero(np.diff(bucket[starts], prepend=-1))  # of the keys of a bucket
    by_key = pa.array(np.append(firsts, len(starts)), pa.int32())
    by_toggle = pa.array(np.concatenate([[0], np.cumsum(sizes)])[by_key.to_numpy()], pa.int32())
    lists = [(by_key, names.dictionary.take(pa.array(key[starts]))), *((by_key, pa.array(c[last], mask=last < 0)) for c in (t, i)),
             (by_key, pa.array(sizes)), *((by_toggle, pa.array(c[live])) for c in (t, i))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts[firsts]]), *(pa.ListArray.from_arrays(*x) for x in lists)],
                                      names=["bucket", "names", "ct", "cid", "sizes", "times", "ids"])


def _name(df: DataFrame, keys: list[str]) -> Column:
    """A key as one text, in any session's time zone."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        return (F.hex(c) if isinstance(kind, T.BinaryType) else F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.col(c)).cast("string")
    return F.to_json(F.array(*[text(c) for c in keys]))


def _values(df: DataFrame, keys: list[str], name: Column) -> list[Column]:
    """The columns of a key from its name."""
    def value(c: str, x: Column) -> Column:
        kind = df.schema[c].dataType
        return F.unhex(x) if isinstance(kind, T.BinaryType) else F.timestamp_micros(x.cast("long")) if isinstance(kind, T.TimestampType) else x.cast(kind)
    return [value(c, F.from_json(name, "array<string>")[k]).alias(c) for k, c in enumerate(keys)]


def saved_keys(events: DataFrame, keys: list[str], ts: str, action: str, row_id: str, delay: str) -> DataFrame:
    """(keys, saved, saved_at) of every key that a micro-batch has changed, as a stream in update mode. An event later than the
    watermark is dropped; the order in which others arrive does not matter."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rows = events.where(F.col(action).isin("toggle", "remove")).select(
        _name(events, keys).alias("name"), micros(ts).alias("t"), F.col(row_id).cast("long").alias("id"), F.col(action).alias("action"))
    rows = rows.select("name", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).alias("bucket"), "t", "id", "action")
    state = rows.mapInArrow(_toggled_batches, _PARTS).groupBy("bucket").transformWithState(
        SavedKeys(), "names array<string>, saved_us array<long>", "Update", "EventTime")
    each = state.select(F.explode(F.arrays_zip("names", "saved_us")).alias("x"))
    return each.select(*_values(events, keys, F.col("x.names")), F.col("x.saved_us").isNotNull().alias("saved"),
                       F.timestamp_micros("x.saved_us").alias("saved_at"))


# ------------------------------------------------------------------ first rows
class FirstRow(StatefulProcessor):
    """Holds the earliest row of a key until the watermark has passed its time, then gives it; later rows are only counted."""

    def __init__(self, row: T.StructType, order: list[str]):
        self.row, self.order = row, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", self.row)
        self.done = handle.getValueState("done", "yes boolean")

    def _place(self, row) -> tuple:
        return row["__t"], *(row[c] for c in self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        closed = self.done.exists()
        held = None if closed or not self.first.exists() else Row(*self.row.names)(*self.first.get())
        old, late = held, 0
        for row in rows:
            if closed or row["__t"] < mark:
                late += row["__n"]
            elif held is None or self._place(row) < self._place(held):
                held = row
        if held is not old:
            self.first.update(tuple(held[c] for c in self.row.names))
            # A timer at an earlier time than the one before; that one finds the row given.
            self.handle.registerTimer(held["__t"] // 1000 + 1)
        if late:
            yield Row(row=None, late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.done.exists():
            self.done.update((True,))
            row = Row(*self.row.names)(*self.first.get())
            self.first.clear()
            yield Row(row=row, late=0)

    def close(self) -> None:
        pass


def _first_batches(batches: Iterator[pa.RecordBatch], order: list[str], key: str) -> Iterator[pa.RecordBatch]:
    """The earliest row per key of an Arrow batch, with the number of rows that it stands for."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).append_column("__row", pa.array(range(batch.num_rows), pa.int64()))
        table = table.sort_by([(c, "ascending") for c in [*order, "__row"]])
        best = table.group_by(key, use_threads=False).aggregate([("__row", "first"), ("__row", "count")])
        rows = batch.take(best["__row_first"].combine_chunks())
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], best["__row_count"].combine_chunks().cast(pa.int64())], names=batch.schema.names)


def first_rows(stream: DataFrame, key: str, order: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of every key by event time and ``order``, once no earlier one can come, with ``late`` 0; and rows that have but a
    number in ``late``: of those that came later than the watermark or after their key's first row was given. Together with the time,
    ``order`` tells rows apart."""
    times = [f.name for f in stream.schema if f.dataType.typeName().startswith("timestamp")]
    order = [c for c in order if c != ts]
    # Times travel as microseconds, which need no time zone.
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rows = rows.withColumns({"__t": micros(ts), "__n": F.lit(1).cast("long")}).withColumns({c: micros(c) for c in times})
    # The watermark sees every event; the reduced rows are not filtered by it, so that late ones are counted.
    parts = rows.mapInArrow(partial(_first_batches, order=["__t", *order], key=key), rows.schema)
    out = T.StructType([T.StructField("row", rows.schema), T.StructField("late", T.LongType())])
    found = parts.groupBy(key).transformWithState(FirstRow(rows.schema, order), out, "Append", "EventTime")
    back = lambda f: F.timestamp_micros(F.col("row")[f.name]).cast(f.dataType) if f.name in times else F.col("row")[f.name]
    return found.select(*[back(f).alias(f.name) for f in stream.schema], "late")
