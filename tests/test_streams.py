import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobspan.operators.admission import admit, status_counts
from jobspan.streaming import jobs as S
from jobspan.streaming import state


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in time order over several files; a third of them on one key."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        user = 1 if rng.random() < 0.34 else rng.randint(2, 6)
        rows.append((i, 1700000000 + i * 60, user, rng.randint(1, 3), rng.choice(["toggle", "toggle", "toggle", "remove"])))
    path = str(tmp_path_factory.mktemp("events") / "e")
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, job_id long, action string")
    df = df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "job_id", "action")
    for k in range(4):
        df.where((F.col("event_id") >= k * 60) & (F.col("event_id") < k * 60 + 60)).coalesce(1).write.mode("append").parquet(path)
    return path, df, rows


def plain_saved(rows):
    saved = {}
    for _, s, user, job, action in rows:
        key = (user, job)
        if action == "remove" or key in saved:
            saved.pop(key, None)
        else:
            saved[key] = s
    return saved


def test_saved_set_is_the_plain_loop(spark, events):
    _, df, rows = events
    got = {(r.user_id, r.job_id): r.s for r in S.saved_set(df, ["user_id", "job_id"]).withColumn(
        "s", F.unix_timestamp("saved_at")).collect()}
    assert got == plain_saved(rows)


def test_saved_set_stream_over_batches(spark, events, tmp_path):
    path, df, rows = events
    stream = S.file_stream(spark, path, df.schema, 1)
    out = S.saved_set_from_stream(stream, ["user_id", "job_id"], str(tmp_path / "o"), str(tmp_path / "c"))
    got = {(r.user_id, r.job_id): r.s for r in out.withColumn("s", F.unix_timestamp("saved_at")).collect()}
    assert got == plain_saved(rows)


def test_windows_over_batches(spark, events, tmp_path):
    path, df, _ = events
    stream = S.file_stream(spark, path, df.schema, 1)
    kw = dict(width="1 hour", delay="1 day")
    got = S.status_windows_stream(stream, ["user_id", "action"], str(tmp_path / "o"), str(tmp_path / "c"), **kw)
    want = S.status_windows(df, ["user_id", "action"], **kw)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_unique_links_over_batches(spark, events, tmp_path):
    path, df, _ = events
    stream = S.file_stream(spark, path, df.schema, 1)
    S.update_stream(S.unique_links(stream, link="user_id", delay="1 day"), lambda b: b, str(tmp_path / "o"), str(tmp_path / "c"))
    got = [r.user_id for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(got) == sorted({r.user_id for r in df.collect()})


def test_ingest_stream_equals_one_batch(spark, tmp_path):
    text = "Acme builds robots. " * 10
    rows = [(i, "Acme" if i % 7 else "Dice", "Data Analyst" if i % 5 else "Nurse", text, f"u{i % 11}", "Austin", "lever" if i % 2 else "ashby")
            for i in range(60)]
    raw = spark.createDataFrame(rows, "id long, company_name string, title string, description string, link string, location string, source string")
    raw = (raw.withColumn("posted_date", F.lit(None).cast("timestamp")).withColumn("followers", F.lit(None).cast("long"))
           .withColumn("employees", F.lit(None).cast("long")))
    landed = str(tmp_path / "landed")
    for k in range(3):
        raw.where((F.col("id") >= k * 20) & (F.col("id") < k * 20 + 20)).coalesce(1).write.mode("append").parquet(landed)
    args = [str(tmp_path / p) for p in ("table", "counts", "check")]
    S.ingest_stream(S.file_stream(spark, landed, raw.schema, 1), *args, "2024-01-01")
    want = status_counts(admit(raw, raw.limit(0)), ["source"])
    cols = [c for c in want.columns if c != "source"]
    counts = spark.read.parquet(args[1]).groupBy("source").agg(*[F.sum(c).alias(c) for c in cols])
    assert sorted(map(tuple, counts.select("source", *cols).collect())) == sorted(map(tuple, want.collect()))
    links = [r.link for r in spark.read.parquet(args[0]).collect()]
    assert len(links) == len(set(links))
    # nothing new arrives: a further run changes nothing
    S.ingest_stream(S.file_stream(spark, landed, raw.schema, 1), *args, "2024-01-01")
    assert spark.read.parquet(args[0]).count() == len(links)


def test_fresh_only(spark):
    df = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, "2023-01-01 00:00:00"), (3, None)], "id long, t string").select(
        "id", F.col("t").cast("timestamp").alias("posted_date"))
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert [r.id for r in S.fresh_only(df, now, 24).collect()] == [1]
    assert S.fresh_only(df, now, 0).count() == 3


def test_another_stream_keeps_what_is_stored(spark, tmp_path):
    """A second stream, with a checkpoint of its own, into the same table neither loses nor repeats a row."""
    from jobspan import schemas
    from jobspan.operators.admission import AdmissionRules

    table, counts = str(tmp_path / "table"), str(tmp_path / "counts")
    spark.createDataFrame([("old",)], "link string").write.parquet(table)
    rules = AdmissionRules(title_keywords=["data"], us_keywords=["usa"], min_followers=0, blocked=["nobody"])
    for run, links in enumerate([["a", "b", "old"], ["a", "c", None]]):
        rows = spark.createDataFrame(
            [(10 * run + k, x, "Data person", "Acme", "usa", 5) for k, x in enumerate(links)],
            "id long, link string, title string, company_name string, location string, followers int")
        raw = schemas.conform(rows, schemas.RAW_POSTING, ["id"])
        raw.write.parquet(str(tmp_path / f"in{run}"))
        stream = S.file_stream(spark, str(tmp_path / f"in{run}"), raw.schema)
        S.ingest_stream(stream, table, counts, str(tmp_path / f"check{run}"), F.lit("2024-01-01").cast("timestamp"), rules)
    kept = spark.read.schema("link string").option("recursiveFileLookup", True).parquet(table)
    assert sorted(r.link for r in kept.collect()) == ["a", "b", "c", "old"]
    totals = spark.read.parquet(counts).agg(*[F.sum(c).alias(c) for c in ("inserted", "duplicate", "error")]).first()
    assert tuple(totals) == (3, 2, 1)


def _raw(spark, rows):
    from jobspan import schemas

    df = spark.createDataFrame([(i, x, "Data person", "Acme", "usa", 5) for i, x in rows],
                               "id long, link string, title string, company_name string, location string, followers int")
    return schemas.conform(df, schemas.RAW_POSTING, ["id"])


def _rules():
    from jobspan.operators.admission import AdmissionRules

    return AdmissionRules(title_keywords=["data"], us_keywords=["usa"], min_followers=0, blocked=["nobody"])


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The last batch is stored but not yet committed when the run ends; the next run repeats it."""
    import os

    landed, table, counts, check = (str(tmp_path / p) for p in ("landed", "table", "counts", "check"))
    for k, links in enumerate((["a", "b"], ["b", "c", None], ["c", "d", "a"])):
        _raw(spark, [(10 * k + j, x) for j, x in enumerate(links)]).coalesce(1).write.mode("append").parquet(landed)
    schema = spark.read.parquet(landed).schema
    run = lambda: S.ingest_stream(S.file_stream(spark, landed, schema, 1), table, counts, check, "2024-01-01", _rules())
    stored = lambda p: sorted(map(str, spark.read.option("recursiveFileLookup", True).parquet(p).collect()))
    run()
    before = stored(table), stored(counts)
    assert sorted(r.link for r in spark.read.option("recursiveFileLookup", True).parquet(table).collect()) == ["a", "b", "c", "d"]
    for batch in (2, 1):
        for name in (f"{batch}", f".{batch}.crc"):
            if os.path.exists(f"{check}/commits/{name}"):
                os.remove(f"{check}/commits/{name}")
    run()
    assert (stored(table), stored(counts)) == before


def test_link_index_reads_only_the_asked_buckets(spark, tmp_path):
    from jobspan.streaming.link_index import LinkIndex

    table = str(tmp_path / "table")
    index = LinkIndex(spark, table, str(tmp_path / "index"), buckets=32)
    index.sync()  # no table yet
    assert index.known(spark.createDataFrame([("x",)], "link string")).count() == 0
    links = [(f"u{i}",) for i in range(500)]
    spark.createDataFrame(links[:300], "link string").write.parquet(f"{table}/run=r/batch=0")
    spark.createDataFrame([*links[300:], (None,), ("u1",)], "link string").write.parquet(f"{table}/run=r/batch=1")
    index.sync()
    index.sync()
    asked = spark.createDataFrame([("u7",), ("u7",), ("u400",), ("new",), (None,)], "link string")
    known = index.known(asked)
    assert sorted(r.link for r in known.collect()) == ["u400", "u7"]
    assert sorted(r.link for r in index.known(asked, but="run=r/batch=1").collect()) == ["u7"]
    assert index.known(spark.createDataFrame(links, "link string")).count() == 500
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    # Files of one more batch are all that the next pass reads.
    spark.createDataFrame([("late",)], "link string").write.parquet(f"{table}/run=s/batch=0")
    index.sync()
    passes = spark.read.parquet(f"{index.path}/links").groupBy("sync").count().collect()
    assert {r["sync"]: r["count"] for r in passes} == {0: 501, 1: 1}


def _event_files(spark, path, batches):
    """One file per batch of (event_id, minute, key, action)."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, m long, link string, action string")
        df.select("event_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "link", "action").coalesce(1).write.parquet(f"{path}/{k}")
    return spark.read.parquet(f"{path}/0").schema


def _grown(path, k):
    """A folder that holds the first k files, as links."""
    import glob
    import os

    os.makedirs(f"{path}/in", exist_ok=True)
    for j in range(k):
        for f in glob.glob(f"{path}/{j}/*.parquet"):
            to = f"{path}/in/{j}.parquet"
            if not os.path.exists(to):
                os.link(f, to)
    return f"{path}/in"


def test_saved_set_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(6)
    events = [(i, i + rng.randint(0, 40), rng.choice(["a", "b", "c"]), rng.choice(["toggle", "toggle", "remove"])) for i in range(300)]
    rng.shuffle(events)
    events.sort(key=lambda e: (e[1] // 60, rng.random()))  # out of order by an hour at most
    path = str(tmp_path / "e")
    schema = _event_files(spark, path, [events[k:k + 50] for k in range(0, 300, 50)])
    for upto in (2, 3, 6):
        stream = S.file_stream(spark, _grown(path, upto), schema, 1)
        got = S.saved_set_from_stream(stream, ["link"], str(tmp_path / "o"), str(tmp_path / "c"), delay="2 hours")
        saved = {}
        for i, m, x, action in sorted(events[:50 * upto], key=lambda e: (e[1], e[0])):
            saved = {k: v for k, v in saved.items() if k != x} if action == "remove" or x in saved else {**saved, x: m}
        assert {r.link: r.m for r in got.withColumn("m", F.expr("unix_timestamp(saved_at) div 60")).collect()} == saved


def test_late_toggles_are_dropped(spark, tmp_path):
    batches = [[(1, 100, "a", "toggle"), (2, 1000, "b", "toggle")], [(3, 1001, "b", "remove")], [(4, 200, "a", "remove"), (5, 1100, "c", "toggle")]]
    schema = _event_files(spark, str(tmp_path / "e"), batches)
    stream = S.file_stream(spark, _grown(str(tmp_path / "e"), 3), schema, 1)
    got = S.saved_set_from_stream(stream, ["link"], str(tmp_path / "o"), str(tmp_path / "c"), delay="10 minutes")
    assert sorted(r.link for r in got.collect()) == ["a", "c"]


def test_first_links_wait_for_the_watermark(spark, tmp_path):
    batches = [[(1, 50, "a", "x"), (2, 40, "b", "x"), (3, 55, "a", "x")], [(4, 45, "a", "x"), (5, 70, "c", "x")],
               [(6, 500, "d", "x"), (7, 44, "a", "x")], [(8, 30, "b", "x"), (9, 30, "e", "x"), (10, 501, "a", "x"), (11, 499, "d", "x")]]
    path, out, check = (str(tmp_path / p) for p in "eoc")
    schema = _event_files(spark, path, batches)
    run = lambda k: sorted((r.link, r.event_id) for r in S.first_links(
        S.file_stream(spark, _grown(path, k), schema, 1), out, check, ["ts", "event_id"], delay="30 minutes").collect())
    assert run(1) == []  # nothing is certain before the watermark has passed a row
    assert run(3) == [("a", 7), ("b", 2), ("c", 5)]  # 44 came out of order, but in time; d may still change
    assert run(4) == [("a", 7), ("b", 2), ("c", 5)]
    assert S.late_links(spark, out).first()[0] == 3  # 8, 9 and 10


def test_saved_keys_of_a_bucket_share_one_value(spark, tmp_path, monkeypatch):
    """A task sends a row a bucket, and keys of any kind come back as they were."""
    monkeypatch.setattr(state, "BUCKETS", 3)
    rng = random.Random(8)
    links = [None, "", 'a"b', "a,b", "c\\d", *(f"k{i}" for i in range(20))]
    events = [(i, i, rng.choice(links), rng.choice([None, 0, 86399]), rng.choice(["toggle", "toggle", "remove"])) for i in range(400)]
    path = str(tmp_path / "e")
    for k in range(0, 400, 100):
        df = spark.createDataFrame(events[k:k + 100], "event_id long, m long, link string, s long, action string").select(
            "event_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "link", F.timestamp_seconds("s").alias("at"),
            F.encode("link", "UTF-8").alias("raw"), "action")
        df.coalesce(1).write.mode("append").parquet(path)
    got = S.saved_set_from_stream(S.file_stream(spark, path, df.schema, 1), ["link", "at", "raw"], str(tmp_path / "o"), str(tmp_path / "c"), delay="1 day")
    assert {(r.link, r.s, None if r.raw is None else bytes(r.raw)): r.m for r in got.withColumns(
        {"m": F.expr("unix_timestamp(saved_at) div 60"), "s": F.unix_timestamp("at")}).collect()} == {
            (x, s, None if x is None else x.encode()): m for (x, s), m in plain_saved([(i, m, x, s, a) for i, m, x, s, a in events]).items()}
    rows = [(f"k{i % 7}", i % 7 % 3, i, i, "remove" if i % 5 == 0 else "toggle") for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["name", "bucket", "t", "id", "action"])
    out = [x for b in state._toggled_batches(iter([batch.slice(0, 20), batch.slice(20)])) for x in b.to_pylist()]
    assert [x["bucket"] for x in out] == [0, 1, 2]
    for x in out:
        for name, ct, cid, toggles in state._unpacked(*(x[c] for c in ("names", "ct", "cid", "sizes", "times", "ids"))):
            own = [r for r in rows if r[0] == name]
            last = max(r[2] for r in own if r[4] == "remove")
            assert (ct, cid, toggles) == (last, last, [(r[2], r[3]) for r in own if r[2] > last])
