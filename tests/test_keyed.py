"""Tables by key: what is read and what is rewritten."""
import glob
import os

from pyspark.sql import functions as F

from jobspan.operators.keys import apply_updates
from jobspan.sources.keyed import KeyedTable, hashed, ranged


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def test_update_rewrites_only_touched_ranges(spark, tmp_path):
    base = spark.range(1000).select("id", (F.col("id") * 2).alias("v"), F.lit("old").alias("s"))
    table = KeyedTable(spark, str(tmp_path / "t"), "id", ranged(100)).write(base.repartition(7))
    before = files(table.path)
    assert len(before) == 10
    updates = spark.createDataFrame([(5, -1, "new"), (7, None, None), (305, -2, "x"), (399, 0, None), (5000, 1, "nobody")], "id long, v long, s string")
    for cols, only_found in ((["v"], False), (["s"], True)):
        want = apply_updates(table.read(), updates, "id", cols, only_found).collect()
        table.update(updates, cols, only_found)
        assert sorted(table.read().select("id", "v", "s").collect()) == sorted(want, key=lambda r: r.id)
    after = files(table.path)
    same = {f.split("part=")[1].split("/")[0] for f in before if after.get(f) == before[f]}
    assert same == {str(k) for k in range(10)} - {"0", "3"}
    table.update(updates.limit(0), ["v"])
    assert files(table.path) == after


def test_lookups_read_only_their_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", f"text {i}") for i in range(300)] + [(None, "lost")], "uri string, text string")
    table = KeyedTable(spark, str(tmp_path / "t"), "uri", hashed(50)).write(rows)
    assert table.read().count() == 300
    asked = spark.createDataFrame([("u3",), ("u3",), ("u250",), ("none",), (None,)], "uri string")
    near = table.of(asked)
    assert "PartitionFilters: [part" in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.text for r in near.join(asked.distinct(), "uri").collect()) == ["text 250", "text 3"]
    assert near.count() < 60 and table.of(asked.limit(0)).count() == 0


def test_registered_updates_read_the_written_table(spark, monkeypatch):
    """Which ids are ours is read from the table, not joined anew from all inputs at each update."""
    from jobspan.checks import admission

    read, update = [], admission.KeyedTable.update
    monkeypatch.setattr(admission.KeyedTable, "update", lambda self, rows, *a, **k: (read.extend(rows.inputFiles()), update(self, rows, *a, **k))[1])
    rows = admission.updated_parts(spark, "/root/testdata/sf0.001")
    assert read and not any("documents.parquet" in f for f in read)
    assert rows.count() == admission.updated_postings(spark, "/root/testdata/sf0.001").count()


def test_a_batch_moves_its_own_rows_alone(spark, tmp_path):
    """Keys that fall into every part still fetch no other rows."""
    rows = spark.range(3000).selectExpr("concat('u', id) as uri", "concat('text ', id) as text")
    table = KeyedTable(spark, str(tmp_path / "t"), "uri", hashed(4)).write(rows)
    asked = spark.createDataFrame([(f"u{i}",) for i in range(0, 3000, 100)] * 2 + [("none",), (None,)], "uri string")
    assert sorted(r.text for r in table.at(asked).collect()) == sorted(f"text {i}" for i in range(0, 3000, 100))
    assert table.at(asked.limit(0)).count() == 0
