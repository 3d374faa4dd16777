"""Places over all rows."""
from pyspark.sql import functions as F

from jobspan.operators.retrieval import placed


def test_placed_numbers_all_rows(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("age"))
    got = placed(rows, [F.asc_nulls_last("age"), F.col("id")]).collect()
    want = sorted(rows.collect(), key=lambda r: (r.age is None, r.age or 0, r.id))
    assert [(r.id, r.place) for r in sorted(got, key=lambda r: r.place)] == [(r.id, k) for k, r in enumerate(want, 1)]
