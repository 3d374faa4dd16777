import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobspan.functions import scores as S
from jobspan.operators import retrieval as R
from jobspan.plans import search as Q

C = F.col("c")


def test_recency(ev):
    assert ev(S.recency_score(F.lit(0))) == 1.0
    assert ev(S.recency_score(F.lit(336))) == pytest.approx(0.5)
    assert ev(S.recency_score(F.lit(None).cast("int"))) == 0.40


def test_hours_since(ev):
    assert ev(S.hours_since(C.cast("timestamp"), "2024-01-02 00:59:59"), c="2024-01-01 00:00:00") == 24
    assert ev(S.epoch_hours(C.cast("timestamp")), c="1970-01-02 00:40:00") == 25


def test_experience(ev):
    assert ev(S.experience_score(F.lit(2), 3)) == 0.6667
    assert ev(S.experience_score(F.lit(None).cast("int"), 3)) == 0.6
    assert ev(S.experience_score(F.lit(None).cast("int"), None)) == 1.0
    assert ev(S.experience_score(F.lit(0), 0)) == 1.0


def test_skill_scores(ev):
    ten = F.array(*[F.lit(f"s{i}") for i in range(10)])
    assert ev(S.resume_skill_score(ten, ["S1", "s2", "x"])) == 0.5
    assert ev(S.resume_skill_score(F.array().cast("array<string>"), ["a"])) == 0.0
    assert ev(S.manual_skill_score(ten, ["s1", "x"])) == 0.5
    assert ev(S.manual_skill_score(ten, [])) == 1.0
    assert ev(S.manual_skill_score(F.lit(None).cast("array<string>"), ["a"])) == 0.0


def test_labels(ev):
    for hours, label in ((0, "Just posted"), (23, "Posted 23h ago"), (24, "Posted 1 day ago"), (719, "Posted 29 days ago"),
                         (720, "Posted 30+ days ago")):
        assert ev(S.posted_label(F.lit(hours))) == label
    assert ev(S.posted_label(F.lit(None).cast("int"))) == "Recently posted"
    assert ev(S.match_percent(F.lit(1.2))) == 100
    assert ev(S.match_band(F.lit(70))) == "good"


def test_query_tokens(ev):
    assert ev(S.query_tokens(C), c="Senior Python engineer with C++ and node.js") == ["python", "c++", "node.js"]


def _greedy(rows, n):
    """Plain loop: take up to the cap per source in order, then what overflowed."""
    caps, taken, chosen, over = R.source_caps(n), {}, [], []
    for rank, source in rows:
        if taken.get(source, 0) < caps.get(source, n):
            chosen.append(rank)
            taken[source] = taken.get(source, 0) + 1
        else:
            over.append(rank)
        if len(chosen) >= n:
            break
    return chosen + over[: n - len(chosen)] if len(chosen) < n else chosen


def test_source_mix_equals_loop(spark):
    rng = random.Random(5)
    cases, rows = {}, []
    for case in range(60):
        n = rng.randint(1, 12)
        data = [(i, rng.choice(["linkedin", "greenhouse", "indeed", "lever", "ashby"])) for i in range(rng.randint(0, 30))]
        cases[case] = (n, data)
        rows += [(case, r, s) for r, s in data]
    df = spark.createDataFrame(rows, "case int, rank int, source string")
    for n in range(1, 13):
        got = {}
        for r in R.diversify(df, n, [F.col("rank")], ["case"]).orderBy("case", "pool_rank").collect():
            got.setdefault(r.case, []).append(r["rank"])
        for case, (_, data) in cases.items():
            assert got.get(case, []) == _greedy(data, n)


def test_source_mix_example(spark):
    rows = [(i, "linkedin") for i in range(20)] + [(20 + i, "lever") for i in range(4)]
    df = spark.createDataFrame(rows, "rank int, source string")
    got = [r["rank"] for r in R.diversify(df, 10, [F.col("rank")]).orderBy("pool_rank").collect()]
    assert got == [0, 1, 2, 3, 4, 20, 21, 22, 23, 5]


@pytest.mark.parametrize("max_bytes", [1 << 20, 400])
def test_batch_top_k_against_brute_force(spark, max_bytes):
    rng = np.random.default_rng(3)
    items = rng.integers(-3, 4, (300, 4)).astype(float)  # small integers: many ties
    queries = rng.integers(-3, 4, (25, 4)).astype(float)
    i = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(items)], "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(queries)], "query_id long, vec array<float>")
    got = {}
    for r in R.batch_top_k(i, q, 7, max_query_bytes=max_bytes, salts=3).collect():
        got.setdefault(r.query_id, []).append((-round(r.vec_score, 10), r.id))
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = unit(queries) @ unit(items).T
    for n in range(25):
        want = sorted((-round(s, 10) + 0.0, j) for j, s in enumerate(sims[n]))[:7]
        assert [j for _, j in sorted((s + 0.0, j) for s, j in got[n])] == [j for _, j in want]


def test_rerank(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(5)], "id long, rank int")
    ids = spark.createDataFrame([([3, 1, 3, 99],)], "ids array<long>")
    assert [r.id for r in R.rerank(rows, ids, 4).orderBy("new_rank").collect()] == [3, 1, 0, 2]
    none = spark.createDataFrame([(None,)], "ids array<long>")
    assert [r.id for r in R.rerank(rows, none, 2).orderBy("new_rank").collect()] == [0, 1]


def test_parameters():
    with pytest.raises(ValueError):
        Q.Search(" ")
    with pytest.raises(ValueError):
        Q.Search("x", top_n=101)
    with pytest.raises(ValueError):
        Q.Search("x", page=11)
    with pytest.raises(ValueError):
        Q.Filters(min_years=31)
    with pytest.raises(ValueError):
        Q.check_ids([])
    with pytest.raises(ValueError):
        Q.check_question("ab")
    f = Q.filters_from_form("5", "any", "  ", True, ["sql"], Q.vocab.SEARCH_SOURCES)
    assert (f.min_years, f.max_hours_old, f.location, f.sources, f.skills) == (5, None, None, [], ["sql"])
    assert Q.filters_from_form(sources=["lever"]).sources == ["lever"]
