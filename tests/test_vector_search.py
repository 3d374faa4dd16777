"""Many queries against all items: block products and inverted lists against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobspan.operators.vector_search import ListIndex, batch_top_k, vector_blocks


def rows(rng, n, dim, groups=0, first=0):
    centers = rng.normal(size=(max(groups, 1), dim)) * 3
    m = rng.normal(size=(n, dim)) + (centers[rng.integers(0, groups, n)] if groups else 0)
    return [(first + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]


def exact(items, queries, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = {}
    for q, v in queries:
        sims = sorted(((round(float(unit(v) @ unit(w)), 10), i) for i, w in items), key=lambda t: (-t[0], t[1]))
        out[q] = [i for _, i in sims[:k]]
    return out


def got(df, digits=10):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (-round(r.vec_score, digits), r.id)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    items, queries = rows(rng, 700, 12, 9), rows(rng, 60, 12, 9)
    items += [(5000 + i, items[3][1]) for i in range(300)]  # a third of all items is one vector
    items += [(9000, [0.0] * 12)] * 3  # no direction, repeated rows
    frames = (spark.createDataFrame([*items, (9999, None)], "id long, embedding array<float>").repartition(5),
              spark.createDataFrame([*queries, (777, None)], "query_id long, vec array<double>"))
    return items, queries, *frames


@pytest.mark.parametrize("how", [{}, {"max_query_bytes": 960, "max_item_bytes": 9600}, {"max_kept": 50, "salts": 2}])
def test_exact_in_any_number_of_cells(data, how):
    items, queries, i, q = data
    assert got(batch_top_k(i, q, 9, **how)) == exact(items, queries, 9)


def test_fewer_items_than_asked_for(spark, data):
    items, queries, i, q = data
    few = i.where("id < 4")
    assert got(batch_top_k(few, q, 9)) == exact([r for r in items if r[0] < 4], queries, 9)
    assert batch_top_k(i.limit(0), q, 3).count() == 0 and batch_top_k(i, q.limit(0), 3).count() == 0


def test_blocks_have_one_dimension(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [1.0, 2.0]), (4, []), (5, None)], "id long, v array<float>").coalesce(1)
    assert [(r.n, r.dim) for r in vector_blocks(df, "id", "v").orderBy("at").collect()] == [(2, 1), (1, 2), (1, 0)]


def test_all_lists_are_exact(spark, data):
    items, queries, i, q = data
    index = ListIndex.build(i, 8, sample=300)
    assert index.lists.agg(F.sum("n")).first()[0] == len(items)
    for how in ({}, {"cell_bytes": 2000}, {"max_kept": 20}):
        assert got(index.top_k(q, 9, probes=8, **how)) == exact(items, queries, 9)
    again = ListIndex(spark, index.path)
    assert got(again.top_k(q, 9, probes=8)) == exact(items, queries, 9)
    assert again.top_k(q.limit(0), 9, probes=1).count() == 0


def test_recall_of_few_lists(spark):
    rng = np.random.default_rng(8)
    both = rows(rng, 4100, 16, 30)  # items and queries of the same groups
    items, queries = both[:4000], [(i, v) for i, v in both[4000:]]
    i = spark.createDataFrame(items, "id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame(queries, "query_id long, vec array<float>")
    want = exact(items, queries, 10)

    def recall(probes, **how):
        near = got(ListIndex.build(i, 40, **how).top_k(q, 10, probes=probes))
        assert all(len(near[x]) == len(set(near[x])) == 10 for x in want)
        return sum(len(set(near[x]) & set(want[x])) for x in want) / (10 * len(want))

    assert recall(4) >= 0.9 and recall(2, copies=2) >= recall(2) >= 0.7


def test_mixed_dimensions_are_refused(spark, data):
    _, _, i, q = data
    index = ListIndex.build(i, 3)
    with pytest.raises(ValueError):
        index.top_k(spark.createDataFrame([(1, [1.0])], "query_id long, vec array<float>"), 2, 1)
    with pytest.raises(ValueError):
        ListIndex.build(i.limit(0), 3)
