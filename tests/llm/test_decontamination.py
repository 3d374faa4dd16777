"""Edited copies of test items that stand beside exact ones."""
import random

import numpy as np

from jobspan.llm import decontaminate
from tests.llm.test_operators import prose


def test_every_fifth_word_replaced_beside_an_exact_copy(spark):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (16, 16, 25, 38, 60)]
    rows = []
    for k, t in enumerate(items):
        rows.append((k, prose(rng, 60) + "\n" + t + "\n" + prose(rng, 60)))
        for every in (4, 5, 6):
            for start in range(every):
                words = [f"zz{i}" if i % every == start else w for i, w in enumerate(t.split())]
                rows.append((1000 * every + 100 * start + k, prose(rng, 60) + "\n" + " ".join(words) + "\n" + prose(rng, 60)))
    rows += [(90_000 + i, prose(rng, 200)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, tests).collect()}
    want = set()
    for i, t in rows:
        for k, item in enumerate(items):
            vocabulary = {w: n for n, w in enumerate(sorted({*t.split(), *item.split()}))}
            best = decontaminate.smith_waterman(*(np.array([vocabulary[w] for w in x.split()]) for x in (item, t)))
            if best[0] >= len(item.split()):
                want.add((i, k))
    assert len(want) == 5 * 16 and got.keys() == want


def test_many_seeds_in_a_long_text(spark):
    rng = random.Random(13)
    item = prose(rng, 20)
    head = " ".join(item.split()[:4])
    text = " ".join([head] * 500) + " " + item + " " + " ".join([head] * 500)
    docs = spark.createDataFrame([(1, text), (2, " ".join([head] * 500))], "doc_id long, text string")
    tests = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, tests).collect()
    assert [(r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in got] == [(1, 7, 1.0, 2000, 2020)]
