"""The near-duplicate stage against brute-force Jaccard similarity."""
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobspan.llm import shingles, simhash
from tests.llm.test_operators import WORD, prose

SF = "/root/testdata/sf0.001"


def brute_set(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[a:a + n]) for a in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_groups(texts):
    """Id to the smallest id joined to it at five-word similarity 0.8."""
    sets, root = {i: brute_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b:
                both = len(sets[a] & sets[b])
                if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) > 0:
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: find(i) for i in texts}


def replaced(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = prose(rng, 1) + "q"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 400)) for _ in range(25)]
    out = list(base) + ["", " \n", None, "one two", "One  two", "one two three four five", "one two three four six"]
    out += [replaced(rng, t, rng.randint(1, max(1, len(t.split()) // 30))) for t in base for _ in range(3)]
    words = prose(rng, 200)
    out += [words + " " + prose(rng, rng.randint(20, 90)) for _ in range(20)]  # one long shared passage
    out += [replaced(rng, words, rng.randint(0, 3)) for _ in range(20)]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed,sample", [(1, 1), (2, 16)])
def test_groups_match_brute_force(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(shingles, "SAMPLE", sample)
    texts = corpus(seed)
    want = brute_groups(texts)
    assert len(set(want.values())) < len(texts) - 40
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("size", F.lit("clash"))
    assert {r.doc_id: r.component_id for r in shingles.groups(docs).collect()} == want
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(want.values())


def test_odd_rows(spark):
    rng = random.Random(3)
    t = prose(rng, 100)
    docs = spark.createDataFrame([(2, t), (2, t), (None, t), (1, replaced(rng, t, 1)), (None, "alone")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in shingles.keep_one(docs).collect()))) == ["1", "None", "None"]
    assert shingles.keep_one(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shingles.groups(docs, least=0)


def test_long_text_in_pieces():
    rng = random.Random(4)
    texts = [prose(rng, 300).encode(), b"", b"  a ", "é ñ 漢字 🙂 x y".encode()]
    whole, parts = shingles.of_texts(texts, 5), shingles.of_texts(texts, 5, piece=50)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(set(whole[1].tolist())) == 296 + 0 + 1 + 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stage_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == set(want.values())


def test_fingerprints_come_first(spark, monkeypatch):
    """The stage takes pairs from fingerprints: without prefixes it finds what four bits and a similarity of 0.8 join, with them the rest."""
    texts = corpus(6)
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    sets = {i: brute_set(t) for i, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4}
    alike = {(a, b) for a, b in near if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    different = {b for a, b in alike if sets[a] != sets[b]}
    assert different and near - alike
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_groups(texts)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == set(want.values())
    monkeypatch.setattr(shingles, "_star", lambda batches, ratio: iter([]))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert set(want.values()) < left < {min(i for i in sets if sets[i] == x) for x in sets.values()}
