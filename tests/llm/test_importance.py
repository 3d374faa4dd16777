"""Importance resampling against plain dictionaries of features."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from jobspan.llm import importance as imp
from tests.llm.test_operators import docs, empty  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(words, runs=2):
    return [" ".join(words[i:i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, runs=2, buckets=10_000, percent=25, least=20, seed=7):
    """(doc_id, n_words, n_features, weight, score, rank), sorted as text."""
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs_of(words_of(t), runs)]
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(of(text))
    for text in target:
        t.update(of(text))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, text in rows:
        found = of(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words_of(text)), len(found), weight, weight + noise))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(long[:percent * len(long) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"runs": 1, "buckets": 7}, {"runs": 3, "buckets": 50, "percent": 100, "least_words": 1, "seed": 2}])
def test_equals_brute_force(spark, docs, how):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = ["Some words that count", None, "", rows[4][1] or "", "é ñ ß 漢字"]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    names = {"least_words": "least"}
    want = brute(rows, target, **{names.get(k, k): v for k, v in how.items()})
    assert got(imp.resample(docs, table, **how)) == want


def test_empty_tables(spark, docs):  # noqa: F811
    none = spark.createDataFrame([], "text string")
    assert imp.resample(empty(docs), none).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(imp.resample(docs, none)) == brute(rows, [])


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "the same words " * 10, 0) for i in range(50)]
    df = spark.createDataFrame([(i, 30, 59, 0) for i, _, _ in rows], "doc_id long, n_words long, n_features long, weight long")
    ranked = imp.draw(df, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 26))
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)


def test_repeated_rows_have_ranks_of_their_own(spark):
    df = spark.createDataFrame([(7, 30, 59, 5)] * 40 + [(None, 30, 59, 5)] * 40, "doc_id long, n_words long, n_features long, weight long")
    ranks = [r["rank"] for r in imp.draw(df, percent=50).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 41)) and ranks.count(None) == 40


def test_features_of_runs_and_long_texts():
    text = "Aa b-C " * 100_000 + "\x00 \x7f é9"
    n_words, found = imp.features(pa.array([None, text, "", "x"]), 3, 1 << 30)
    assert n_words.tolist() == [0, 300_001, 0, 1]
    words = words_of(text)
    for k, (of, bucket) in enumerate(found, 1):
        want = [zlib.crc32(" ".join(words[i:i + k]).encode()) % (1 << 30) for i in range(len(words) - k + 1)]
        assert bucket[of == 1].tolist() == want and (of == 3).sum() == (k == 1)


def test_towards_the_target(spark):
    """Documents of the target's kind are drawn far more often than others."""
    rows = [(i, " ".join(("alpha beta gamma delta" if i % 10 == 0 else "one two three four").split() * 10)) for i in range(500)]
    table = spark.createDataFrame([("alpha beta gamma delta " * 5,)] * 20, "text string")
    drawn = imp.resample(spark.createDataFrame(rows, "doc_id long, text string"), table, percent=10).where("rank is not null").collect()
    assert len(drawn) == 50 and sum(r.doc_id % 10 == 0 for r in drawn) > 45
