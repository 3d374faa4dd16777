"""Fill-in-middle against a plain version: lists of units and string slices."""
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from jobspan.llm import fill_in_middle as fim
from tests.llm.test_operators import docs, empty, sorted_rows  # noqa: F401


def brute(doc_id, text, units, seed=1, rate=90, spm=20):
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[k:k + 8], 16) for k in (0, 8, 16, 24)]
    parts = units(text)
    n = len(parts)
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text, text
    i, j = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    a, b, c = "".join(parts[:i]), "".join(parts[i:j]), "".join(parts[j:])
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(b), "<S>" + c + "<P>" + a + "<M>" + b, text
    return n, "psm", len(a), len(b), "<P>" + a + "<S>" + c + "<M>" + b, text


def run(df, **kw):
    made = fim.transform(df, **kw)
    return sorted_rows(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored()))


def test_equals_brute_force(docs):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs) == sorted(((i, *brute(i, t, list)) for i, t in rows), key=str)
    assert run(empty(docs)) == []


def test_all_forms_markers_and_odd_ends(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("<>PSM a\n\x00é🙂") for _ in range(rng.randint(0, 40))) for _ in range(400)] + \
            ["a<P>b", "<M>", "<", "<S", "ends with <", "$1 \\E \\Q"]
    rows = list(enumerate(texts))
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(((i, *brute(i, t, list)) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_other_units(spark):
    rows = [(i, t) for i, t in enumerate(["one two\nthree", "a\n\nb\n", "no end", "\n", "x\ny" * 50])]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50, seed=9)
    assert got == sorted(((i, *brute(i, t, lambda t: t.splitlines(True), 9, 100, 50)) for i, t in rows), key=str)
    # What is no sequence of units stays as it is.
    assert run(spark.createDataFrame([(1, "ab1")], "doc_id long, text string"), unit="[a-z]", rate=100) == [
        (1, 0, "plain", None, None, "ab1", "ab1")]


@pytest.mark.parametrize("unit, text", [("(?s:.)", "aé🙂\n" * 500), (r"\w+\W*", "some words, " * 300), (r"[^\n]*\n|[^\n]+", "x" * 900 + "\nb\nc")])
def test_blocks_change_nothing(unit, text):
    pattern = regex.compile(f"({unit})*")
    whole = fim.unit_ends(text, pattern)
    assert whole.tolist() == pattern.fullmatch(text).ends(1)
    for block in (1, 2, 7, 64, 1000):
        assert fim.unit_ends(text, pattern, block).tolist() == whole.tolist()
    assert fim.unit_ends("", pattern).tolist() == []


def test_very_long_text():
    """The library fails on so many repetitions at once."""
    ends = fim.unit_ends("é" * 21_000_000, regex.compile("((?s:.))*"))
    assert len(ends) == 21_000_000 and ends[-1] == 21_000_000


def test_markers_must_be_told_apart(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    for wrong in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "ab", "ac"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(df, markers=wrong)
    marks = ("|a.", "|b*", "|c\\")
    made = fim.transform(df, rate=100, markers=marks)
    assert made.select(fim.restored(markers=marks)).first()[0] == "abc"


def test_share_of_forms(spark):
    counts = dict(fim.transform(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")))
                  .groupBy("form").count().collect())
    assert abs(counts["plain"] - 400) < 80 and abs(counts["spm"] - 720) < 110
