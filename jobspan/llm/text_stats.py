"""Statistics of whole texts as built-in expressions: one narrow pass in the JVM, no Python.

Words are runs of characters other than ASCII white space. A null text has no words.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspan.functions.text import let

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8  # words

# What classifiers may read: shares, so that the length of a text alone decides nothing but through log_words.
FEATURES = ["log_words", "mean_word", "symbols_per_word", "marks_per_word", "upper_share", "digit_share", "distinct_share",
            "repeat_share", "dup_line_share", "words_per_line"]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, which the optimizer does not merge with what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _pairs(hashes: Column, step: int) -> Column:
    """Each element hashed with the one ``step`` places on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows that are found twice or more: neighbours after sorting by (hash, place), then their places merged."""
    placed = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p")))
    same = lambda s, i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
    twice = let(placed, lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)))
    places = F.array_sort(F.transform(twice, lambda x: x["p"]))
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and FEATURES (double, zero where
    there are no words).

    Windows are compared by 64-bit hashes: in a text of a million words two different ones collide with a chance of 1 in 30
    million.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    df = _once(df, words=F.array_remove(F.split("text", SPACE + "+"), ""),
               lines=F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _once(df, h1=F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of one word, of two, four and eight
        df = _once(df, **{f"h{2 * step}": _pairs(F.col(f"h{step}"), step)}).drop(f"h{step}")
    only = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", ""))
    repeated = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), _covered(F.col("h8"))).otherwise(0)
    counts = {
        "n_words": F.size("words"), "word_chars": F.length(F.array_join("words", "")), "n_symbols": only("#*$%&|<>"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": repeated,
        "n_marks": only("!?"), "n_upper": only(r"\p{Lu}"), "n_digits": only("0-9"),
        "n_distinct": F.size(F.array_distinct("words")), "n_lines": F.size("lines")}
    df = _once(df, **{k: v.cast("long") for k, v in counts.items()})
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.log1p("n_words").alias("log_words"), per("word_chars", "n_words").alias("mean_word"),
        per("n_symbols", "n_words").alias("symbols_per_word"), per("n_marks", "n_words").alias("marks_per_word"),
        per("n_upper", "word_chars").alias("upper_share"), per("n_digits", "word_chars").alias("digit_share"),
        per("n_distinct", "n_words").alias("distinct_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_words", "n_lines").alias("words_per_line"))


def labelled(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Statistics of the rows with a label, as ``label`` (the smallest, if an id has several)."""
    of = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.min(label_col).cast("int").alias("label"))
    return stats.join(of, "doc_id")
