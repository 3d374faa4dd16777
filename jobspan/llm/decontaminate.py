"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of an item is a seed, so any copy that keeps n words in a row holds one, whatever other copies the corpus has and
however frequent the n-gram is. Around the seeds the words that item and passage share are counted, which bounds the score; where
the bound allows it, the passage is aligned with the item, which scores edited and paraphrased copies too. Test items come in
blocks of a checked size that every task holds; more items mean more passes over the corpus, and the same results.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import portions, stored

# Blanks for ASCII other than letters and digits; the rest, lower-cased before, is part of words.
_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def smith_waterman(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1):
    """(score, matched words, item start, item end, passage start, passage end) of the best local alignment of two id sequences.

    A row of the table is one numpy pass: a gap along the row is a running maximum. Equal scores: the first cell.
    """
    width = len(passage)
    slope = -gap * np.arange(width + 1)
    table = np.zeros((len(item) + 1, width + 1), np.int32)
    for i, w in enumerate(item, 1):
        diagonal = table[i - 1, :-1] + np.where(passage == w, match, mismatch)
        row = np.zeros(width + 1, np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, table[i - 1, 1:] + gap), 0)
        table[i] = np.maximum.accumulate(row + slope) - slope
    i, j = (int(x) for x in np.unravel_index(table.argmax(), table.shape))
    score, end_i, end_j, matched = int(table[i, j]), i, j, 0
    while table[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (match if same else mismatch):
            i, j, matched = i - 1, j - 1, matched + bool(same)
        elif table[i, j] == table[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return score, matched, i, end_i, j, end_j


class Items:
    """A block of test items as word ids (from 1; 0 is any other word), with their n-grams numbered."""

    def __init__(self, rows: list[tuple[object, str]], n: int):
        self.n, self.names = n, [name for name, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64)
                      for _, t in rows]
        self.base = np.int64(len(self.vocabulary) + 1)
        if float(self.base) ** n > 2 ** 62:
            raise ValueError("too many different words in a block of test items: make blocks smaller")
        coded = [self.codes(w) for w in self.words]
        self.grams = np.unique(np.concatenate([*coded, np.zeros(0, np.int64)]))
        # Of each n-gram by number: the items that hold it, and where.
        flat = np.searchsorted(self.grams, np.concatenate([*coded, np.zeros(0, np.int64)]))
        order = np.argsort(flat, kind="stable")
        self.holders = np.repeat(np.arange(len(coded)), [len(c) for c in coded])[order]
        self.within = np.concatenate([*[np.arange(len(c)) for c in coded], np.zeros(0, np.int64)])[order]
        self.ends = np.searchsorted(flat[order], np.arange(len(self.grams) + 1))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram."""
        out = np.zeros(max(0, len(ids) - self.n + 1), np.int64)
        for k in range(self.n):
            out = out * self.base + ids[k:len(ids) - self.n + 1 + k]
        return out

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, n-gram's number) of the items' n-grams in a sequence of word ids."""
        known = ids > 0
        at = np.flatnonzero(np.logical_and.reduce([known[k:len(ids) - self.n + 1 + k] for k in range(self.n)])) \
            if len(ids) >= self.n else np.zeros(0, np.int64)
        codes = np.zeros(len(at), np.int64)
        for k in range(self.n):
            codes = codes * self.base + ids[at + k]
        place = np.minimum(np.searchsorted(self.grams, codes), max(0, len(self.grams) - 1))
        hit = self.grams[place] == codes if len(self.grams) else np.zeros(len(codes), bool)
        return at[hit], place[hit]

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of some texts with n zeros after each, and where each text begins (and the end)."""
        get, flat, starts = self.vocabulary.get, [], [0]
        between = [0] * self.n
        for text in texts:
            flat += [get(w, 0) for w in words_of(text)]
            flat += between
            starts.append(len(flat))
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def pointed(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, where the item would begin in the text) of every seed, sorted, equal ones once."""
        at, gram = self.found(ids)
        of = np.searchsorted(starts, at, "right") - 1
        times = self.ends[gram + 1] - self.ends[gram]
        each = np.repeat(np.arange(len(at)), times)
        holder = self.ends[gram][each] + np.arange(len(each)) - (np.cumsum(times) - times)[each]
        of, item, begin = of[each], self.holders[holder], (at - starts[of])[each] - self.within[holder]
        order = np.lexsort((begin, item, of))
        of, item, begin = of[order], item[order], begin[order]
        new = np.ones(len(of), bool)
        new[1:] = (np.diff(of) != 0) | (np.diff(item) != 0) | (np.diff(begin) != 0)
        return of[new], item[new], begin[new]


def _align(batches, shared, least: float, run: int):
    items = shared.value
    for batch in batches:
        for part in portions(batch, 1):
            ids, starts = items.read(part.column(1).to_pylist())
            of, item, begins = items.pointed(ids, starts)
            edges = np.flatnonzero((np.diff(of) != 0) | (np.diff(item) != 0)) + 1
            out = []
            for a, b in zip([0, *edges], [*edges, len(of)], strict=True):
                if a == b:
                    continue
                row, words = int(of[a]), items.words[item[a]]
                text = ids[starts[row]:starts[row + 1] - items.n]
                best = _best(words, text, begins[a:b], min(least * len(words), run))
                share = best[0] / (2 * len(words))
                if share >= least or best[1] >= run:
                    out.append((row, items.names[item[a]], share, best[1], best[4], best[5]))
            if out:
                rows, names, shares, matched, first, end = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(names), pa.array(shares, pa.float64()), pa.array(matched, pa.int64()),
                     pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "item_id", "score", "matched", "first_word", "end_word"])


def _best(item: np.ndarray, text: np.ndarray, begins: np.ndarray, needed: float):
    """The best alignment over the passages that the seeds point at; begins: where the item would begin in the text, sorted. Passages
    that share fewer words with the item than needed can't count. A run of seeds longer than four items is cut, each part with
    the margins of a single seed, so that tables stay small."""
    slack = len(item) // 2 + 1
    best, k = (0, 0, 0, 0, 0, 0), 0
    gaps = np.flatnonzero(np.diff(begins) > slack)
    while k < len(begins):
        at = np.searchsorted(gaps, k)
        last = int(gaps[at]) if at < len(gaps) else len(begins) - 1
        last = min(last, int(np.searchsorted(begins, begins[k] + 4 * len(item), "right")) - 1)
        low, high = max(0, int(begins[k]) - slack), min(len(text), int(begins[last]) + len(item) + slack)
        passage = text[low:high]
        if np.isin(item, passage).sum() >= needed:
            got = smith_waterman(item, passage)
            if got[0] > best[0]:
                best = (*got[:4], got[4] + low, got[5] + low)
        k = last + 1
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, run: int = 50,
                 block_mb: float = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, matched, first_word, end_word: documents and the test items that they hold a copy of.

    The score is the alignment's (2 a match, -1 a mismatch or gap) over that of the item with itself; a pair counts from
    ``least`` on, or from ``run`` matched words on, and the best passage of a pair is given. Words are lower-cased runs of
    letters and digits. A null or empty text holds nothing; an item of fewer than ``n`` words is no evidence and matches nothing.
    Repeated items give a row each, repeated documents too. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, matched long, first_word long, end_word long"
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sc, parts = docs.sparkSession.sparkContext, []
    for rows in _blocks(benchmark.select(item_col, item_text_col), int(block_mb * 1e6)):
        shared = sc.broadcast(Items(rows, n))  # a block's size is checked
        parts.append(stored(read.mapInArrow(partial(_align, shared=shared, least=least, run=run), schema), "contaminated"))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(items: DataFrame, most: int):
    """The benchmark's rows in blocks of at most so many bytes of text, one item at least, as Spark streams them to the driver."""
    rows, held = [], 0
    for name, text in items.toLocalIterator():
        size = len((text or "").encode())
        if rows and held + size > most:
            yield rows
            rows, held = [], 0
        rows.append((name, text))
        held += size
    if rows:
        yield rows


def without_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of a test item, with all their columns. Rows without an id can't be named and stay."""
    gone = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
