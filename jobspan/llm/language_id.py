"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each cell is a bitmask with a bit per language, so the AND of
an n-gram's cells returns all languages that contain it in one look-up. Of a text's n-grams the hits of each language are
counted, corrected for the share of false positives that the language's filling makes likely, and the largest count decides.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobspan.llm.common import portions, stored

UNKNOWN = "und"
SALTS = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: hashes of the n-grams that hold a letter, the text that each is of, and whether each text has a letter.

    Texts are lower-cased, every run of other characters is one blank, and a blank stands before and behind.
    """
    joined = "\n".join(t.lower().replace("\n", " ") for t in texts)
    points = np.frombuffer((" " + joined + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.cumsum(points == 10)
    letter = letters()[points]
    points = np.where(letter, points, 32)
    has = np.bincount(of, weights=letter, minlength=len(texts)) > 0
    keep = letter | np.concatenate([[True], letter[:-1] | (np.diff(of) > 0)])  # the first of a run of others
    points, of = points[keep].astype(np.uint64), of[keep]
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    hashes = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        hashes = (hashes + points[k:len(points) - n + 1 + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    whole = of[:len(hashes)] == of[n - 1:]
    return hashes[whole], of[:len(hashes)][whole], has


@dataclass
class Filters:
    """Cells of language bits, a number for each 64 languages, with the filling of each language."""

    languages: list[str]
    n: int
    cells: np.ndarray
    probes: int
    wrong: np.ndarray | None = None

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(len(self.cells) - 1)
        step = (hashes >> np.uint64(40)) | np.uint64(1)
        return [(hashes + np.uint64(k) * step) & mask for k in range(self.probes)]

    def false_share(self) -> np.ndarray:
        """Chance that an n-gram which a language lacks is returned for it."""
        if self.wrong is None:
            grid = self.cells.reshape(len(self.cells), -1)
            self.wrong = np.array([float(((grid[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** self.probes
                                   for k in range(len(self.languages))])
        return self.wrong

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n-grams found per language, all n-grams, and whether it has a letter."""
        hashes, of, has = grams(texts, self.n)
        grid = self.cells.reshape(len(self.cells), -1)
        found = np.full((len(hashes), grid.shape[1]), ~np.uint64(0))
        for at in self.places(hashes):
            found &= grid[at]
        hits = np.stack([np.bincount(of, weights=((found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(float), minlength=len(texts))
                         for k in range(len(self.languages))], 1)
        return hits, np.bincount(of, minlength=len(texts)).astype(float), has

    def decide(self, texts: list[str], most: int = 1_000_000) -> tuple[list[str], list[float]]:
        """Language and score of each text. Longer texts are counted in pieces of ``most`` characters, which bounds the memory."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        has = np.zeros(len(texts), bool)
        pieces = [(k, t[i:i + most]) for k, t in enumerate(texts) for i in range(0, max(1, len(t)), most)]
        while pieces:
            size, n = 0, 0
            while n < len(pieces) and (not n or size + len(pieces[n][1]) <= most):
                size += len(pieces[n][1])
                n += 1
            of = np.array([k for k, _ in pieces[:n]])
            h, t, letters_in = self.counts([p for _, p in pieces[:n]])
            np.add.at(hits, of, h)
            np.add.at(total, of, t)
            np.logical_or.at(has, of, letters_in)
            pieces = pieces[n:]
        wrong = self.false_share()
        # Of t n-grams h hits are expected to be m members and (t - m) * wrong false ones.
        members = np.clip((hits - total[:, None] * wrong) / np.maximum(1e-9, 1 - wrong), 0, None)
        best = members.argmax(1)
        top = members[np.arange(len(texts)), best]
        share = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        return ([self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)],
                [float(min(1.0, s)) if h else 0.0 for s, h in zip(share, has, strict=True)])


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each is there."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 0) | (second[1:] != second[:-1])])[:len(first)])
    return first[new], second[new], np.diff(np.append(new, len(first)))


def learn(labelled: DataFrame, n: int = 4, docs_per_language: int = 2000, least_docs: float = 0.002, log_cells: int = 20,
          probes: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of every language in the labelled rows (those with a language).

    The sample is bounded: of each language the ``docs_per_language`` rows with the smallest hash of their id, whole texts. An
    n-gram belongs to a language when a share of ``least_docs`` of its sampled texts, two at least, has it (one, where the
    language has fewer than ten texts). Document frequencies are counted by Spark; the driver sees only the n-grams' hashes, at
    most what fills the cells.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Ids are ranked first, so texts of the sample alone are moved. A language's limit is taken before the exchange.
    # A language that most texts are in is ranked in SALTS parts before it is ranked whole.
    h = F.xxhash64("doc_id")
    chosen = rows.select("doc_id", "lang", F.pmod(h, F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(h, "doc_id"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= docs_per_language)
    chosen = stored(chosen.select("doc_id").distinct(), "language-sample")
    sample = stored(rows.join(F.broadcast(chosen), "doc_id"), "language-texts")  # at most docs_per_language ids of each language
    names = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not names:
        return Filters([], n, np.zeros((1 << log_cells, 1), np.uint64), probes)

    def count(batches):
        for batch in batches:
            for part in portions(batch, 0):
                hashes, of, _ = grams(part.column(0).to_pylist(), n)
                of, hashes, _ = _counted(of, hashes)
                codes = np.array([names.index(x) for x in part.column(1).to_pylist()], np.int32)
                codes, hashes, times = _counted(codes[of], hashes)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(hashes.view(np.int64)), pa.array(times)],
                                                 names=["code", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "code int, gram long, n long")
    counted = counted.groupBy("code", "gram").agg(F.sum("n").alias("n"))
    texts = sample.groupBy("lang").agg(F.count("*").alias("texts")).collect()
    least = {names.index(r.lang): max(1 if r.texts < 10 else 2, least_docs * r.texts) for r in texts}
    least = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in (kv[0], float(kv[1]))]), F.col("code"))
    masks = counted.where(F.col("n") >= least).groupBy("gram", F.floor(F.col("code") / 64).cast("int").alias("row")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("code") % 64)).alias("mask"))
    table = masks.toArrow()  # n-grams frequent in a bounded sample
    out = Filters(names, n, np.zeros((1 << log_cells, -(-len(names) // 64)), np.uint64), probes)
    hashes, row = table["gram"].to_numpy().view(np.uint64), table["row"].to_numpy()
    bits = table["mask"].to_numpy().view(np.uint64)
    for at in out.places(hashes):
        np.bitwise_or.at(out.cells, (at.astype(np.int64), row), bits)
    return out


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of the text's n-grams that the language is estimated to contain, 0 to 1).

    ``und`` and 0 where the text is null or has no letter, and everywhere if no language was learned. Equal counts: the first
    language in alphabetical order. Whole texts; rows repeat as they are; ids may be null; other columns are not read. The filter
    (8 MB at 2**20 cells for each 64 languages, whatever the corpus) is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for part in portions(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if shared.value.languages:
                    names, scores = shared.value.decide(texts)
                else:
                    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")
