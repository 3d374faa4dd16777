"""Importance resampling towards a target distribution, with Arrow kernels.

Texts are lower-cased, split and flattened by Arrow and dictionary-encoded, so a word is a number. Longer runs are pairs of
numbers: that of the run so far and that of the next word, shifted by one place, encoded again. Only distinct runs are hashed,
by going on with the CRC of the shorter run. Counts of hashed runs in the corpus and in the target give each bucket a gain; the
gains of a document are taken by bucket and summed by segment. Documents are drawn without replacement by the largest of
weight plus Gumbel noise, whose hash depends on the id alone.

The corpus is read twice, once for the counts and once for the weights; what is shuffled is one row per bucket and task, then
one narrow row per document for the ranks.
"""
from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import numbered, portions, stored

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: all ASCII but digits and a-z


def features(texts: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text and, for each length of run, (text, bucket) of every run, in order of texts."""
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    flat, of = pc.list_flatten(words), pc.list_parent_indices(words)
    some = pc.greater(pc.binary_length(flat), 0)  # a text that begins or ends between words has an empty one there
    coded = pc.dictionary_encode(flat.filter(some))
    of = of.filter(some).to_numpy()
    codes = coded.indices.to_numpy().astype(np.int64)
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    following = [b" " + w for w in names]
    crcs = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    at, run, found = np.arange(len(codes)), codes, []
    for k in range(runs):
        if k:
            goes_on = at + k < len(codes)
            goes_on[goes_on] = of[at[goes_on] + k] == of[at[goes_on]]
            at, run = at[goes_on], run[goes_on]
            pairs = pc.dictionary_encode(pa.array(run * max(len(names), 1) + codes[at + k]))
            run, pairs = pairs.indices.to_numpy().astype(np.int64), pairs.dictionary.to_numpy()
            shorter, word = np.divmod(pairs, max(len(names), 1))
            crcs = np.fromiter(map(zlib.crc32, map(following.__getitem__, word.tolist()), crcs[shorter].tolist()),
                               np.int64, len(pairs))
        found.append((of[at], (crcs % buckets)[run]))
    return np.bincount(of, minlength=len(texts)), found


def bucket_counts(texts: DataFrame, text_col: str = "text", runs: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often runs of 1 to ``runs`` words fall into each bucket, over all whole texts, repeats counted.

    Each task gives one row per bucket, so a bucket's rows are at most as many as tasks. Null and empty texts give none.
    """
    return texts.select(F.col(text_col).alias("text")).mapInArrow(
        partial(_count, runs=runs, buckets=buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _count(batches, runs: int, buckets: int):
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for part in portions(batch, 0):
            for _, bucket in features(part.column(0), runs, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """For each bucket, a thousand times the log of its share in the target over its share in the corpus, rounded down; each
    bucket counts once more than it was seen."""
    s, t = (_table(x, buckets) for x in (corpus, target))
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def _table(counts: DataFrame, buckets: int) -> np.ndarray:
    rows = counts.toArrow()  # at most one row per bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def weigh(docs: DataFrame, gains: np.ndarray, runs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean of the gains of a whole text's runs, rounded down; 0 without a word."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_weigh, gains=gains, runs=runs), f"doc_id {kind}, n_words long, n_features long, weight long")


def _weigh(batches, gains: np.ndarray, runs: int):
    table = pa.array(gains)
    for batch in batches:
        for part in portions(batch, 1):
            n_words, found = features(part.column(1), runs, len(gains))
            n, total = (np.zeros(part.num_rows, np.int64) for _ in range(2))
            for of, bucket in found:
                sums = np.concatenate([[0], np.cumsum(table.take(pa.array(bucket)).to_numpy())])
                ends = np.searchsorted(of, np.arange(part.num_rows + 1))
                n += np.diff(ends)
                total += np.diff(sums[ends])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                names=["doc_id", "n_words", "n_features", "weight"])


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Adds ``score`` and ``rank``: of the documents with enough words, floor(percent * N / 100) with the highest scores are
    drawn and ranked from 1, ties to the smaller id; the others' rank is null.

    The score is the weight and Gumbel noise from the first eight hex digits of the SHA-256 of ``seed:id``. A null id is
    hashed as the empty text and comes first among ties; rows that are equal in both have ranks of their own. Ranks come from
    a range-partitioned sort, in which equal scores and ids spread by the row.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = stored(weighed.withColumn("score", F.col("weight") + noise), "weights")
    enough = F.col("n_words") >= least_words
    most = rows.where(enough).count() * percent // 100
    ordered = rows.select("*", (~enough).alias("short"), (-F.col("score")).alias("down"), F.monotonically_increasing_id().alias("row"))
    ranked = numbered(ordered, ["short", "down", "doc_id", "row"], "place", "drawn")
    return ranked.withColumn("rank", F.when(enough & (F.col("place") < most), F.col("place") + 1)).drop("short", "down", "row", "place")


def resample(docs: DataFrame, target: DataFrame, runs: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20,
             seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, drawn towards the ``text`` of the target table.

    Null and empty texts have no words, weight 0 and no rank. Very long texts are counted whole, repeated rows count again, other
    columns are not read. An empty target gives gains from the corpus alone, an empty corpus gives no rows.
    """
    counted = partial(bucket_counts, runs=runs, buckets=buckets)
    table = gains(counted(docs, text_col), counted(target), buckets)
    return draw(weigh(docs, table, runs, id_col, text_col), percent, least_words, seed)


# The same draw of 25 percent in SQL, CRC-32 bit by bit; ids are unique.
SQL = r"""
with texts as (
 select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
 union all select 1, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
runs as (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from texts),
counted as (select side, id, f, count(*) as n from runs group by all),
bytes as (select f, list_transform(range(0, octet_length(encode(f))), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint)) as b
 from (select distinct f, hex(encode(f)) as h from counted)),
hashed as (select f, xor(list_reduce(list_concat([4294967295], b), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)),
 lambda d, k: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end)), 4294967295) % 10000 as bucket from bytes),
placed as (select side, id, bucket, sum(n) as n from counted join hashed using (f) group by all),
totals as (select bucket, coalesce(sum(n) filter (side = 0), 0) as s, coalesce(sum(n) filter (side = 1), 0) as t from placed group by 1),
sums as (select sum(s) as s, sum(t) as t from totals),
gains as (select bucket, cast(floor(1000 * ln((cast(totals.t as double) + 1) * (cast(sums.s as double) + 10000)
 / ((cast(totals.s as double) + 1) * (cast(sums.t as double) + 10000)))) as bigint) as gain from totals, sums),
weights as (select id, cast(sum(n) as bigint) as n_features, cast(floor(sum(n * gain) / cast(sum(n) as double)) as bigint) as weight
 from placed join gains using (bucket) where side = 0 group by 1),
scored as (select d.doc_id, len(x.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
 coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
 from documents d join texts x on x.side = 0 and x.id = d.doc_id left join weights on weights.id = d.doc_id),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20
 qualify rank <= count(*) over () * 25 // 100)
select doc_id, n_features, weight, score, rank from scored left join drawn using (doc_id)"""
