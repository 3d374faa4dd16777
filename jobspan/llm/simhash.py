"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most ``bits`` bits differ in at most that many bytes, so they
share at least 8 - bits bytes in their places: the guaranteed minimum. The index lists fingerprints under every set of so many
positions together with the bytes there, so a pair meets exactly in the lists that tally towards its minimum and a pair below
it meets nowhere. In a list the shared bytes of each pair are tallied, pairs that reach the minimum are verified by the number
of differing bits, and a list gives only links that join what is not yet joined, never all of its pairs.
"""
from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import components, discard, portions, stored, utf8

SHORT = 8  # fingerprints of a list whose pairs are compared as rows
TILE = 4096  # fingerprints compared with each other in one call: 4096 x 4096 bytes


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the SimHash of each whole text over XXH64 of its shingles of so many words, repeats counted.

    A-Z is lower-cased; words are runs of characters other than ASCII white space. Fewer words: the whole sequence is the only
    shingle. No words, an empty or a null text: zero. Narrow.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_fingerprint_batches, words=words, seed=seed), f"doc_id {kind}, fp long")


def _fingerprint_batches(batches, words: int, seed: int):
    for batch in batches:
        for part in portions(batch, 1):
            fps = [fingerprint(t, words, seed) for t in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))],
                                             names=["doc_id", "fp"])


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b - 1], seed) for a, b in zip(starts, ends[words - 1:])), np.uint64,
                         len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # 64 bytes a shingle while its bits are counted
        ones += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def linked(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints, column fp: every two that differ in at most ``bits`` bits are joined by a path
    of links, and every link is such a pair."""
    if not 0 <= bits <= 7:
        raise ValueError("eight bytes guarantee a shared one only up to seven bits")
    keep = 8 - bits
    sets = list(itertools.combinations(range(8), keep))
    masks = [sum(255 << (8 * k) for k in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
                     for i, m in enumerate(signed)])
    # Each fingerprint becomes as many rows as there are sets, so the narrow table is dealt to all tasks first.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = fps.repartition(tasks, "fp").select("fp", F.inline(keys))
    # Lists are counted first: a list of one fingerprint can't link, and nearly all lists are such. Spark sizes all these rows as if they
    # were the fingerprints, so joins with them are told to sort; else they would all pass through the driver.
    sizes = listed.groupBy("place", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(listed.join(sizes.hint("merge"), ["place", "bytes"]), "simhash-lists")
    # Lists of the same fingerprints, as a group has them under many keys, are told by two hashes of their members and kept once.
    alike = shared.groupBy("place", "bytes", "n").agg(F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y"))
    once = alike.groupBy("n", "x", "y").agg(F.min(F.struct("place", "bytes")).alias("list")).select("list.*")
    every, shared = shared, stored(shared.join(once.hint("merge"), ["place", "bytes"], "left_semi"), "simhash-lists")
    discard(every)
    # Longer lists are dealt to tiles, pairs of blocks of a list, so that no task holds a whole list.
    dealt = (shared.where(F.col("n") > SHORT).withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(F.col("own"), k).alias("low"), F.greatest(F.col("own"), k).alias("high")))
    dealt = dealt.select("place", "bytes", "own", "fp", F.inline(tiles))

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        own, fps = rows["own"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        found = tile_links(fps[own == key[2].as_py()], fps[own == key[3].as_py()], bits, keep)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    long = dealt.groupBy("place", "bytes", "low", "high").applyInArrow(join, "a long, b long")
    links = stored(_short_lists(shared.where(F.col("n") <= SHORT), bits, keep).unionByName(long).distinct(), "simhash-links")
    discard(shared)
    return links


def _short_lists(shared: DataFrame, bits: int, keep: int) -> DataFrame:
    """The pairs of lists of at most SHORT fingerprints, tallied and verified without Python."""
    lists = shared.groupBy("place", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    a = lists.select("l", F.posexplode("l").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(((F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(8)), F.lit(0))
    return pairs.where((tally >= keep) & (F.bit_count(differ) <= bits)).distinct()


def tile_links(left: np.ndarray, right: np.ndarray, bits: int, keep: int) -> np.ndarray:
    """Links between two blocks of a list (or within one) that join all that the verified pairs join, fewer than fingerprints."""
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    at_left, at_right = where[:len(left)], where[len(left):]
    label = np.arange(len(nodes))
    out = []
    for x, i in zip(left, at_left, strict=True):
        differ = right ^ x
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = (tally >= keep) & (np.bitwise_count(differ) <= bits) & (label[at_right] != label[i])
        if near.any():
            names, first = np.unique(label[at_right[near]], return_index=True)
            out += [(x, y) for y in right[near][first]]
            label[np.isin(label, names)] = label[i]
    return np.array(out, np.uint64).reshape(-1, 2).view(np.int64)


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id that is reached over links of at most ``bits``
    differing bits, the document's own included.

    Empty and null texts have fingerprint zero and link like any other. Repeated rows give a row each. A null id links its
    text but names no component; a component of null ids alone has a null component_id. No rows give no rows. Other columns
    are not read. Equal texts are one fingerprint, so a group of copies of any size is one node; its rows meet their
    component's id in a join that splits skewed keys.
    """
    prints = stored(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = stored(components(linked(nodes.select("fp"), bits)), "simhash-components")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """The documents without all but the one with the smallest id of each group of near-duplicates; all columns are kept.
    Rows without an id can't be named and stay; repeated rows of an id share its fate."""
    found = near_duplicates(docs, bits, words)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    return docs.join(gone, "doc_id", "left_anti")
