"""Fill-in-middle transformation by one repeated capture.

``(unit)*`` matched against a whole text keeps every repetition of its group, so ``ends(1)`` of one fullmatch lists where each
unit ends: its length is the number of units, and both cuts are entries of it. Which cuts, and whether and in what form a text
is rearranged, come from a hash of the id alone, so a text that is processed again gives the same output on any executor.
"""
from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import portions

MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 20  # code points matched at once; the library needs some 60 bytes for each and fails with a MemoryError at 20 million


def unit_ends(text: str, pattern, block: int = BLOCK) -> np.ndarray | None:
    """Where each unit of a text ends; None if it is no sequence of units. ``pattern`` is ``(unit)*``, compiled.

    One fullmatch, unless the text is longer than a block: then its last unit may go on behind the block and is matched again
    with what follows it. A unit that fills a block doubles it.
    """
    found, at, reach = [], 0, block
    while at + reach < len(text):
        ends = pattern.match(text, at, at + reach).ends(1)[:-1]
        if ends and ends[-1] > at:
            found.append(np.array(ends, np.int32))
            at, reach = ends[-1], block
        else:
            reach *= 2
    last = pattern.fullmatch(text, at)
    if last is None:
        return None
    return np.concatenate([*found, np.array(last.ends(1), np.int32)])


def numbers(doc_id, seed: int) -> list[int]:
    """h1 to h4: the first four groups of eight digits of the hex SHA-256 of ``seed:id``; a null id is empty."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k:k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, doc_id, pattern, seed: int, rate: int, spm: int, markers=MARKERS):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, pattern)
    h1, h2, h3, h4 = numbers(doc_id, seed)
    n = 0 if ends is None else len(ends)
    if not n or h3 % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[c - 1]) if c else 0 for c in cuts)
    before, after, between = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{after}{suffix}{before}{prefix}{between}{middle}"
    return n, "psm", a, b - a, f"{before}{prefix}{after}{suffix}{between}{middle}"


def transform(docs: DataFrame, unit: str = "(?s:.)", seed: int = 1, rate: int = 90, spm: int = 20,
              markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    ``n`` is the number of units, by default code points. The prefix ends after the smaller of two hashed numbers of units, the
    middle after the larger one. ``rate`` percent of the ids are rearranged, ``spm`` percent of these with the suffix first;
    ``plain`` outputs are the text, and their prefix_chars and middle_chars are null. ``markers`` stand before the prefix, the
    suffix and the middle.

    Plain as well: a null or empty text (n 0, output empty), a text that contains a marker, so that a rearranged one can always
    be told apart, and one that is no sequence of units (n 0). Very long texts are matched in blocks. Repeated rows repeat, a
    null id is hashed as the empty text, other columns are not read, an empty table gives no rows. Narrow.
    """
    lead = {m[:1] for m in markers}
    if len(set(markers)) < 3 or not all(markers) or any(c in lead for m in markers for c in m[1:]):
        raise ValueError("markers must differ and have the characters that they begin with nowhere else")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_batches, unit=unit, seed=seed, rate=rate, spm=spm, markers=tuple(markers)),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _batches(batches, unit: str, **how):
    import regex

    pattern = regex.compile(f"({unit})*")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for part in portions(batch, 1):
            rows = [rearranged(text or "", doc_id, pattern, **how)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text, rebuilt from an output and its form: no part has a marker, so the output splits at the three."""
    part = partial(F.get, F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1))
    return (F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2)))
            .when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
            .otherwise(F.col(output)))


def digests(transformed: DataFrame) -> DataFrame:
    """The rows with SHA-256 of the output and of the text rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


# Code points, hashes and both forms can be said in SQL; '<[PSM]>' is any of the three markers.
SQL = """
with cut as (
 select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or regexp_matches(t, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
 from (select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n,
   cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
   cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from (select *, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents))),
made as (
 select *, case form when 'plain' then t
  when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end as output from cut),
parts as (select *, regexp_split_to_array(output, '<[PSM]>') as p from made)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(output) as output_sha256,
 sha256(case form when 'psm' then p[2] || p[4] || p[3] when 'spm' then p[3] || p[4] || p[2] else output end) as restored_sha256
from parts"""
