"""Licence scan: a generalised suffix automaton over licence tokens.

Every text is streamed once through the automaton of all templates, which gives its matching statistics: for each word the
length of the longest run of template words that ends there. Runs long enough are chained along the template into covered
spans, and the share of the template that a chain covers decides about its label. Base phrases are those of the query's
contract and are found where their words stand consecutively.
"""
from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import portions, utf8

# Phrases of the contract.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Notices by which works name their licence, and the openings and conditions of short licences. Public texts; a label may have several.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                 "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
              "the License, or (at your option) any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
              "the License, or (at your option) any later version"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

# Bytes to word bytes: A-Z lower-cased, ASCII other than letters and digits a blank, the rest as it is.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences. A state keeps, per template, one end of its longest run there."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[dict[int, int]] = [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for at, w in enumerate(seq):
                last = self._add(last, w, ends)
                ends[last].setdefault(t, at + 1)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            for t, at in ends[s].items():
                ends[self.link[s]].setdefault(t, at)
        self.ends = [sorted(e.items()) for e in ends]

    def _new(self, size: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, w: int, ends: list) -> int:
        """The state of the longest run that p with w ends, cut off from a longer one when need be."""
        q = self.next[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        cut = self._new(self.size[p] + 1, ends)
        self.next[cut], self.link[cut] = dict(self.next[q]), self.link[q]
        self.link[q] = cut
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = cut
            p = self.link[p]
        return cut

    def _add(self, last: int, w: int, ends: list) -> int:
        if w in self.next[last]:
            return self._split(last, w, ends)
        state, p = self._new(self.size[last] + 1, ends), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            self.link[state] = self._split(p, w, ends)
        return state

    def statistics(self, ids: list[int]):
        """(state, length) of the longest run that ends at each word."""
        state = length = 0
        for w in ids:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, base: list[tuple[str, str]], templates: list[tuple[str, str]], least: int, share: float, gap: int):
        self.base = [(words_of(p.encode()), label) for p, label in base]
        self.labels = [label for label, _ in templates]
        sequences = [words_of(t.encode()) for _, t in templates]
        self.lengths = [len(s) for s in sequences]
        self.least, self.share, self.gap = least, share, gap
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in s] for s in sequences]
        self.automaton = Automaton(coded)
        # Base phrases by their first word, for the texts that hold all words of the phrase.
        self.known = frozenset(self.ids)

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(start, length, state, end) of the longest runs of at least ``least`` words that no longer run contains."""
        get, found = self.ids.get, []
        coded = [get(w, -1) for w in words]
        last = (0, 0)
        for at, (state, length) in enumerate(self.automaton.statistics(coded)):
            if length <= last[1] and last[1] >= self.least:
                found.append((at - last[1], last[1], last[0], at))
            last = (state, length)
        if last[1] >= self.least:
            found.append((len(words) - last[1], last[1], last[0], len(words)))
        return found

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share of the template) of chains that cover enough of a template."""
        if self.known.isdisjoint(words):
            return []
        chains: list[tuple[int, list[int]]] = []
        going: dict[int, list[list[int]]] = {}  # the chains of each template that a run may still go on with
        for start, length, state, end in self.runs(words):
            for t, at in self.automaton.ends[state]:
                if at < length:
                    continue
                near = going[t] = [c for c in going.get(t, ()) if start - c[1] <= self.gap]
                for c in reversed(near):  # [first, end, template end, covered]
                    # A run goes on with a chain where it stands behind it in both, within the gap.
                    over = max(0, c[1] - start, c[2] - (at - length))
                    if over < length and at > c[2]:
                        c[1], c[2], c[3] = end, at, c[3] + length - over
                        break
                else:
                    near.append([start, end, at, length])
                    chains.append((t, near[-1]))
        best: dict[tuple[str, int], tuple[str, int, int, float]] = {}
        for t, (first, end, _, covered) in chains:
            part = min(1.0, covered / self.lengths[t])
            if part >= self.share:
                key = (self.labels[t], first)
                if key not in best or best[key][3] < part:
                    best[key] = (self.labels[t], first, end, part)
        return sorted(best.values(), key=lambda s: (s[1], s[0]))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of the base phrases, wherever all words stand consecutively."""
        found = []
        for phrase, label in self.base:
            n = len(phrase)
            if phrase[-1] in words:
                found += [(i, label) for i in range(len(words) - n + 1) if words[i] == phrase[0] and words[i:i + n] == phrase]
        return sorted(found)


def scan(docs: DataFrame, base=tuple(BASE), templates=tuple(TEMPLATES), least: int = 2, share: float = 0.8, gap: int = 4,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places array<struct<first long, label string>> of base phrases, spans array<struct<label, first, end,
    share>>: template spans of which at least ``share`` is covered by runs of ``least`` words or more with at most ``gap`` other
    words between two.

    A null or empty text has no words and no spans. Whole texts are streamed, however long. Rows repeat as they are, ids may be
    null, other columns are not read. Narrow: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_scan_batches, args=(list(base), list(templates), least, share, gap)),
        f"doc_id {kind}, n_words long, places array<struct<first: long, label: string>>, "
        "spans array<struct<label: string, first: long, end: long, share: double>>")


def _scan_batches(batches, args):
    scanner = Scanner(*args)
    place = pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    for batch in batches:
        for part in portions(batch, 1):
            counts, places, spans = [], [], []
            for text in utf8(part.column(1)):
                words = words_of(text)
                counts.append(len(words))
                places.append([{"first": i, "label": x} for i, x in scanner.places(words)])
                spans.append([dict(zip(("label", "first", "end", "share"), s, strict=True)) for s in scanner.spans(words)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)],
                names=["doc_id", "n_words", "places", "spans"])


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (base ones and those of spans), score: the largest
    covered share of a template, 1 where a base phrase stands."""
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "spans.label")))
    n = F.size("places").cast("long")
    return scanned.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"))
