"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of a supported vocabulary continues past a character other than the whitespace marker into a marker, so a text may
be cut before every run of spaces and the chunks be segmented alone. Words repeat, so each task keeps a table of the distinct
chunks that it has met, segments each of them once with the library, and joins the ids back by position with array lookups.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import portions

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def load(path: str):
    """The model; refuses a vocabulary for which chunks can't be segmented alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross whitespace markers, such as {crossing[:3]}")
    plain = ("a", " a", "  a b ", "\ta\nb", "Åﬁ", "á", "　a")
    if any(model.decode(model.encode(x)) != x for x in plain):
        raise ValueError("the model normalises texts or spaces, so chunks can't be segmented alone")
    return model


class ChunkTable:
    """Ids and decoded bytes of the distinct chunks met so far; emptied when it holds over ``most`` ids."""

    def __init__(self, model, most: int = 8_000_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.ids = np.zeros(1024, np.int32)
        self.ends = np.zeros(1, np.int64)

    def learn(self, chunks: list[str]):
        """Segments chunks that the table lacks. Each begins with a marker, which the model adds by itself as its dummy prefix."""
        bodies = [c[1:].replace(MARK, " ") for c in chunks]
        found = self.model.encode(bodies, num_threads=1)
        lone = self.model.piece_to_id(MARK)
        found = [ids or [lone] for ids in found]  # of no text the model makes nothing, of a lone marker its own piece
        self.texts += [b" " + t.encode() for t in self.model.decode(found, num_threads=1)]
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks))))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        old = int(self.ends[-1])
        self.ends = np.concatenate([self.ends, old + np.cumsum(sizes)])
        while len(self.ids) < self.ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[old:self.ends[-1]] = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of some texts: all ids, the number of ids of each, and each decoded text."""
        cut = [_CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.at)
        if new:
            self.learn(list(new))
        at, spoken = self.at.__getitem__, self.texts.__getitem__
        rows = [list(map(at, c)) for c in cut]
        places = np.fromiter((k for r in rows for k in r), np.int64, sum(map(len, rows)))
        starts, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum([len(r) for r in rows])
        counts = total[ends] - total[ends - [len(r) for r in rows]]
        # Decoding drops the dummy prefix of a text's first chunk.
        return ids, counts, [b"".join(map(spoken, r))[1:] for r in rows]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): the ids of each whole text as the library encodes it, without begin or end ids,
    and the text that its decode() gives back for them.

    A null text is empty: no ids, empty text. Very long texts and long words are segmented whole. Rows repeat as they are,
    ids may be null, other columns are not read. Narrow: nothing is shuffled.
    """

    def run(batches):
        table = ChunkTable(load(model_path))
        for batch in batches:
            for part in portions(batch, 1):
                if table.ends[-1] > table.most:
                    table.clear()
                ids, counts, decoded = table.encode([t or "" for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
