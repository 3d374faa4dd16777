"""Token ids in seekable zstandard files: independent frames, per-frame checksums and a trailing seek table.

A file holds the ids of its documents one after another, as little-endian unsigned 32-bit integers, cut into frames of a fixed
number of ids. Behind them lie a skippable frame with the documents' ids and lengths and the seek table of the published
seekable format (sizes and XXH64 checksum of every frame). Any zstandard decoder reads such a file from end to end; a reader of
some documents fetches the tail, finds their frames and decompresses only those.

Documents are written in ascending order of ids: the rows are range-partitioned and sorted, each task writes the files of its
range, and one row per file goes into a Parquet table beside them, through Spark's own commit. Only files in that table are
read, so what a lost or repeated task has left behind does no harm. Tasks open files through pyarrow, by the path's scheme.
"""
from __future__ import annotations

import functools
import io
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobspan.llm.common import portions

# Fixed values of the published seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, TABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
FRAME_IDS = 1 << 16
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20  # a file takes no further document from so many ids or documents on
FILES = "files"


class IdFile:
    """Writes one file. Holds the ids of one frame and of the document that is being added."""

    def __init__(self, stream, kind: pa.DataType, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.stream, self.kind, self.frame_ids = stream, kind, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list = []
        self.lengths: list[int] = []
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_ids:
            ready = np.concatenate(self.waiting)
            whole = len(ready) - len(ready) % self.frame_ids
            for at in range(0, whole, self.frame_ids):
                self._frame(ready[at:at + self.frame_ids])
            self.waiting, self.n_waiting = [ready[whole:]], len(ready) - whole

    def _frame(self, ids: np.ndarray):
        from xxhash import xxh64_intdigest

        raw = ids.astype("<u4").tobytes()
        packed = self.compressor.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self):
        from xxhash import xxh64_intdigest
        import zstandard

        if self.n_waiting:
            self._frame(np.concatenate(self.waiting))
        table = pa.table({"doc_id": pa.array(self.docs, self.kind), "n": pa.array(self.lengths, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        index = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(sink.getvalue())
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.frames.append((len(index) + 8, 0, xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = np.array(self.frames, "<u4").tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + 9) + entries)
        self.stream.write(struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, TABLE_MAGIC))
        self.stream.close()


class Archive:
    """Reads documents of one file; ``source`` is a seekable binary file with size(), as pyarrow opens it."""

    def __init__(self, source, name: str = ""):
        self.source, self.name = source, name
        end = source.size()
        count, flags, magic = struct.unpack("<IBI", self._bytes(end - 9, 9))
        if magic != TABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{name} has no seek table with checksums")
        start = end - 9 - 12 * count
        if struct.unpack("<II", self._bytes(start - 8, 8)) != (SKIPPABLE_TABLE, 12 * count + 9):
            raise ValueError(f"{name}: the seek table is damaged")
        packed, raw, self.sums = np.frombuffer(self._bytes(start, 12 * count), "<u4").reshape(-1, 3).T.astype(np.int64)
        self.packed, self.raw = (np.concatenate([[0], np.cumsum(x)]) for x in (packed, raw))
        if self.packed[-1] != start - 8:
            raise ValueError(f"{name}: frames and seek table disagree")

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(n) if at >= 0 else b""
        if len(got) != n:
            raise ValueError(f"{self.name} is cut off")
        return got

    def index(self) -> pa.Table:
        """doc_id and n of the documents, in their order."""
        import zstandard

        at, size = int(self.packed[-2]), int(self.packed[-1] - self.packed[-2])
        body = self._bytes(at, size)
        if struct.unpack("<II", body[:8]) != (SKIPPABLE_INDEX, size - 8):
            raise ValueError(f"{self.name}: the index of documents is damaged")
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body[8:])).read_all()

    def frames(self, first: int, last: int) -> bytes:
        """The bytes of some frames that follow each other, each compared with its checksum."""
        import zstandard
        from xxhash import xxh64_intdigest

        base = int(self.packed[first])
        body = self._bytes(base, int(self.packed[last]) - base)
        unpack, out = zstandard.ZstdDecompressor(), []
        for k in range(first, last):
            try:
                raw = unpack.decompress(body[int(self.packed[k]) - base:int(self.packed[k + 1]) - base])
            except zstandard.ZstdError as wrong:
                raise ValueError(f"{self.name}: frame {k} is damaged") from wrong
            if len(raw) != self.raw[k + 1] - self.raw[k] or xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"{self.name}: the checksum of frame {k} is wrong")
            out.append(raw)
        return b"".join(out)

    def documents(self, ranges: Iterator[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of documents given as (offset, length) in ids; a frame that neighbours share is decompressed once."""
        held, first, last = b"", 0, 0
        for offset, n in ranges:
            a, b = 4 * offset, 4 * (offset + n)
            if n and not (self.raw[first] <= a and b <= self.raw[last]):
                old, first = first, int(np.searchsorted(self.raw, a, "right")) - 1
                held = held[int(self.raw[first] - self.raw[old]):] if old <= first < last else b""
                at, last = last if held else first, int(np.searchsorted(self.raw, b, "left"))
                held += self.frames(at, last)
            base = int(self.raw[first])
            yield held[a - base:b - base] if n else b""


def filesystem(path: str):
    """(filesystem, path in it) of a folder, by its scheme; without one it is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# --- encoding ------------------------------------------------------------------------------------------------------------

PUNCTUATION = ".,;:!?"
# Digits and Latin letters, but for U+0130, whose lower case ends in a mark.
BEFORE = r"0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
GROUP = 1000  # words in one call


class Traits:
    """What a tokenizer allows, found by trying it: encoding words alone, cutting before punctuation, lower-casing first, and
    encoding many words in one call, because each ends in a token that says so."""

    def __init__(self, text: str, model):
        import json

        spec = json.loads(text)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ids = lambda x: model.encode(x, add_special_tokens=False).ids
        parts = ["It's", "a", "\u0301b", "A\u030a", "x\u2019s", "12,5", "\u03a3\u0391\u03a3", "!?", "'ll", "\u3000", "\x0bc", *self.added,
                 *(f"a{t}b" for t in self.added)]
        blanks = (" ", "\n\r", "\t ", "\x0b", "\x0c")
        self.alone = ids(" \n\x0b\x0c") == ids("") == [] and all(
            ids(a + blank + b) == ids(a) + ids(b) for a in parts for b in parts for blank in blanks)
        self.apart = self.alone and not any(c in t for t in self.added for c in PUNCTUATION) and all(
            ids(a + c + b) == ids(f"{a} {c}{b}") for a in ("ab", "\u00e9", "7", "\u00df") for c in PUNCTUATION for b in ("", "a", "5", c, "'s"))
        self.lower = all(ids(x) == ids(x.lower()) for x in ("ABC xYz", "It'S", "\u00c5B", "A1B", "O\u0301K"))
        suffix = spec["model"].get("end_of_word_suffix") if self.alone else None
        self.ends_word = np.array([(model.id_to_token(i) or "").endswith(suffix) for i in range(model.get_vocab_size())]) if suffix else None


@functools.lru_cache(maxsize=2)
def tokenizer(text: str):
    """The tokenizer of a JSON text and its traits."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(text)
    model.no_truncation()
    model.no_padding()
    return model, Traits(text, model)


class WordTable:
    """Ids of the distinct words met so far; emptied before a call when it holds over ``most`` ids."""

    def __init__(self, text: str, most: int = 8_000_000):
        (self.model, self.traits), self.most = tokenizer(text), most
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]):
        ends_word, order, ids, sizes = self.traits.ends_word, [], [], []
        plain = [w for w in words if w.isalpha()] if ends_word is not None else []
        groups = [plain[k:k + GROUP] for k in range(0, len(plain), GROUP)]
        rest = [w for w in words if not w.isalpha()] if ends_word is not None else words
        for group, found in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ends_word[found])
            if len(ends) == len(group):  # each word has one end at least, so each has one
                order += group
                ids.append(found)
                sizes.append(np.diff(ends, prepend=-1))
            else:
                rest += group
        found = [e.ids for e in self.model.encode_batch_fast(rest, add_special_tokens=False)]
        order += rest
        ids.append(np.fromiter((i for some in found for i in some), np.uint32, sum(map(len, found))))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.at.update(zip(order, range(len(self.at), len(self.at) + len(order))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as the library encodes it without special tokens of its own; a null is empty."""
        texts, traits = pc.fill_null(texts, ""), self.traits
        if not traits.alone:
            return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if self.ends[-1] > self.most:
            self.clear()
        if traits.lower:
            lowered = pc.ascii_lower(texts)
            # Upper case must not become an added token.
            texts = texts if any(pc.any(pc.match_substring(lowered, t)).as_py() for t in traits.added) else lowered
        if traits.apart:
            texts = pc.replace_substring_regex(texts, f"([{BEFORE}])([{PUNCTUATION}])", r"\1 \2")
        cut = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(pc.list_flatten(cut))
        words = coded.dictionary.to_pylist()
        slots = list(map(self.at.get, words))
        if None in slots:
            self._learn([w for w, k in zip(words, slots) if k is None])
            slots = list(map(self.at.__getitem__, words))
        slot = np.array(slots, np.int64)[coded.indices.to_numpy()]
        starts, sizes = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(starts - total[:-1], sizes) + np.arange(int(total[-1]))]
        bounds = total[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


# --- Spark ---------------------------------------------------------------------------------------------------------------

_ROW = "part int, roll int, file string, n_docs long, n_ids long, bytes long"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, frame_ids: int = FRAME_IDS,
          file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, adds the end id and writes all ids in ascending order of document ids into a new folder.
    Returns one row per file, in order of (part, roll), which is also stored in the folder.

    A null text is empty (the end id alone; nothing without one). A null id comes first; documents that share an id follow by
    the hash of their texts, equal ones as they come. A very long text may span frames and is never cut. Other columns are not
    read. An empty table writes no file. The tokenizer travels with the job.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "h", "row"]  # equal ids spread over ranges by what follows them
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        place, folder = filesystem(path)
        table, part, out, roll = WordTable(shipped.value), TaskContext.get().partitionId(), None, 0
        end = np.array([] if end_id is None else [end_id], np.uint32)
        place.create_dir(folder, recursive=True)

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{
                "part": part, "roll": roll, "file": name, "n_docs": len(out.docs), "n_ids": out.n_ids,
                "bytes": place.get_file_info(f"{folder}/{name}").size}], schema=_row_schema())

        for batch in batches:
            for some in portions(batch, 1):
                for doc_id, ids in zip(some.column(0).to_pylist(), table.encode(some.column(1)), strict=True):
                    if out is None:
                        name = f"ids-{part:06d}-{roll:03d}-{uuid.uuid4().hex}.zst"  # another attempt has another name
                        stream = place.open_output_stream(f"{folder}/{name}", compression=None)
                        out = IdFile(stream, some.column(0).type, frame_ids)
                    out.add(doc_id, np.concatenate([ids, end]))
                    if out.n_ids >= file_ids or len(out.docs) >= FILE_DOCS:
                        yield closed()
                        out, roll = None, roll + 1
        if out is not None:
            yield closed()

    files = f"{path.rstrip('/')}/{FILES}"
    rows.mapInArrow(run, _ROW).write.parquet(files)
    shipped.unpersist()
    return spark.read.schema(_ROW).parquet(files)


def _row_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                      ("n_ids", pa.int64()), ("bytes", pa.int64())])


def _placed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, start) of every file, a file or a few per partition; one row per file is summed up in one task."""
    files = spark.read.schema(_ROW).parquet(f"{path.rstrip('/')}/{FILES}")
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "roll", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartitionByRange(max(1, files.count()), "part", "roll").select("file", "start")


def _opener(path: str):
    """Opens files of a folder by name; the last one stays open, since rows of one file follow each other."""
    place, folder = filesystem(path)
    held: list = [None, None]

    def opened(name: str) -> Archive:
        if held[0] != name:
            if held[1] is not None:
                held[1].source.close()
            held[:] = name, Archive(place.open_input_file(f"{folder}/{name}"), name)
        return held[1]

    return opened


def _grouped(rows: Iterator[tuple], schema: pa.Schema, sized: int | None = None, most: int = 4_000_000):
    """Batches of rows, of some MB of the given column at most, one row at least."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 64 + (len(row[sized]) if sized is not None else 0)
        if n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder, from its files.

    ``start`` is the number of ids of all documents before it, ``ids`` are the ids as little-endian unsigned 32-bit integers.
    Every frame is compared with its checksum; a damaged or cut file raises ValueError. No files give no rows.
    """

    schema = pa.schema([("doc_id", _arrow(id_type)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        opened = _opener(path)

        def rows():
            for row in (r for batch in batches for r in batch.to_pylist()):
                archive = opened(row["file"])
                table = archive.index()
                n = table["n"].to_numpy()
                spans = list(zip((np.cumsum(n) - n).tolist(), n.tolist()))
                for doc_id, (at, k), ids in zip(table["doc_id"].to_pylist(), spans, archive.documents(iter(spans)), strict=True):
                    yield doc_id, row["start"] + at, k, ids

        yield from _grouped(rows(), schema, 3)

    return _placed_files(spark, path).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, file, offset, n_tokens, start) of every document: only the tails of the files are read."""

    schema = pa.schema([("doc_id", _arrow(id_type)), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64()),
                        ("start", pa.int64())])

    def run(batches):
        opened = _opener(path)

        def rows():
            for row in (r for batch in batches for r in batch.to_pylist()):
                table = opened(row["file"]).index()
                n = table["n"].to_numpy()
                for doc_id, at, k in zip(table["doc_id"].to_pylist(), (np.cumsum(n) - n).tolist(), n.tolist()):
                    yield doc_id, row["file"], at, k, row["start"] + at

        yield from _grouped(rows(), schema)

    return _placed_files(spark, path).mapInArrow(run, f"doc_id {id_type}, file string, offset long, n_tokens long, start long")


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """As read(), for the documents whose ids a table names: of the files only tails and the frames of those are read.

    Ids may repeat in the table; ids that are in no file, and nulls, give no rows.
    """
    asked = wanted.select(F.col(id_col).alias("doc_id")).distinct()
    found = index(spark, path, id_type).join(asked, "doc_id").select("file", "offset", "n_tokens", "start", "doc_id")
    order = ["file", "offset"]  # documents of one frame are read one after another, a file by several tasks if many are asked for

    schema = pa.schema([("doc_id", _arrow(id_type)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        opened = _opener(path)

        def rows():
            for name, same in itertools.groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["file"]):
                a, b = itertools.tee(same)
                for row, ids in zip(a, opened(name).documents((r["offset"], r["n_tokens"]) for r in b), strict=True):
                    yield row["doc_id"], row["start"], row["n_tokens"], ids

        yield from _grouped(rows(), schema, 3)

    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def _arrow(id_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(id_type))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids' bytes."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
