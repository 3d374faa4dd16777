"""Token files against the tokenizer's library, a plain zstandard decoder and damaged files."""
import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs
from tokenizers import Tokenizer

from jobspan.llm import token_files as tf
from tests.llm.test_operators import docs, empty  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(WORDS)


def want_of(model, rows, end=(2,)):
    """(doc_id, start, ids), in order of ids, nulls first."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(t or "", add_special_tokens=False).ids + list(end)
        out.append((i, at, ids))
        at += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in df.collect()), key=lambda r: r[1])


def opened(path):
    return tf.Archive(fs.LocalFileSystem().open_input_file(path), path)


@pytest.fixture(scope="module")
def written(docs, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("ids") / "new")
    files = tf.write(docs, path, WORDS, frame_ids=50, file_ids=400)
    return path, files.orderBy("part", "roll").collect()


def test_round_trip(spark, docs, model, written):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(tf.read(spark, written[0])) == want_of(model, rows)
    d = {r.start: r for r in tf.digests(tf.read(spark, written[0])).collect()}
    for i, at, ids in want_of(model, rows):
        assert (d[at].doc_id, d[at].n_tokens, d[at].ids_crc32) == (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_any_decoder_reads_the_files(docs, model, written):  # noqa: F811
    """From end to end a file is an ordinary zstandard file, in ascending order; frames stand alone."""
    path, files = written
    assert len(files) > 3 and {f.split("/")[-1] for f in glob.glob(f"{path}/*.zst")} == {r.file for r in files}
    data = b""
    for r in files:
        with open(f"{path}/{r.file}", "rb") as f:
            data += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert np.frombuffer(data, "<u4").tolist() == [x for _, _, ids in want_of(model, rows) for x in ids]
    a = opened(f"{path}/{files[0].file}")
    assert a.raw[1] == 200 and [a.frames(k, k + 1) for k in range(3)] == [data[200 * k:200 * k + 200] for k in range(3)]


def test_fetch_reads_only_frames_of_the_requested(spark, docs, written, monkeypatch):  # noqa: F811
    path, _ = written
    whole = {r[0]: r for r in got(tf.read(spark, path))}
    asked = spark.createDataFrame([(9,), (4,), (4,), (10,), (777,), (None,)], "doc_id long")
    assert got(tf.fetch(spark, path, asked)) == sorted((whole[i] for i in (4, 9, 10)), key=lambda r: r[1])
    assert got(tf.fetch(spark, path, docs.select("doc_id"))) == sorted(
        (r for r in got(tf.read(spark, path)) if r[0] is not None), key=lambda r: r[1])
    assert tf.fetch(spark, path, asked.limit(0)).count() == 0
    a = max((opened(f) for f in glob.glob(f"{path}/*.zst")), key=lambda a: len(a.sums))
    read, plain = [], a.frames
    monkeypatch.setattr(a, "frames", lambda x, y: read.append((x, y)) or plain(x, y))
    all_ids = plain(0, len(a.sums) - 1)
    assert list(a.documents(iter([(60, 20), (80, 30), (110, 0), (510, 20)]))) == [
        all_ids[240:320], all_ids[320:440], b"", all_ids[2040:2120]]
    assert read == [(1, 2), (2, 3), (10, 11)]


@pytest.mark.parametrize("harm", ["cut", "bit", "sum", "magic", "index"])
def test_damage_is_found(written, tmp_path, harm):
    path, files = written
    data = bytearray(open(f"{path}/{files[0].file}", "rb").read())
    count = struct.unpack("<I", data[-9:-5])[0]
    if harm == "cut":
        data = data[:-20]
    elif harm == "bit":
        data[20] ^= 1
    elif harm == "sum":
        data[-9 - 12 * count + 8] ^= 1
    elif harm == "magic":
        data[-1] ^= 1
    else:
        data[-9 - 12 * count - 8 - 10] ^= 1
    (tmp_path / "x.zst").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        a = opened(str(tmp_path / "x.zst"))
        a.frames(0, len(a.sums) - 1)
        a.index()


def test_empty_tables_and_no_end_id(spark, docs, model, tmp_path):  # noqa: F811
    assert tf.write(empty(docs), str(tmp_path / "none"), WORDS).count() == 0
    assert tf.read(spark, str(tmp_path / "none")).count() == 0
    rows = [(1, None), (2, ""), (3, "a b"), (4, " \n ")]
    tf.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "few"), WORDS, end_id=None)
    assert got_sorted(tf.read(spark, str(tmp_path / "few"))) == sorted(
        (i, at, ids) for i, at, ids in want_of(model, rows, ()))


def got_sorted(df):
    return sorted(got(df))


def test_other_kinds_of_id_and_tokenizers(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [("b", "Some text, it's  here"), ("a", " two  blanks"), ("c", None)]
    tf.write(spark.createDataFrame(rows, "name string, body string"), str(tmp_path / "x"), path, id_col="name", text_col="body")
    assert got(tf.read(spark, str(tmp_path / "x"), "string")) == want_of_names(Tokenizer.from_file(path), rows)
    wanted = spark.createDataFrame([("c",)], "key string")
    assert [r.doc_id for r in tf.fetch(spark, str(tmp_path / "x"), wanted, "string", "key").collect()] == ["c"]


def want_of_names(model, rows):
    out, at = [], 0
    for i, t in sorted(rows):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, ids))
        at += len(ids)
    return out


def test_words_alone_equal_the_library(model):
    rng = random.Random(11)
    bits = ["It's", "don't", " ", "\n", "\t ", "\r\n", "\x0b", " ", " ", "　", "é", "́", "Å", "ΣΑΣ", "İ", "漢字", "🙂",
            "<|endoftext|>", "<|startoftext|>", "12.5", "...", "'", "'ll", "x" * 300, "<|ENDOFTEXT|>", "ABC", "abc", "a.b", "1.5,", "Foo!?", "Ǆ", "ŉ", "ª", "Ⅷ", ".̸", "≠", "x.", "\x1c", "\x85", "\x00", "a", "Zoë", "ﬁ", "한국"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "x " * 50_000]
    table = tf.WordTable(open(WORDS, encoding="utf-8").read(), most=2000)
    assert table.traits.alone and table.traits.apart and table.traits.lower and table.traits.ends_word is not None
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        assert [x.tolist() for x in table.encode(pa.array(part, pa.string()))] == [
            model.encode(t or "", add_special_tokens=False).ids for t in part]
    assert not tf.tokenizer(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())[1].alone
