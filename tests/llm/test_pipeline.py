"""The pipeline's stages on the smallest tables, each against brute force on its own input."""
import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from jobspan.llm import checks, decontaminate, line_dedup
from tests.llm.test_operators import brute_counts
from tests.llm.test_shingles import brute_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage: id to text, and the last stage's rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        df = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
        df.write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ({r.doc_id: r.text for r in docs.collect()}, after)
        docs = after
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_duplicates", "benchmark_decontamination", "sentencepiece"]
    assert checks.QUERIES.keys() >= {f"op{n}" + rest for n, rest in enumerate(
        ["_rule_ensemble", "_decontamination", "_language_id", "_pseudonyms", "_licences", "_line_dedup", "_simhash", "_sharding",
         "_decision_list", "_pieces"], 1)}


def test_quality_keeps_clean_documents(spark, stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in checks.labels(spark, SF).collect()}
    failed = {i for i, t in before.items() for n, _, _, _, r in [brute_counts(t)] if n < 20 or 100 * r > 30 * n}
    assert kept.isdisjoint(failed)
    clean = {i for i, q in labels.items() if q == 1} - failed
    assert len(clean - kept) <= len(clean) // 100


def test_lines(stages):
    """Lines of every length: those that repeat an earlier one of their class go, but for lines without a word."""
    before, after = stages["line_dedup"]
    at = [(i, k, x) for i, t in sorted(before.items()) for k, x in enumerate((t or "").split("\n"))]
    distinct = sorted({x for _, _, x in at}, key=len)
    words = {x: Counter(x.split()) for x in distinct}
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def may(x, y):
        """Bounds that every linked pair keeps: of lengths, or of shared words."""
        if len(y) - len(x) <= line_dedup.EDITS:
            return True
        n, m = words[x].total(), words[y].total()
        most = min(n, m) // line_dedup.SHARE
        return abs(n - m) <= most and max(n, m) - (words[x] & words[y]).total() <= most

    for k, x in enumerate(distinct):
        for y in distinct[k + 1:]:
            if find(x) != find(y) and may(x, y) and line_dedup.near_lines(x, y, None):
                root[find(y)] = find(x)
    seen, gone = set(), defaultdict(set)
    for i, k, x in at:
        if find(x) in seen and x.strip(" \t\n\r\x0b\x0c"):
            gone[i].add(k)
        seen.add(find(x))
    assert {r.doc_id: r.text for r in after.collect()} == {
        i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}


def test_near_duplicates(stages):
    """Plain five-word similarity of 0.8 on, joined; the smallest id of a group stays."""
    before, after = stages["simhash_near_duplicates"]
    assert {r.doc_id for r in after.collect()} == set(brute_groups(before).values())


def test_benchmark(spark, stages):
    before, after = stages["benchmark_decontamination"]
    kept = {r.doc_id for r in after.collect()}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in before.items():
        words = b" " + b" ".join(decontaminate.words_of(t)) + b" "
        whole = any(b" " + b" ".join(item) + b" " in words for item in items)
        half = any(sum((Counter(item) & Counter(words.split())).values()) >= len(item) / 2 for item in items)
        assert not (whole and i in kept)
        assert i in kept or half


def test_pieces(stages):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=checks.piece_model())
    before, after = stages["sentencepiece"]
    got = {r.doc_id: (r.ids, r.decoded) for r in after.collect()}
    assert got == {i: (model.encode(t), model.decode(model.encode(t))) for i, t in before.items()}


def test_run_equals_the_stages(spark, stages):
    want = stages["sentencepiece"][1]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with the operators' own names pass through every stage; so does no row."""
    rows = [(i, r.text, "en", "s", 1, 2, "x", 3, 4) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect())]
    rows += [rows[3], rows[3], (None, "a text without an id " * 9, None, None, None, None, None, None, None), (90, None, "en", "s", 0, 2, "x", 3, 4),
             (91, "", "en", "s", 0, 2, "x", 3, 4), (92, " \n\t", "en", "s", 0, 2, "x", 3, 4)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, h1 long, removed string, __removed int, node int"
    whole = spark.createDataFrame(rows, kinds)
    for k, docs in enumerate((whole, whole.limit(0))):
        ids = {r.doc_id for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        assert (docs.where("doc_id is null").count() == 1) == (k == 0)
