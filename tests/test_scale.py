"""What must hold at any size: whole texts, any depth, hot keys, vectors of one length."""
import json

import pytest
from pyspark.sql import functions as F

from jobspan.functions import text as T
from jobspan.operators import keys as K
from jobspan.operators.retrieval import batch_top_k
from jobspan.sources import feeds, readers

C = F.col("c")


def test_marks_in_texts_lose_nothing(ev):
    assert ev(T.section_text(C), c="Requirements:\nuse a\x01b tool\nkeep\x02 it") == "use ab tool keep it"
    assert ev(T.html_to_text(C), c="<p>a\x01b</p>") == "ab"


def test_section_text_is_whole(ev):
    assert len(ev(T.section_text(C), c="Requirements\n" + "x" * 20_000)) == 20_000


@pytest.mark.parametrize("raw, text", [("&rarr;&times;", "→×"), ("&amp;copy;", "&copy;"), ("&#65;&#x42;&nope;&", "AB&nope;&"), ("&Aacute;&lt;", "Á<")])
def test_every_named_entity(ev, raw, text):
    assert ev(T.decode_entities(C), c=raw) == text


def test_profiles_at_any_depth(spark):
    def nested(depth):
        doc = {"slug": f"s{depth}", "name": "N", "logo": "l"}
        for _ in range(depth):
            doc = {"x": doc}
        return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(doc)}</script>'

    pages = spark.createDataFrame([(d, nested(d)) for d in range(1, 13)], "page long, html string")
    assert sorted(r.slug for r in readers.page_profiles(pages).collect()) == sorted(f"s{d}" for d in range(1, 13))


def test_hot_and_missing_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 60 else None if i < 80 else f"k{i}") for i in range(100)], "id long, link string")
    known = spark.createDataFrame([("hot",), ("k99",), (None,), ("other",)], "link string")
    assert sorted(r.id for r in K.unknown_only(rows, known, "link").collect()) == list(range(60, 99))
    assert sorted(r.id for r in K.known_only(rows, known, "link").collect()) == [*range(60), 99]
    details = spark.createDataFrame([("hot", "text"), (None, "lost")], "link string, body string")
    got = feeds.merge_details(rows, details, "link", "body", "-")
    assert got.count() == 100 and got.where("body = 'text'").count() == 60


def test_mixed_vectors_are_refused(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, vec array<float>")
    with pytest.raises(ValueError):
        batch_top_k(items, queries, 1)
    with pytest.raises(Exception, match="not 1"):
        batch_top_k(items, queries.where("query_id = 2"), 1).collect()
    one = batch_top_k(items, queries.where("query_id = 1"), 1, max_kept=1).collect()
    assert [(r.query_id, r.id) for r in one] == [(1, 1)]


def test_large_vocabulary_finds_what_the_expressions_find(spark):
    import random

    from jobspan.functions.skills import scan_vocabulary
    from jobspan.operators.vocabulary import scan_large, vocabulary_table

    rng = random.Random(4)
    keys = ["c", "c#", "c++", ".net", "node.js", "ci/cd", "machine learning", "a b c", "été", "über cool", "x-1", "r&d", "go", "f_1", "(x)", "l'été"]
    bits = [*keys, "_", "é", " ", ", ", "-", "1", "a", "b", "C++", "Machine", "learning", "\n", "__", "."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14))) for _ in range(500)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    names = {k: k.upper() if len(k) > 2 else "SHORT" for k in keys}
    want = {r.id: r.s or [] for r in docs.select("id", scan_vocabulary(F.lower("text"), names).alias("s")).collect()}
    table = vocabulary_table(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(names.items())], "key string, name string, pos long"))
    assert {r.id: r.skills for r in scan_large(docs, table).collect()} == want
    assert sum(map(len, want.values())) > 800
    many = vocabulary_table(spark.range(100_000).selectExpr("concat('word', id, if(id % 2 = 0, '', ' x')) as key", "cast(id as string) as name", "id as pos"))
    hot = spark.range(300).selectExpr("id", "concat('Word44 word', id, ' x, word', id * 2) as text")
    got = {r.id: set(r.skills) for r in scan_large(hot, many).collect()}
    assert got == {i: {"44"} | ({str(i)}) | {str(2 * i)} for i in range(300)}
    with pytest.raises(Exception, match="no word"):
        vocabulary_table(spark.createDataFrame([("++", "x", 0)], "key string, name string, pos long")).collect()


def test_a_phrase_is_a_gram_of_its_own(spark):
    """Keys of plain runs need no pattern: none is sought in a text again, and boundaries hold as the patterns have them."""
    from jobspan.functions.skills import scan_vocabulary
    from jobspan.operators.vocabulary import scan_large, vocabulary_table

    names = {"ab cd": "ab cd", "cd ef": "cd ef", "ab cd ef": "ab cd ef", "c++ ab": "c++ ab", "ef": "ef", "1 2": "1 2"}
    table = vocabulary_table(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(names.items())], "key string, name string, pos long"))
    asked = [e for r in table.collect() for e in r.entries if e.pattern]
    assert [e.name for e in asked] == ["c++ ab"]
    texts = ["ab cd ef", "ab  cd ef", "xab cd", "ab cdé ef", "_ab cd", "ab cd_", "ab cd́ ef", "éab cd", "x.ab cd.ef", "AB CD", "1 2 1 2", "c++ ab cd", "ab ab cd",
             "ab-cd ef", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: r.s or [] for r in docs.select("id", scan_vocabulary(F.lower("text"), names).alias("s")).collect()}
    assert {r.id: r.skills for r in scan_large(docs, table).collect()} == want
    plain = {k: v for k, v in names.items() if "+" not in k}
    want = {r.id: r.s or [] for r in docs.select("id", scan_vocabulary(F.lower("text"), plain).alias("s")).collect()}
    assert {r.id: r.skills for r in scan_large(docs, table.where("gram not like 'r:%'")).collect()} == want


def test_slugs_are_made_once_a_name(spark):
    """Variants of a name are made after names have met, not in the task that reads its rows; the first place of each slug stays."""
    from jobspan.operators.boards import candidate_slugs

    rows = spark.range(2000).selectExpr("1999 - id as pos", "concat('Brand ', id % 3, ' Inc') as name")
    late = spark.createDataFrame([(None, "Brand 1 Inc"), (4, "Other Co"), (2, None)], "pos long, name string")
    found = candidate_slugs([rows, late])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [rank_list" in plan[plan.index("Generate"):]
    first = {r.slug: (r.rank_list, r.rank_pos) for r in found.collect()}
    assert first["brand1"] == (0, 0) and first["brand0"] == (0, 1) and first["brand2"] == (0, 2)
    assert first["other"] == (1, 4)
    assert {r.slug: r.rank_pos for r in candidate_slugs([late]).collect()}["brand1"] is None


@pytest.mark.parametrize("name", ["unknown_links", "unknown_links_of_source", "requested_postings"])
def test_lookups_by_row_id_read_no_texts(spark, name):
    from jobspan.checks import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan and "embedding:" not in plan


def test_feeds_collect_after_one_shuffle_and_read_texts_once(spark):
    """Lines of a board are dealt out once and its supplier comes to the whole response; the text of a list is made once."""
    from jobspan.checks import QUERIES

    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    plan = QUERIES["feed_lever"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "s_name" not in plan[plan.index("Aggregate"):].split("\n")[0] and "RepartitionByExpression [l_suppkey" in plan
    assert plan[:plan.index("Generate")].count("regexp_replace") == 1
