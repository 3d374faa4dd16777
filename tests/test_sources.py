import json

import pytest
from pyspark.sql import functions as F

from jobspan import schemas
from jobspan.functions import answers as A
from jobspan.operators import boards as O
from jobspan.operators import keys as K
from jobspan.plans import career, enrich
from jobspan.plans.ingest import ingest
from jobspan.sources import feeds, readers, writers


def landed(spark, doc, **cols):
    row = spark.createDataFrame([(json.dumps(doc),)], "payload string")
    for name, value in {"company_name": "Acme", "slug": "acme", **cols}.items():
        row = row.withColumn(name, F.lit(value))
    return row


def test_company_list_and_names(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"name": "A", "slug": "a", "jobs": 3},\n {"name": "B", "company_id": "b1"}]')
    assert sorted(tuple(r) for r in readers.company_list(spark, str(tmp_path / "c.json")).select("name", "key", "jobs").collect()) == [
        ("A", "a", 3), ("B", "b1", None)]
    (tmp_path / "n.txt").write_text(" Acme \n\n  \nBig Co\n")
    assert [r.name for r in readers.name_lines(spark, str(tmp_path / "n.txt")).collect()] == ["Acme", "Big Co"]


def test_crawl_urls(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"url": "https://a"}\nnot json\n{"url": ""}\n{"x": 1}\n')
    assert [r.url for r in readers.crawl_urls(spark, str(tmp_path / "u.json")).collect()] == ["https://a"]


def test_descriptions_resolved(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("line one\nline two")
    files = readers.description_files(spark, str(tmp_path / "t"))
    uri = files.first().uri
    rows = spark.createDataFrame([(1, uri), (2, "inline"), (3, "file:/missing"), (4, None)], "id long, description string")
    got = {r.id: r.text for r in readers.resolve_descriptions(rows, files, prefix="file:").collect()}
    assert got == {1: "line one\nline two", 2: "inline", 3: None, 4: None}


def test_lever(spark):
    docs = [{"text": " Analyst ", "hostedUrl": "https://l/1", "categories": {"allLocations": ["Austin", "Dallas"]}, "descriptionPlain": " Hi ",
             "lists": [{"text": "Needs", "content": "<li>SQL</li>"}], "additionalPlain": "Bye", "salaryRange": {"max": 9}, "createdAt": 1700000000000},
            {"text": "No link"}]
    out = feeds.lever(readers.feed_jobs(landed(spark, docs), "lever")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.title, r.location, r.description, tuple(r.salary)) == ("Analyst", "Austin", "Hi\n\nNeeds\n\nSQL\n\nBye", (None, 9.0, "USD"))
    assert str(r.posted_date) == "2023-11-14 22:13:20"


def test_ashby(spark):
    jobs = [{"id": "1", "title": "A", "location": {"city": "Austin", "name": "X"}, "applyLink": "https://a/1", "publishedAt": "bad",
             "createdAt": "2024-01-01T00:00:00Z", "descriptionHtml": "<p>x</p>"},
            {"id": "2", "title": "B", "locationName": " Remote ", "location": "Austin"}, {"id": "3", "title": " "}]
    doc = {"data": {"jobBoard": None, "jobPostingList": {"jobPostings": jobs}}}
    out = {r.title: r for r in feeds.ashby(readers.feed_jobs(landed(spark, doc), "ashby")).collect()}
    assert sorted(out) == ["A", "B"]
    assert (out["A"].location, out["A"].link, out["A"].description) == ("Austin", "https://a/1", "x")
    assert str(out["A"].posted_date) == "2024-01-01 00:00:00"
    assert (out["B"].location, out["B"].link, out["B"].description) == ("Remote", "https://jobs.ashbyhq.com/acme/2", "")


@pytest.mark.parametrize("loc,expected", [
    ({"remote": True, "country": "us"}, "Remote - US"), ({"remote": True, "country": "FR"}, "Remote - FR"), ({"remote": True}, "Remote"),
    ({"city": "Austin", "region": "TX", "country": "us"}, "Austin, TX"), ({"city": "Paris", "country": "fr"}, "Paris, fr"),
    ({"city": "Oslo"}, "Oslo"), ({"region": "TX"}, "TX"), ({"country": "fr"}, None)])
def test_smartrecruiters(spark, loc, expected):
    doc = {"content": [{"id": "7", "name": "Analyst", "location": loc, "releasedDate": "2024-01-01T00:00:00.000Z",
                        "jobAd": {"sections": {"qualifications": {"title": "Q", "text": "<b>SQL</b>"}, "jobDescription": {"text": "Do"}}}}]}
    r = feeds.smartrecruiters(readers.feed_jobs(landed(spark, doc, company_id="AcmeId"), "smartrecruiters")).first()
    assert (r.location, r.description, r.link) == (expected, "Do\n\nQ\n\nSQL", "https://jobs.smartrecruiters.com/AcmeId/7")


def test_greenhouse(spark):
    doc = {"jobs": [{"id": 5, "title": "A", "location": {"name": "Dublin"}, "offices": [{"name": "NYC", "location": "New York, NY"}, {"name": "", "location": None}],
                     "content": "<p>" + "long text " * 6 + "</p>"}, {"id": 6, "title": "B", "absolute_url": "https://g/6", "content": "<p>short</p>"}]}
    out = {r.title: r for r in feeds.greenhouse(readers.feed_jobs(landed(spark, doc), "greenhouse")).collect()}
    assert out["A"].locations == ["Dublin", "New York, NY", "NYC"]
    assert out["A"].link == "https://boards.greenhouse.io/acme/jobs/5"
    assert out["A"].description.startswith("long text")
    assert (out["B"].link, out["B"].description, out["B"].locations) == ("https://g/6", None, [])


def test_workday(spark, ev):
    path = "/en-US/External_Careers/job/NYC/Engineer_JR-123"
    assert ev(feeds.detail_path(F.col("c"), F.lit("external_careers")), c=path) == "/job/NYC/Engineer_JR-123"
    doc = {"jobPostings": [{"title": "A", "externalPath": path, "locationsText": "NYC, Remote", "jobPostingInfo": {"jobDescription": "<p>x</p>y"}}]}
    r = feeds.workday(readers.feed_jobs(landed(spark, doc, tenant="acme", wd_num=5), "workday")).first()
    assert r.link == "https://acme.wd5.myworkdayjobs.com" + path
    assert (r.description, r.locations) == ("x\ny", ["NYC", "Remote"])


def test_bad_feed(spark):
    broken = spark.createDataFrame([("not json",)], "payload string")
    assert readers.feed_jobs(broken, "greenhouse").count() == 0
    with pytest.raises(ValueError):
        readers.feed_jobs(broken, "x")


def test_aggregator(spark):
    rows = spark.createDataFrame([("u1", "Data Engineer", " ", None, "Austin", None, "2024-01-02", 0.0, None, "EUR"),
                                  ("", "Data Engineer", "x", None, None, "Indeed", None, 1.0, None, None),
                                  ("u2", "Nurse", "x", None, None, "LinkedIn", "never", 1.0, None, None)], schemas.ddl(schemas.AGGREGATOR))
    out = feeds.aggregator(rows).orderBy("link").collect()
    assert [(r.link, r.company_name, r.source, r.salary) for r in out][0] == ("u1", None, "indeed", None)
    assert (out[1].source, out[1].posted_date, tuple(out[1].salary)) == ("linkedin", None, (1.0, None, "USD"))
    assert [r.link for r in feeds.aggregator(rows, "data engineer").collect()] == ["u1"]


def test_profiles(spark):
    listed = {"props": {"pageProps": {"customerProfiles": [{"slug": " a ", "name": "A"}, {"slug": "a", "name": "Again"}, {"slug": "", "name": "x"}]}}}
    deep = {"x": [{"y": {"slug": "d", "name": "D", "website": "w"}}, {"slug": "n", "name": "no logo"}]}
    page = lambda d: f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(d)}</script>'
    rows = spark.createDataFrame([(1, page(listed)), (2, page(deep)), (3, "<html>"), (4, page(1).replace("1", "{broken"))], "page_id long, html string")
    got = sorted(tuple(r) for r in readers.page_profiles(rows).collect())
    assert got == [(1, "a", "A"), (2, "d", "D")]


# ------------------------------------------------------------------ tables
def test_storage_round_trip(spark, tmp_path):
    text = "Acme builds robots. " * 10
    raw = spark.createDataFrame([(1, "Acme", "Data Analyst", text, "u1", "Austin", "lever"), (2, "Acme", "Data Analyst", text, "u1", "Austin", "lever"),
                                 (3, "Acme", "Nurse", text, "u2", "Austin", "lever")],
                                "id long, company_name string, title string, description string, link string, location string, source string")
    raw = (raw.withColumn("posted_date", F.lit(None).cast("timestamp")).withColumn("followers", F.lit(None).cast("long"))
           .withColumn("employees", F.lit(None).cast("long")))
    path, stored = str(tmp_path / "p"), raw.limit(0)
    done = ingest(raw, stored, "2024-01-01")
    writers.append_postings(done.postings, path)
    assert done.counts.first().asDict() == {"source": "lever", "scraped": 3, "inserted": 1, "duplicate": 1, "blocked": 0, "bad_title": 1,
                                            "non_us": 0, "no_company_ref": 0, "error": 0}
    back = readers.postings(spark, path)
    assert back.columns == list(schemas.POSTINGS)
    assert [(r.id, str(r.posted_date)) for r in back.collect()] == [(1, "2024-01-01 00:00:00")]
    again = ingest(raw, back, "2024-01-02")
    assert again.postings.count() == 0
    assert done.descriptions.first().text == text


def test_exports(spark, tmp_path):
    b = spark.createDataFrame([("A", "a", 1, "X", 5), ("B", "b", 5, "Y", 9)], "company_name string, tenant string, wd_num int, career_site string, job_count int")
    writers.export_csv(b, str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert {r.board_url for r in rows} == {"https://a.wd1.myworkdayjobs.com/en-US/X", "https://b.wd5.myworkdayjobs.com/en-US/Y"}
    j = spark.createDataFrame([("a", 3), ("b", 0)], "slug string, jobs int")
    writers.export_json(j, str(tmp_path / "json"), min_jobs=1)
    assert [r.slug for r in spark.read.schema("slug string, jobs int").json(str(tmp_path / "json")).collect()] == ["a"]
    writers.append_log(j, str(tmp_path / "log"))
    writers.append_log(j, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_keys(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i % 5) for i in range(60)], "id long, k string, o int")
    got = {r.k: r.id for r in K.first_per_key(df, ["k"], ["o"], "id").collect()}
    best = {}
    for i in range(60):
        k = "hot" if i % 3 else f"k{i}"
        best[k] = min(best.get(k, (9, 99)), (i % 5, i))
    assert got == {k: v[1] for k, v in best.items()}
    look = spark.createDataFrame([("hot", "H")], "k string, v string")
    assert K.salted_lookup(df, look, ["k"], ["id"]).where("v = 'H'").count() == 40
    known = spark.createDataFrame([("x",)], "slug string")
    rows = spark.createDataFrame([("A", ["x", "y"]), ("B", ["z"])], "name string, slugs array<string>")
    assert [r.name for r in K.without_known_candidates(rows, known, "name", "slugs", "slug").collect()] == ["B"]
    names = spark.createDataFrame([("Acme Robots",), ("Known",)], "name string")
    cand = O.board_candidates(names, spark.createDataFrame([("known",)], "tenant string"))
    assert cand.count() == 15


# ------------------------------------------------------------------ answers and passes
def test_answers(ev):
    c = F.col("c")
    a = ev(A.skills_answer(c), c='{"skills": ["a", 1, "b"], "experience_years": 3.7}')
    assert (a.ok, a.skills, a.years) == (True, ["a", "b"], 3)
    a = ev(A.skills_answer(c), c='{"required_skills": "x", "skills": ["y"], "experience_years": "5-7 years"}')
    assert (a.skills, a.years) == ([], 5)
    a = ev(A.skills_answer(c), c="```json\n{}```")
    assert (a.ok, a.skills, a.years) == (False, [], None)
    assert ev(A.years_answer(c), c='```{"experience_years": 41}```') is None
    assert ev(A.years_answer(c), c='{"experience_years": "99 years"}') == 99
    assert ev(A.years_answer(c), c='{"experience_years": null}') is None
    r = ev(A.resume_answer(c, F.lit("x" * 600)), c="broken")
    assert (r.skills, r.experience_years, len(r.summary)) == ([], None, 600)
    assert len(ev(A.resume_answer(c, F.lit("x" * 600), head=500), c="broken").summary) == 500
    assert ev(A.company_answer(c), c='{"name": "x"}') is None
    assert ev(A.company_answer(c, F.lit("Acme")), c='{"company_name": ""}').company_name == "Acme"
    assert ev(A.text_by_id(c), c='{"1": "a", "2": "", "x": ""}') == {1: "a"}
    assert ev(A.text_by_id(c), c='{"1": "a", "x": "y"}') == {}
    assert ev(A.skills_answer(c), c="[]").ok is False
    assert ev(A.skills_answer(c), c='{"required_skills": null, "skills": ["a"]}').skills == []
    assert ev(A.company_answer(c), c='{"about": {"company_name": "x"}}') is None
    assert ev(A.company_answer(c, F.lit("Acme")), c='{"company_name": null}').company_name == "Acme"
    assert ev(A.resume_answer(c, F.lit("head")), c="[1]").summary == "head"
    assert ev(A.text_by_id(c), c="no") == {}
    assert ev(A.id_list(c), c="```json\n[3, 1]\n```") == [3, 1]
    q = ev(A.question_class(c), c='{"category": "skill_gap", "role": " Data Engineer ", "skills_known": ["sql"]}')
    assert tuple(q) == ("skill_gap", "data engineer", ["sql"])
    assert ev(A.question_class(c), c="x").category == "off_topic"
    assert "y" * 5000 in ev(A.request_text("skills", c), c="y" * 5000)
    assert "y" * 4001 not in ev(A.request_text("skills", c, A.REQUEST_CHARS["skills"]), c="y" * 5000)


def test_enrich_pass(spark):
    rows = spark.createDataFrame([(1, "Data Engineer", "Acme", "<p>Python and SQL, 5+ years of experience</p>"), (2, "Nurse", "Acme", "Python"),
                                  (3, "Data Engineer", "Acme", "<p> </p>"), (4, "Data Engineer", "Acme", "Rust ???"), (5, "Analyst", "Acme", "Talks")],
                                 "id long, title string, company_name string, description string").withColumn(
        "skills", F.lit(None).cast("array<string>")).withColumn("source", F.lit("lever"))
    answers = spark.createDataFrame([(1, '{"required_skills": ["SQL"], "experience_years": null}'), (3, '{}'), (5, '{"required_skills": []}')], "id long, raw string")
    got = {r.id: r for r in enrich.enrich(enrich.backlog(rows, "skills"), answers, "2024-01-01").collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert (got[1].skills, got[1].experience_years, got[1].outcome) == (["SQL", "Python"], 5, "ok")
    assert (got[2].skills, got[2].outcome, got[3].skills, got[3].outcome) == ([], "empty", None, "error")
    assert (got[5].skills, got[5].outcome) == ([], "empty")
    years = {r.id: (r.experience_years, r.outcome) for r in enrich.backfill_years(
        enrich.backlog(rows.withColumn("experience_years", F.lit(None).cast("int")), "experience_years"),
        spark.createDataFrame([(2, '{"experience_years": 4}')], "id long, raw string")).collect()}
    assert years == {1: (5, "regex"), 2: (4, "llm"), 3: (None, "skip"), 5: (None, "null")}


def test_questions(spark):
    p = spark.createDataFrame([(1, "Data Lead", "A", ["SQL", "Go"], 3, "x")], "id long, title string, company_name string, skills array<string>, experience_years int, description string")
    assert career.answer_data(p, career.Question("off_topic")) is None
    assert career.answer_data(p, career.Question("skills_for_role")) is None
    ctx = career.answer_context(p, career.Question("skill_gap", "Data Engineer", ("sql",))).first()
    assert ctx.grounded and ctx.n_jobs == 1 and '"side":"you_have"' in ctx.data
    none = career.answer_context(p, career.Question("skills_for_role", "nurse")).first()
    assert not none.grounded
    over = career.answer_context(p, career.Question("role_overview", "data engineer")).first()
    assert over.grounded and json.loads(over.data)["avg_experience_years"] == 3.0
    assert career.normal_role("Data Engineer") == "data" and career.normal_role(None) == ""
