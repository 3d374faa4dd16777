import hashlib

import pytest
from pyspark.sql import functions as F

from jobspan.functions import names as N
from jobspan.functions import parse as V
from jobspan.functions import skills as K
from jobspan.functions import text as T

C = F.col("c")
NOW = "2024-05-31 12:00:00"


def test_html_to_text(ev):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><body><!-- x --><p> Hi&nbsp;&amp; bye</p>\n<b>“q”</b>&#233;&#x41;&lt;</body></html>"
    assert ev(T.html_to_text(C), c=html) == 'Hi & bye\n"q"\néA<'
    assert ev(T.html_to_text(C), c="plain ’text’ ") == "plain 'text' "
    assert ev(T.html_to_text(C), c=None) == ""


def test_strip_tags(ev):
    assert ev(T.strip_tags(C), c="<p>a<b>b</b>\n c </p>") == "a b c"


@pytest.mark.parametrize("line,expected", [
    ("Requirements:", "requirements"), ("Benefits", "STOP"), ("Technical skills", "skills"), ("What you'll do", "responsibilities"),
    ("We ask for some requirements in this long line of text", None), ("", None), ("x" * 61, None), ("Other requirements", "STOP"),
    ("  Qualifications :: ", "requirements")])
def test_header_class(ev, line, expected):
    assert ev(T.header_class(C), c=line) == expected


def test_section_text(ev):
    text = "Intro\nResponsibilities\nBuild it\nRequirements:\n Python \n\nSQL\nBenefits\nFree lunch\nSkills\nSpark\nQualifications\nMore"
    assert ev(T.section_text(C), c=text) == "Python SQL More Spark Build it"
    assert ev(T.section_text(C), c="nothing\nhere") == "nothing\nhere"
    assert ev(T.section_text(C), c="<h2>Requirements</h2><p>Go</p>") == "Go"
    assert ev(T.section_text(C, max_chars=3), c="abcdef") == "abc"
    assert ev(T.section_text(C), c="Requirements\nBenefits\nx") == "Requirements\nBenefits\nx"


def test_embed_text(ev):
    both = T.embed_text(F.col("t"), F.col("p"))
    assert ev(both, t="Lead", p="Go") == "Lead\n\nGo"
    assert ev(both, t="", p="Go") == "Go"
    assert ev(both, t=None, p=" ") is None


@pytest.mark.parametrize("text,years", [
    ("8+ years of experience, including 2+ years in X", 8), ("3-5 years in Sales", 3), ("110 years of experience", 10),
    ("25 years of experience", None), ("5 or more years of experience", 5), ("10 years experience", 10), ("no number", None),
    ("including 4 years of experience", 4), ("plus 3 years of experience, 6 years in Go", 6)])
def test_years(ev, text, years):
    assert ev(T.extract_years(C), c=text) == years


def test_paths(ev):
    assert ev(T.path_safe(C), c='  a<b>:"/\\|?*  c  ') == "ab c"
    key = hashlib.sha1(b"https://x/1").hexdigest()[:12]
    path = T.description_path(F.lit("Acme"), F.lit("Data / ML"), C)
    assert ev(path, c="https://x/1") == f"descriptions/Acme/Data ML_{key}.txt"
    assert ev(path, c="") == "descriptions/Acme/Data ML_x.txt"
    assert ev(T.chunk_path(F.lit("A"), F.lit("B"), F.lit(7), F.lit(2))) == "chunks/A/B_7_chunk_2.txt"


# ------------------------------------------------------------------ skills
def test_scan_vocabulary(ev):
    text = "We use golang, k8s, c++, node.js and apache spark; not javascripty. react native too. été"
    assert ev(K.scan_vocabulary(C), c=text) == ["Go", "C++", "React", "Node.js", "Kubernetes", "Apache Spark", "React Native"]
    assert ev(K.scan_vocabulary(C), c="écss c++11 xc#") == []


def test_guard_skills(ev):
    text = "we want go, r, python, postgres, acme tools and data at acme corp, zz"
    raw = F.array(*[F.lit(s) for s in ["Go", " R ", "zz", "Data", "Acme", "corp", "Postgres", "PostgreSQL", "Rust", "Python", "python"]])
    got = ev(K.guard_skills(raw, C, F.lit("Acme, Corp.")), c=text)
    assert got == ["Go", "R", "corp", "PostgreSQL", "Python"]
    assert ev(K.guard_skills(F.array(F.lit("Rust")), F.lit(""), F.lit(None).cast("string"))) == ["Rust"]


def test_crosscheck_modes(spark):
    df = spark.createDataFrame([("we run k8s", None, None)], "text string, company_name string, stated_skills array<string>")
    assert K.extract_skills(df).first().skills == []
    assert K.extract_skills(df, crosscheck="matched_key").first().skills == ["Kubernetes"]
    with pytest.raises(ValueError):
        K.extract_skills(df, crosscheck="x")


def test_broad_pass(spark):
    df = spark.createDataFrame([("uses cobol and python and fortran", ["COBOL"], ["cobol", "Fortran", "Ada"]),
                                ("uses cobol and python", ["COBOL", "Python"], ["and"])],
                               "text string, stated_skills array<string>, more array<string>").withColumn("company_name", F.lit("X"))
    rows = [r.skills for r in K.extract_skills(df, broad="more", min_found=3).collect()]
    assert rows[0] == ["COBOL", "Python", "Fortran"]
    assert K.extract_skills(df, broad="more").collect()[1].skills == ["COBOL", "Python"]


# ------------------------------------------------------------------ values on cards
@pytest.mark.parametrize("text,low,high", [
    ("$80K/yr - $120K/yr", 80000.0, 120000.0), ("$40/hr - $60/hr", 83200.0, 124800.0), ("$95,500.50", 95500.5, 95500.5)])
def test_salary(ev, text, low, high):
    pay = ev(V.parse_salary(C), c=text)
    assert (pay.min, pay.max, pay.currency) == (low, high, "USD")


def test_salary_other(ev):
    assert ev(V.parse_salary(C), c="competitive") is None
    assert ev(V.parse_salary(C, "plain"), c="50,000 to 60,000 or 70").max == 60000.0
    assert ev(V.parse_salary(C, "plain"), c="20 per HOUR").min == 41600.0


@pytest.mark.parametrize("text,expected", [
    ("Just now", "2024-05-31 12:00:00"), ("3 hours ago", "2024-05-31 09:00:00"), ("2 weeks", "2024-05-17 12:00:00"),
    ("1 month ago", None), ("", None)])
def test_relative_time(ev, text, expected):
    got = ev(V.relative_time(C, NOW), c=text)
    assert (str(got) if got else None) == expected


@pytest.mark.parametrize("text,expected", [
    ("Posted today", "2024-05-31"), ("5 days ago", "2024-05-26"), ("30+ days ago", "2024-05-01"), ("a month ago", "2024-05-01"),
    ("Active 3 days ago", "2024-05-31"), ("?", "2024-05-31")])
def test_relative_day(ev, text, expected):
    assert str(ev(V.relative_day(C, NOW), c=text))[:10] == expected


def test_times_and_counts(ev):
    assert str(ev(V.iso_time(C), c="2024-05-01T10:00:00Z")) == "2024-05-01 10:00:00"
    assert ev(V.iso_time(C), c="soon") is None
    assert str(ev(V.epoch_ms_time(F.lit(1700000000000)))) == "2023-11-14 22:13:20"
    assert ev(V.followers(C), c="about 12.5K followers") == 12500
    assert ev(V.followers(C), c="1,952 followers") == 1952
    assert ev(V.employees(C), c="1,001-5,000 employees") == 1001
    assert ev(V.employees(C), c="10,001+ employees") == 10001
    assert ev(V.employees(C), c="some") is None
    assert ev(V.clean_title(C), c="Analyst  with verification ") == "Analyst"
    assert str(ev(V.posted_at(F.lit("bad"), C, NOW), c="1 day ago"))[:10] == "2024-05-30"


# ------------------------------------------------------------------ names
def test_slugs(ev):
    assert ev(N.slug_candidates(C), c="Scale AI") == ["scale", "scaleai", "scale-ai"]
    assert ev(N.slug_candidates(C), c="AMAZON COM INC") == ["amazon", "amazoncom", "amazon-com"]
    assert ev(N.slug_candidates(C), c="Inc") == []
    assert ev(N.clean_company(C), c="Meta Platforms, Inc.") == "meta platforms"
    assert ev(N.slug_variants(C), c="NVIDIA CORP") == ["nvidia", "nvidiainc", "nvidia-inc"]
    assert ev(N.slug_variants(C), c="Meta Platforms, Inc.") == [
        "meta platforms", "metaplatforms", "meta-platforms", "meta", "meta platformsinc", "meta platforms-inc"]


def test_urls(ev):
    assert ev(N.career_site(C), c="/en-US/External/job/1") == "External"
    assert ev(N.career_site(C), c="/jobs/search") is None
    b = ev(N.board_from_url(C), c="https://Acme.wd5.myworkdayjobs.com/External/job/1?x=1")
    assert tuple(b) == ("acme", 5, "External")
    assert ev(N.board_from_url(C), c="https://acme.wd5.myworkdayjobs.com/en-US/x") is None
    assert ev(N.board_from_url(C), c="https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Careers/jobs").career_site == "Careers"
    assert ev(N.canonical_link(C, "https://l.example"), c="/jobs/view/1?x=2") == "https://l.example/jobs/view/1"
    assert ev(N.career_site_fallbacks(C), c="careers") == ["External_Careers", "External", "Careers", "careers"]


def test_cohort_role_company(ev):
    assert tuple(ev(N.cohort_key(C), c="Winter 2024")) == (2024, 0)
    assert tuple(ev(N.cohort_key(C), c="Fall 2023")) == (2023, 3)
    assert tuple(ev(N.cohort_key(C), c="Someday 2023")) == (2023, 0)
    for bad in ("Winter", "Winter x", "", None):
        assert tuple(ev(N.cohort_key(C), c=bad)) == (0, 0)
    assert ev(N.normalize_role(C), c=" Data Engineer ") == "data"
    assert ev(N.normalize_role(C), c="engineering") == ""
    assert ev(N.display_name(C), c="scale-ai-23andme") == "Scale Ai 23Andme"
    assert ev(N.guess_company(C), c="Acme Robots is great") == "Acme Robots"
    assert ev(N.guess_company(C), c="Come work at Big Co, now") == "Big Co"
    assert ev(N.guess_company(C), c="no names here") is None


def test_costly_values_are_computed_once(spark):
    """A text that must be long enough, and a feed's location, are each read once a row."""
    from jobspan.functions.text import at_least

    plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(
        at_least(F.regexp_replace("s", "once", ""), 3).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("once") == 1


def test_html_guards_change_nothing(ev):
    from jobspan.functions.text import html_to_text, smart_quotes

    pages = {"a<SCRIPT>x</SCRIPT>b": "a\nb", "a<style>x</style>b": "a\nb", "a<!-- x -->b<p>c": "a\nb\nc", "a<span>b</span>": "a\nb",
             "<p>café “x”</p>": "café \"x\"", "<p>a b</p>": "a b", "plain": "plain", "": ""}
    assert {p: ev(html_to_text(F.col("p")), p=p) for p in pages} == pages
    assert ev(smart_quotes(F.col("p")), p="‘a’") == "'a'"
