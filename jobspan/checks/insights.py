"""Aggregates and role reports over all postings."""
from pyspark.sql import functions as F

from jobspan import bindings as B
from jobspan.checks.registry import query
from jobspan.functions.scores import epoch_hours
from jobspan.operators import insights as I
from jobspan.plans import career

P = "with " + B.POSTINGS_SQL
ROLES = {"Plate maker": ["plate", "anvil"], "Ring maker": ["hot ring", "old ring"], "Bolt maker": ["bolt"]}
ROLES_SQL = """, matched as (
select 'Plate maker' as role, * from postings where title ilike '%plate%' or title ilike '%anvil%'
union all select 'Ring maker', * from postings where title ilike '%hot ring%' or title ilike '%old ring%'
union all select 'Bolt maker', * from postings where title ilike '%bolt%')"""


def _top(alias: str, expr: str, where: str, n: int, frm: str = "postings") -> str:
    return f"{P} select {expr} as {alias}, count(*) as cnt from {frm} {where} group by 1 order by cnt desc, 1 limit {n}"


_EXPLODED = "(select title, unnest(skills) as skill from postings)"


@query("scan_postings", P + """ select id, company_name, title, link, location, posted_date, source,
 array_to_string(skills, '|') as skills, experience_years, len(embedding) as dim, description from postings""")
def scan_postings(spark, d):
    return B.postings(spark, d).select(
        "id", "company_name", "title", "link", "location", "posted_date", "source",
        F.array_join("skills", "|").alias("skills"), "experience_years",
        F.size("embedding").cast("long").alias("dim"), "description")


@query("popular_skills", _top("skill", "skill", "", 100, _EXPLODED))
def popular_skills(spark, d):
    return I.popular_skills(B.postings(spark, d), 100)


@query("skills_for_role", _top("skill", "skill", "where title ilike '%ring%'", 25, _EXPLODED))
def skills_for_role(spark, d):
    return I.popular_skills(B.postings(spark, d), 25, "ring")


@query("top_companies", _top("company", "company_name", "where company_name is not null", 25))
def top_companies(spark, d):
    return I.top_companies(B.postings(spark, d), 25)


@query("top_companies_for_role",
       _top("company", "company_name", "where company_name is not null and title ilike '%bolt%'", 25))
def top_companies_for_role(spark, d):
    return I.top_companies(B.postings(spark, d), 25, "bolt")


@query("average_years", P + """ select round(coalesce(avg(experience_years), 0), 1) as avg_experience_years,
 count(experience_years) as matching_jobs from postings where title ilike '%gear%'""")
def average_years(spark, d):
    return I.average_years(B.postings(spark, d), "gear")


_OVERVIEW = P + """, s as (
 select skill as name, count(*) as cnt from (select title, unnest(skills) as skill from postings)
 where title ilike '%widget%' group by 1 order by cnt desc, 1 limit 15), c as (
 select company_name as name, count(*) as cnt from postings
 where title ilike '%widget%' and company_name is not null group by 1 order by cnt desc, 1 limit 10)
 select 'skill' as kind, name, cnt from s union all select 'company', name, cnt from c union all
 select 'years', cast(round(avg(experience_years), 1) as varchar), count(experience_years) from postings
 where title ilike '%widget%'"""


def _parts(one):
    parts = F.concat(
        F.transform("top_skills", lambda s: F.struct(F.lit("skill").alias("kind"), s["skill"].alias("name"),
                                                     s["count"].alias("cnt"))),
        F.transform("top_companies", lambda s: F.struct(F.lit("company").alias("kind"), s["company"].alias("name"),
                                                        s["count"].alias("cnt"))),
        F.array(F.struct(F.lit("years").alias("kind"), F.col("avg_experience_years").cast("string").alias("name"),
                         F.col("matching_jobs").alias("cnt"))))
    return one.select(F.inline(parts))


@query("role_overview", _OVERVIEW)
def role_overview(spark, d):
    return _parts(I.role_overview(B.postings(spark, d), "widget"))


@query("roles_overview", P + ROLES_SQL + """, names as (
 select role, 'skill' as kind, unnest(skills) as name from matched
 union all select role, 'company', company_name from matched where company_name is not null), counts as (
 select role, kind, name, count(*) as cnt from names group by all), placed as (
 select *, row_number() over (partition by role, kind order by cnt desc, name) as place from counts)
 select * from placed where place <= case when kind = 'skill' then 15 else 10 end""")
def roles_overview(spark, d):
    return I.roles_overview(B.postings(spark, d), ROLES).withColumn("place", F.col("place").cast("long"))


@query("role_matches", P + ROLES_SQL + " select role, id, title from matched")
def role_matches(spark, d):
    return I.role_matches(B.postings(spark, d), ROLES).select("role", "id", "title")


@query("role_samples", P + ROLES_SQL + """ select role, sample, id, title from (
 select *, row_number() over (partition by role order by id) as sample from matched where description is not null)
 where sample <= 5""")
def role_samples(spark, d):
    rows = I.role_samples(B.postings(spark, d), ROLES)
    return rows.select("role", F.col("sample").cast("long").alias("sample"), "id", "title")


@query("role_requests", P + ROLES_SQL + """, picked as (select * from (
 select *, row_number() over (partition by role order by id) as sample from matched where description is not null)
 where sample <= 5) select role, string_agg('Title: ' || title || chr(10) || 'Company: ' || coalesce(company_name, '') || chr(10) ||
 chr(10) || 'Description:' || chr(10) || description, chr(10) || chr(10) || '---' || chr(10) || chr(10)
 order by sample) as postings from picked group by role""")
def role_requests(spark, d):
    return I.role_requests(I.role_samples(B.postings(spark, d), ROLES))


@query("skill_gap", P + """, top as (
 select skill, count(*) as cnt from (select title, unnest(skills) as skill from postings)
 where title ilike '%rod%' group by 1 order by cnt desc, 1 limit 20), split as (
 select case when lower(skill) in ('rod', 'red', 'brand#4') then 'you_have' else 'consider_learning' end as side,
 skill, cnt from top), placed as (
 select *, row_number() over (partition by side order by cnt desc, skill) as place from split)
 select * from placed where place <= 10""")
def skill_gap(spark, d):
    rows = I.skill_gap(B.postings(spark, d), "rod", ["Rod", "red", "BRAND#4"])
    return rows.withColumn("place", F.col("place").cast("long"))


@query("posting_totals", P + """ select count(*) as postings,
 count(*) filter (coalesce(description, '') <> '') as described from postings""")
def posting_totals(spark, d):
    return I.totals(B.postings(spark, d))


@query("distinct_suppliers", "select distinct s_name as name from supplier where s_name is not null order by 1")
def distinct_suppliers(spark, d):
    return I.distinct_names(B.table(spark, d, "supplier").withColumnRenamed("s_name", "name"), "name")


@query("sorted_names", "select distinct c_mktsegment as name from customer order by 1")
def sorted_names(spark, d):
    return I.distinct_names(B.table(spark, d, "customer").withColumnRenamed("c_mktsegment", "name"), "name")


@query("repeatable_sample", P + """ select id, title from postings order by md5(id || '|7'), id limit 5""")
def repeatable_sample(spark, d):
    return I.repeatable_sample(B.postings(spark, d), 5, seed=7).select("id", "title")


@query("epoch_hours", "select o_orderkey, cast(round(epoch(o_orderdate) / 3600) as int) as added_at from orders")
def hours_stamp(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", epoch_hours(F.col("o_orderdate")).alias("added_at"))


def _branch(q):
    return lambda spark, d: career.answer_data(B.postings(spark, d), q)


query("question_top_skills", _top("skill", "skill", "", 30, _EXPLODED))(_branch(career.Question("top_skills")))
query("question_skills_for_role", _top("skill", "skill", "where title ilike '%blue gear%'", 25, _EXPLODED))(
    _branch(career.Question("skills_for_role", "Blue Gear Engineer")))
query("question_top_companies", _top("company", "company_name",
      "where company_name is not null and title ilike '%plate%'", 25))(
    _branch(career.Question("top_companies", "plate job")))
query("question_skill_gap", P + """, top as (
 select skill, count(*) as cnt from (select title, unnest(skills) as skill from postings)
 where title ilike '%bolt%' group by 1 order by cnt desc, 1 limit 20), placed as (
 select case when lower(skill) in ('bolt', 'new') then 'you_have' else 'consider_learning' end as side, skill, cnt,
 row_number() over (partition by lower(skill) in ('bolt', 'new') order by cnt desc, skill) as place from top)
 select side, cast(place as int) as place, skill, cnt from placed where place <= 10""")(
    _branch(career.Question("skill_gap", "bolt role", ("Bolt", "new"))))


@query("answer_context", P + """, top as (
 select skill, count(*) as cnt from (select unnest(skills) as skill from postings)
 group by 1 order by cnt desc, 1 limit 30)
 select count(*) > 0 as grounded,
 string_agg('{"skill":"' || skill || '","cnt":' || cnt || '}', chr(10) order by cnt desc, skill) as data,
 (select count(*) from postings) as n_jobs from top""")
def answer_context(spark, d):
    return career.answer_context(B.postings(spark, d), career.Question("top_skills"))


query("question_role_overview", _OVERVIEW)(
    lambda spark, d: _parts(career.answer_data(B.postings(spark, d), career.Question("role_overview", "Widget Engineer"))))


@query("answer_contexts", P + """, all_jobs as (select count(*) as n from postings), skills as (select title, unnest(skills) as skill from postings)
 select 'top_companies' as category, count(*) > 0 as grounded, least(count(*), 25) as n_lines, (select n from all_jobs) as n_jobs from
 (select distinct company_name from postings where company_name is not null and title ilike '%plate%')
 union all select 'skills_for_role', count(*) > 0, least(count(*), 25), (select n from all_jobs) from
 (select distinct skill from skills where title ilike '%blue gear%')
 union all select 'skill_gap', count(*) > 0, least(count(*) filter (have), 10) + least(count(*) filter (not have), 10), (select n from all_jobs)
 from (select lower(skill) in ('bolt', 'new') as have from skills where title ilike '%bolt%' group by skill order by count(*) desc, skill limit 20)
 union all select 'role_overview', count(*) > 0, 1, (select n from all_jobs) from postings where title ilike '%widget%'
 union all select 'skills_for_role', false, 0, n from all_jobs""")
def answer_contexts(spark, d):
    """Whether each kind of question has an answer to rest on, and how many lines it has; the last asks for a role that nobody offers."""
    asked = [career.Question("top_companies", "plate job"), career.Question("skills_for_role", "Blue Gear Engineer"),
             career.Question("skill_gap", "bolt role", ("Bolt", "new")), career.Question("role_overview", "widget"),
             career.Question("skills_for_role", "no such role")]
    out = None
    for q in asked:
        one = career.answer_context(B.postings(spark, d), q)
        n = F.when(F.coalesce("data", F.lit("")) == "", 0).otherwise(F.size(F.split("data", "\n")))
        one = one.select(F.lit(q.category).alias("category"), "grounded", n.cast("long").alias("n_lines"), "n_jobs")
        out = one if out is None else out.unionByName(one)
    return out
