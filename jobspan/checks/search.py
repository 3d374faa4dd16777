"""Searches over all postings and all vectors."""
from pyspark.sql import functions as F

from jobspan import bindings as B
from jobspan.checks.registry import query
from jobspan.functions import scores as S
from jobspan.functions import skills as K
from jobspan.functions.vectors import cosine, cosine_to
from jobspan.operators import retrieval as R
from jobspan.operators.vector_search import ListIndex
from jobspan.plans import search as Q

NOW = B.NOW
P = "with " + B.POSTINGS_SQL
QVEC = "(select embedding from embeddings where vec_id = 7)"
COS = ("list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))")
# Written out: the SQL borrows no value from the code that it checks.
STOP = """['engineer', 'engineering', 'senior', 'junior', 'lead', 'staff', 'developer', 'manager', 'analyst', 'scientist', 'experience',
 'years', 'with', 'and', 'or', 'for', 'the', 'in', 'on', 'at', 'using', 'knowledge', 'strong', 'good', 'background']"""
MODE_WEIGHTS = {  # by: skills given, years given
    (True, True): (0.25, 0.25, 0.20, 0.05, 0.05, 0.20), (True, False): (0.30, 0.30, 0.00, 0.10, 0.10, 0.20),
    (False, True): (0.35, 0.00, 0.30, 0.10, 0.10, 0.15), (False, False): (0.50, 0.00, 0.00, 0.10, 0.15, 0.25)}
TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z0-9+#./]*'))"
SEARCH = Q.Search("hot ring with brand#4", Q.Filters(skills=["ring", "hot", "Brand#4"], min_years=5,
                                                   title_aliases=["blue gear", "old_bolt", "red plate"]), top_n=20)


def facts_sql(vec: str = QVEC, query_text: str = "'hot ring with brand#4'", where: str = "embedding is not null") -> str:
    want = f"list_filter({TOK.format(query_text)}, lambda t: not list_contains({STOP}, t))"
    return f"""facts as (
 select id, title, company_name as company, location, experience_years, coalesce(skills, []) as skills, link, source,
 case when posted_date is not null then
   cast(trunc(round(epoch(timestamp '{NOW}') - epoch(posted_date)) / 3600) as int) end as hours_since_posted,
 {COS.format(a='embedding', b=vec)} as vec_score,
 {want} as wanted, {TOK.format("title || ' ' || coalesce(company_name, '')")} as words, {TOK.format('title')} as twords
 from postings where {where})"""


def scored_sql(frm: str, w, manual="[]", resume="[]", min_years=None, wanted="wanted", title_wanted="wanted") -> str:
    """The hybrid score in SQL over rows of facts."""
    low = "list_transform(skills, lambda s: lower(s))"
    man = (f"case when len({manual}) = 0 then 1.0 else cast(len(list_filter({manual}, lambda s: "
           f"list_contains({low}, lower(s)))) as double) / len({manual}) end")
    res = (f"case when len({resume}) = 0 then 1.0 when len(skills) = 0 then 0.0 else least(1.0, "
           f"cast(len(list_filter({resume}, lambda s: list_contains({low}, lower(s)))) as double) "
           f"/ greatest(1, ceil(len(skills) * 0.35))) end")
    exp = "cast(1.0 as double)" if min_years is None else (
        f"cast(case when experience_years is null then 0.6 when experience_years >= {min_years} then 1.0 "
        f"else round(experience_years / cast({min_years} as double), 4) end as double)")
    over = (f"case when len({wanted}) = 0 then 0.0 else cast(len(list_intersect({wanted}, "
            f"list_concat({low}, twords))) as double) / len({wanted}) end")
    lex = (f"case when len({title_wanted}) = 0 then 0.0 else least(1.0, "
           f"cast(len(list_intersect({title_wanted}, words)) as double) / len({title_wanted}) * 0.5 * 2.0) end")
    rec = "coalesce(exp(-ln(2) * hours_since_posted / 336), 0.40)"
    return f"""parts as (select *, ({man}) * ({res}) as f, {exp} as e, {over} as o, {lex} as t, {rec} as r from {frm}),
 scored as (select *, round(o, 4) as skill_overlap, round(f, 4) as filter_score, round(e, 4) as exp_score,
 round({w[0]} * vec_score + {w[1]} * f + {w[2]} * e + {w[3]} * o + {w[4]} * t + {w[5]} * r, 4) as hybrid_score
 from parts)"""


OUT = ("id, title, company, location, experience_years, array_to_string(skills, '|') as skills, link, source, "
       "hours_since_posted, round(vec_score, 4) as vec_score, hybrid_score, skill_overlap, filter_score, exp_score")
CAND = """near as (select *, 0 as origin from facts order by round(vec_score, 10) desc, id limit {k})"""
RANK = "row_number() over ({per} order by hybrid_score desc, origin, case when origin = 0 then round(vec_score, 10) end desc nulls last, id)"
STAFF = r"\b(staffing|recruiting|supplier#000000004|supplier#000000012)\b"


def flat(df):
    return df.withColumn("skills", F.array_join("skills", "|"))


def _longs(df, *cols):
    return df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])


HYBRID_SQL = f"""{P}, {facts_sql()}, {CAND.format(k=250)},
 alias as (select *, 1 as origin from facts where contains(lower(title), 'blue gear')
   or contains(lower(title), 'old_bolt') or contains(lower(title), 'red plate') order by id limit 50),
 found as (select * from near union all select * from alias where id not in (select id from near)),
 {scored_sql('found', (0.25, 0.25, 0.20, 0.05, 0.05, 0.20), "['ring', 'hot', 'Brand#4']", "[]", 5)},
 ranked as (select *, {RANK.format(per='')} as rk from scored),
 kept as (select * from ranked where not (lower(source) = 'linkedin' and regexp_matches(coalesce(company, ''),
   '(?i)\\b(staffing|staffers?|recruit(?:ing|ment|ers?)?|placement|headhunt(?:ers?|ing)?|outsourc(?:ing|e)|manpower|hiring)\\b|\\bhire\\b'))),
 capped as (select *, row_number() over (partition by lower(source) order by rk)
   > case lower(source) when 'linkedin' then 50 when 'greenhouse' then 30 when 'indeed' then 20 else 100 end as over
   from kept),
 pool as (select *, row_number() over (order by over, rk) as pool_rank from capped qualify pool_rank <= 100),
 placed as (select *, row_number() over (order by round(vec_score, 10) desc, pool_rank) as rank,
   count(*) over () as total from pool)
 select rank, total, {OUT} from placed where rank <= 20"""


@query("hybrid_search", HYBRID_SQL)
def hybrid_search(spark, d):
    vec = Q.query_vector(B.table(spark, d, "embeddings"), 7)
    return _longs(flat(Q.hybrid_search(B.postings(spark, d), vec, SEARCH, NOW)), "rank", "total")


@query("vector_top_k", f"""{P}, {facts_sql()} select id, round(vec_score, 4) as vec_score from facts
 order by round(facts.vec_score, 10) desc, id limit 250""")
def vector_top_k(spark, d):
    vec = Q.query_vector(B.table(spark, d, "embeddings"), 7)
    rows = B.postings(spark, d).where(R.search_predicates()).select(
        "id", cosine_to(vec, F.col("embedding")).alias("vec_score"))
    return R.top_k(rows, "vec_score", 250).withColumn("vec_score", F.round("vec_score", 4))


@query("search_predicates", P + f""" select id, source, location from postings where embedding is not null
 and location ilike '%europe%' and posted_date >= timestamp '{NOW}' - interval 20000 hour
 and source in ('linkedin', 'lever')""")
def search_predicates(spark, d):
    test = R.search_predicates("Europe", 20000, ["linkedin", "lever"], NOW)
    return B.postings(spark, d).where(test).select("id", "source", "location")


@query("alias_titles", P + """ select id, title from postings
 where title ilike '%blue gear%' or title ilike '%red plate%' or contains(lower(title), 'old_bolt')""")
def alias_titles(spark, d):
    return B.postings(spark, d).where(
        R.ilike_any(F.col("title"), ["Blue Gear", "old_bolt", "red plate"])).select("id", "title")


@query("vector_and_alias_hits", f"""{P}, {facts_sql()}, {CAND.format(k=100)},
 alias as (select *, 1 as origin from facts where title ilike '%hot bolt%' order by id limit 50)
 select id, origin from near union all select id, origin from alias where id not in (select id from near)""")
def vector_and_alias_hits(spark, d):
    vec = Q.query_vector(B.table(spark, d, "embeddings"), 7)
    f = Q.Filters(title_aliases=["hot bolt"])
    return Q.candidates(B.postings(spark, d), vec, "hot ring with brand#4", f, 100, NOW).select("id", "origin")


@query("simple_search", f"""{P}, {facts_sql()}, {CAND.format(k=30)}, {scored_sql('near', (0.50, 0.00, 0.00, 0.10, 0.15, 0.25))},
 ranked as (select *, {RANK.format(per='')} as rank from scored) select rank, {OUT} from ranked where rank <= 10""")
def simple_search(spark, d):
    vec = Q.query_vector(B.table(spark, d, "embeddings"), 7)
    rows = flat(Q.simple_search(B.postings(spark, d), vec, SEARCH.query, NOW))
    return _longs(rows, "rank").withColumn("vec_score", F.round("vec_score", 4))


def _scores(name, sql, cols):
    @query(name, P + f" select id, {sql} from postings")
    def run(spark, d):
        return B.postings(spark, d).select("id", *cols())

    return run


_HOURS = (f"case when posted_date is not null then cast(trunc(round(epoch(timestamp '{NOW}') - epoch(posted_date)) "
          "/ 3600) as int) end")


def _h():
    return S.hours_since(F.col("posted_date"), NOW)


_scores("hours_since_posted", f"{_HOURS} as hours", lambda: [_h().alias("hours")])
_scores("recency_score", f"round(coalesce(exp(-ln(2) * {_HOURS} / 336), 0.40), 6) as recency",
        lambda: [F.round(S.recency_score(_h()), 6).alias("recency")])
_scores("experience_score", "cast(case when experience_years is null then 0.6 when experience_years >= 8 then 1.0 "
        "else round(experience_years / 8.0, 4) end as double) as score",
        lambda: [S.experience_score(F.col("experience_years"), 8).alias("score")])
_scores("skill_filter_scores", """round(cast(len(list_filter(['Ring', 'blue', 'ring', 'x'], lambda s:
 list_contains(list_transform(coalesce(skills, []), lambda q: lower(q)), lower(s)))) as double) / 4, 4) as manual,
 round(case when len(coalesce(skills, [])) = 0 then 0.0 else least(1.0, cast(len(list_filter(['gear', 'BLUE'],
 lambda s: list_contains(list_transform(skills, lambda q: lower(q)), lower(s)))) as double)
 / greatest(1, ceil(len(skills) * 0.35))) end, 4) as resume""",
        lambda: [F.round(S.manual_skill_score(F.col("skills"), ["Ring", "blue", "ring", "x"]), 4).alias("manual"),
                 F.round(S.resume_skill_score(F.col("skills"), ["gear", "BLUE"]), 4).alias("resume")])
_scores("posted_label", f"""case when {_HOURS} is null then 'Recently posted' when {_HOURS} < 1 then 'Just posted'
 when {_HOURS} < 24 then 'Posted ' || {_HOURS} || 'h ago' when {_HOURS} < 48 then 'Posted 1 day ago'
 when {_HOURS} < 720 then 'Posted ' || cast(floor({_HOURS} / 24) as int) || ' days ago' else 'Posted 30+ days ago'
 end as label""", lambda: [S.posted_label(_h()).alias("label")])
_scores("first_skills", """array_to_string(list_slice(skills, 1, 2), '|') as shown,
 greatest(len(coalesce(skills, [])) - 2, 0) as more""",
        lambda: [F.array_join(K.first_skills(F.col("skills"), 2), "|").alias("shown"),
                 K.more_skills(F.col("skills"), 2).cast("long").alias("more")])


@query("query_tokens", f"""select doc_id, array_to_string(list_sort(list_filter({TOK.format('text')},
 lambda t: not list_contains({STOP}, t))), ' ') as tokens from documents""")
def query_tokens(spark, d):
    return B.table(spark, d, "documents").select(
        "doc_id", F.array_join(F.array_sort(S.query_tokens(F.col("text"))), " ").alias("tokens"))


@query("overlap_score", f"""{P}, {facts_sql(where='true')} select id, round(case when len(wanted) = 0 then 0.0 else
 cast(len(list_intersect(wanted, list_concat(list_transform(skills, lambda s: lower(s)), twords))) as double)
 / len(wanted) end, 4) as overlap,
 round(least(1.0, cast(len(list_intersect(wanted, words)) as double) / len(wanted)), 4) as lexical from facts""")
def overlap_score(spark, d):
    wanted = S.query_tokens(F.lit(SEARCH.query))
    return B.postings(spark, d).select(
        "id", F.round(S.overlap_score(wanted, F.col("skills"), F.col("title")), 4).alias("overlap"),
        F.round(S.lexical_score(wanted, F.col("title"), F.col("company_name")), 4).alias("lexical"))


@query("cosine_similarity", f"""select e.vec_id, round({COS.format(a='e.embedding', b=QVEC)}, 4) as sim,
 round({COS.format(a='e.embedding', b='o.embedding')}, 4) as label_sim
 from embeddings e join embeddings o on o.vec_id = e.label""")
def cosine_similarity(spark, d):
    e = B.table(spark, d, "embeddings")
    o = e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("other"))
    return e.join(o, "label").select(
        "vec_id", F.round(cosine_to(Q.query_vector(e, 7), F.col("embedding")), 4).alias("sim"),
        F.round(cosine(F.col("embedding"), F.col("other")), 4).alias("label_sim"))


_MODES = {"plain": ([], [], None), "skills": (["ring", "red"], [], None), "resume": ([], ["gear", "hot", "old"], None),
          "years": ([], [], 6), "skills_years": (["ring", "red"], [], 6), "resume_years": ([], ["gear", "hot"], 6)}
for _mode, (_man, _res, _yrs) in _MODES.items():
    def _run(spark, d, man=_man, res=_res, yrs=_yrs):
        vec = Q.query_vector(B.table(spark, d, "embeddings"), 7)
        rows = Q.candidates(B.postings(spark, d), vec, SEARCH.query, Q.Filters(), 500, NOW)
        out = Q.score_candidates(rows, S.query_tokens(F.lit(SEARCH.query)), man, res, yrs, bool(man or res),
                                 yrs is not None)
        return out.select("id", "skill_overlap", "filter_score", "exp_score", "hybrid_score",
                          S.match_percent(F.col("hybrid_score")).alias("percent"),
                          S.match_band(S.match_percent(F.col("hybrid_score"))).alias("band"))

    _pct = "cast(greatest(least(round(hybrid_score * 100), 100), 0) as int)"
    query(f"hybrid_score_{_mode}", f"""{P}, {facts_sql()}, {CAND.format(k=500)},
 {scored_sql('near', MODE_WEIGHTS[bool(_man or _res), _yrs is not None], str(_man), str(_res), _yrs)}
 select id, skill_overlap, filter_score, exp_score, hybrid_score, {_pct} as percent,
 case when {_pct} >= 85 then 'excellent' when {_pct} >= 70 then 'good' when {_pct} >= 50 then 'fair' else 'weak'
 end as band from scored""")(_run)


@query("staffing_filter", P + """ select id, source, company_name from postings where not (source = 'linkedin' and
 regexp_matches(coalesce(company_name, ''), '(?i)supplier#0000000\\d[048]'))""")
def staffing_filter(spark, d):
    keep = Q.not_staffing(F.col("source"), F.col("company_name"), r"supplier#0000000\d[048]")
    return B.postings(spark, d).where(keep).select("id", "source", "company_name")


@query("source_mix", P + """, ranked as (select id, source, row_number() over (order by experience_years desc nulls last,
 id) as rank from postings), capped as (select *, row_number() over (partition by source order by rank)
 > case source when 'linkedin' then 100 when 'greenhouse' then 60 when 'indeed' then 40 else 200 end as over from ranked)
 select id, source, pool_rank from (select *, row_number() over (order by over, rank) as pool_rank from capped)
 where pool_rank <= 200""")
def source_mix(spark, d):
    order = [F.desc_nulls_last("experience_years"), F.col("id")]
    return R.diversify(B.postings(spark, d), 200, order).select("id", "source", F.col("pool_rank").cast("long").alias("pool_rank"))


@query("result_pages", P + """, placed as (select id, experience_years, row_number() over (order by experience_years
 desc nulls last, id) as rank, count(*) over () as total from (select * from postings order by id desc limit 100))
 select id, rank, total, cast(least(ceil(total / 20.0), 5) as bigint) as pages from placed
 where rank > 20 and rank <= 40""")
def result_pages(spark, d):
    pool = B.postings(spark, d).orderBy(F.desc("id")).limit(100).select("id", "experience_years")
    rows = R.page(pool, 2, 20, [F.desc_nulls_last("experience_years"), F.col("id")])
    return _longs(rows.withColumn("pages", R.page_count(F.col("total"))), "rank", "total", "pages").drop(
        "experience_years")


@query("recent_results", P + f""", h as (select id, {_HOURS} as hours_since_posted from postings)
 select id, hours_since_posted, row_number() over (order by hours_since_posted asc nulls last, id) as place from h""")
def recent_results(spark, d):
    """All postings, most recent first, with their places."""
    return all_recent_results(spark, d)


@query("all_recent_results", P + f""", h as (select id, {_HOURS} as hours_since_posted from postings)
 select id, hours_since_posted, row_number() over (order by hours_since_posted asc nulls last, id) as place from h""")
def all_recent_results(spark, d):
    rows = B.postings(spark, d).select("id", _h().alias("hours_since_posted"))
    return R.placed(rows, [F.asc_nulls_last("hours_since_posted"), F.col("id")])


_QUERY = "(select * from embeddings where vec_id % 100 = 0)"


def neighbours_sql(asked: str) -> str:
    """The nearest postings of some rows of embeddings."""
    return f"""{P} select q.vec_id as query_id, i.id, round({COS.format(a='q.embedding', b='i.embedding')}, 4)
 as vec_score from {asked} q, postings i where i.embedding is not null
 qualify row_number() over (partition by q.vec_id order by round({COS.format(a='q.embedding', b='i.embedding')}, 10) desc,
 i.id) <= 20"""


def _query_vectors(spark, d):
    """Every vector whose id is divisible by 100, as the queries whose SQL states them so ask."""
    return B.table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0)


def _asked(e):
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _queries(spark, d):
    return _asked(_query_vectors(spark, d))


@query("posting_neighbours", neighbours_sql("embeddings"))
def posting_neighbours(spark, d):
    """Of every vector."""
    near = R.batch_top_k(B.postings(spark, d).where("embedding is not null"), _asked(B.table(spark, d, "embeddings")), 20)
    return near.withColumn("vec_score", F.round("vec_score", 4))


def _index(spark, d, **how):
    """About the square root of the number of items as lists."""
    items = B.postings(spark, d).where("embedding is not null").select("id", "embedding")
    return ListIndex.build(items, max(1, round(items.count() ** 0.5)), **how)


@query("indexed_neighbours", neighbours_sql(_QUERY))
def indexed_neighbours(spark, d):
    """All inverted lists are probed, which is exact."""
    index = _index(spark, d)
    return index.top_k(_queries(spark, d), 20, probes=len(index.centers)).withColumn("vec_score", F.round("vec_score", 4))


@query("neighbour_recall", f"select vec_id as query_id, true as reached from {_QUERY}")
def neighbour_recall(spark, d):
    """Whether two thirds of the lists, each item in two, hold at least nine tenths of the exact neighbours of all queries together. These
    vectors are nearly without groups, which is the hard case; fewer lists do where there are any."""
    index = _index(spark, d, copies=2)
    near = index.top_k(_queries(spark, d), 20, probes=-(-2 * len(index.centers) // 3)).withColumn("hit", F.lit(1)).drop("vec_score")
    exact = R.batch_top_k(B.postings(spark, d).where("embedding is not null"), _queries(spark, d), 20)
    found = exact.join(near, ["query_id", "id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("reached"))
    return _queries(spark, d).select("query_id", F.lit(found.first().reached).alias("reached"))


def _resumes(spark, d, e):
    """A résumé for each vector of ``e``: the part's words are the skills (none on some), its type the summary."""
    p = B.table(spark, d, "part")
    return e.join(p, p.p_partkey == e.vec_id).select(
        F.col("vec_id").alias("resume_id"), F.col("embedding").alias("vec"),
        F.when(F.col("p_size") > 10, F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("skills"),
        F.concat_ws(" ", F.lit("senior"), "p_name", "p_type").alias("summary"))


def _matches(spark, d, e):
    return Q.match_resumes(B.postings(spark, d), _resumes(spark, d, e), NOW, k=50, max_hours_old=20000)


def matches_sql(people: str) -> str:
    """Ranked matches of the résumés of some rows of embeddings."""
    return f"""{P}, people as (select e.vec_id as resume_id, e.embedding as vec,
 case when p_size > 10 then string_split(p_name || ' ' || p_brand, ' ') else [] end as owned,
 list_filter({TOK.format("'senior ' || p_name || ' ' || p_type")}, lambda t: not list_contains({STOP}, t)) as wanted
 from {people} e join part p on p.p_partkey = e.vec_id),
 fresh as (select *, {_HOURS} as hours_since_posted from postings where embedding is not null
   and posted_date >= timestamp '{NOW}' - interval 20000 hour),
 pairs as (select resume_id, i.id, {COS.format(a='vec', b='i.embedding')} as vec_score from people, fresh i),
 near as (select * from pairs qualify row_number() over (partition by resume_id order by round(vec_score, 10) desc, id)
   <= 50),
 found as (select n.resume_id, n.vec_score, f.id, title, company_name as company, location, experience_years,
   coalesce(skills, []) as skills, link, source, hours_since_posted, owned, wanted, 0 as origin,
   {TOK.format("title || ' ' || coalesce(company_name, '')")} as words, {TOK.format('title')} as twords
   from near n join fresh f on f.id = n.id join people using (resume_id)),
 {scored_sql('found', tuple(f'(case when len(owned) > 0 then {a} else {b} end)' for a, b in zip((0.30, 0.30, 0.00, 0.10, 0.10, 0.20), (0.50, 0.00, 0.00, 0.10, 0.15, 0.25))), '[]', 'owned')},
 ranked as (select *, {RANK.format(per='partition by resume_id')} as rank from scored)
"""


@query("match_resumes", matches_sql("embeddings") + f""" select resume_id, rank, {OUT} from ranked where rank <= 20""")
def match_resumes(spark, d):
    return _longs(flat(_matches(spark, d, B.table(spark, d, "embeddings"))), "rank").withColumn("vec_score", F.round("vec_score", 4))


@query("explanation_requests", matches_sql("embeddings") + """ select resume_id, '[' || string_agg('{"id":' || id || ',"title":"' || title || '",' ||
 coalesce('"company":"' || company || '",', '') || coalesce('"location":"' || location || '",', '') ||
 coalesce('"experience_years":' || experience_years || ',', '') || '"skills":[' ||
 coalesce('"' || nullif(array_to_string(list_slice(skills, 1, 12), '","'), '') || '"', '') || ']}', ',' order by rank) || ']' as jobs
 from ranked where rank <= 20 group by 1""")
def explanation_requests(spark, d):
    return Q.jobs_json(_matches(spark, d, B.table(spark, d, "embeddings")), 12, location=True)


_NEAR = f"""near as (select q.vec_id as query_id, i.id, row_number() over (partition by q.vec_id
 order by round({COS.format(a='q.embedding', b='i.embedding')}, 10) desc, i.id) as rank
 from embeddings q, postings i where i.embedding is not null qualify rank <= 20)"""


@query("rerank", f"""{P}, {_NEAR}, answers as (select vec_id as query_id,
 unnest([vec_id, vec_id * 7 % 500, vec_id, label + 10]) as id, unnest([0, 1, 2, 3]) as pos from embeddings),
 firsts as (select query_id, id, min(pos) as pos from answers group by all)
 select query_id, id, new_rank from (select n.query_id, n.id, row_number() over (partition by n.query_id
 order by pos asc nulls last, rank) as new_rank from near n left join firsts f on f.query_id = n.query_id
 and f.id = n.id) where new_rank <= 10""")
def rerank(spark, d):
    e = B.table(spark, d, "embeddings")
    near = R.batch_top_k(B.postings(spark, d).where("embedding is not null"), _asked(e), 20)
    w = R.Window.partitionBy("query_id").orderBy(F.desc(F.round("vec_score", 10)), "id")
    prior = near.withColumn("rank", F.row_number().over(w))
    v = F.col("vec_id")
    ranking = e.select(v.alias("query_id"), F.array(v, v * 7 % 500, v, F.col("label") + 10).alias("ids"))
    out = R.rerank(prior, ranking, 10, per=["query_id"])
    return out.select("query_id", "id", F.col("new_rank").cast("long").alias("new_rank"))


@query("saved_search_text", """select c_custkey, concat_ws(' ', nullif(lower(c_mktsegment), 'machinery'), 'jobs',
 case when c_nationkey > 5 then c_nationkey || '+ years' end, 'in ' || nullif(trim(n_name), 'NATION_3'),
 case when c_acctbal < 0 then 'remote' end) as query
 from customer join nation on n_nationkey = c_nationkey""")
def saved_search_text(spark, d):
    c, n = B.table(spark, d, "customer"), B.table(spark, d, "nation")
    saved = c.join(n, n.n_nationkey == c.c_nationkey).select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.array(F.lower("c_mktsegment"))).alias("skills"),
        F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("experience"),
        F.when(F.col("n_name") != "NATION_3", F.col("n_name")).alias("location"),
        (F.col("c_acctbal") < 0).alias("remote"))
    return saved.select("c_custkey", Q.query_text(saved).alias("query"))


@query("merged_intent", """select o_orderkey as query_id,
 case when o_orderstatus = 'F' then o_orderpriority else 'query ' || o_orderkey end as query,
 nullif(case when o_custkey % 2 = 0 then 'Europe' else '' end, '') as location,
 coalesce(case when o_orderstatus = 'O' then 3 end, cast(o_custkey % 7 as int)) as min_years,
 case when o_orderstatus = 'P' then 'sql' else 'spark|python' end as skills
 from orders""")
def merged_intent(spark, d):
    o = B.table(spark, d, "orders")
    given = o.select(
        F.col("o_orderkey").alias("query_id"), F.concat(F.lit("query "), F.col("o_orderkey").cast("string")).alias("query"),
        F.when(F.col("o_custkey") % 2 == 0, "Europe").otherwise("").alias("location"),
        F.when(F.col("o_orderstatus") == "O", 3).alias("min_years"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("sql"))).otherwise(
            F.array().cast("array<string>")).alias("skills"),
        F.lit(None).cast("int").alias("max_hours_old"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("x_query"),
        (F.col("o_custkey") % 7).cast("int").alias("x_min_years"), F.lit(24).alias("x_max_hours_old"),
        F.array(F.lit("spark"), F.lit("python")).alias("x_skills"),
        F.array().cast("array<string>").alias("x_title_aliases"))
    return Q.merge_intent(given).select("query_id", "query", "location", "min_years",
                                        F.array_join("skills", "|").alias("skills"))


# ------------------------------------------------------------------ parameters of searches, as tables
@query("request_guards", """select o_orderkey, case when trim(q) = '' then 'query' when n not between 1 and 100 then 'top_n'
 when c not between 10 and 500 then 'candidates' when p not between 1 and 10 then 'page' end as fault,
 o_custkey % 520 between 3 and 500 as question_ok, o_custkey % 33 between 1 and 30 as ids_ok
 from (select *, case when o_custkey % 7 = 0 then '  ' else o_orderpriority end as q, o_custkey % 106 as n, o_custkey % 530 as c,
 o_orderkey % 12 as p from orders)""")
def request_guards(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    words = F.when(c % 7 == 0, "  ").otherwise(F.col("o_orderpriority"))
    ids = F.slice(F.array(*[F.lit(i) for i in range(33)]), 1, (c % 33).cast("int"))
    return B.table(spark, d, "orders").select(
        "o_orderkey", Q.request_fault(words, c % 106, c % 530, k % 12).alias("fault"),
        Q.question_ok(F.repeat(F.lit("x"), (c % 520).cast("int"))).alias("question_ok"), Q.ids_ok(ids).alias("ids_ok"))


@query("form_filters", """select c_custkey, case when c_custkey % 3 <> 0 then cast(c_custkey % 30 as int) end as min_years,
 case when c_custkey % 4 <> 0 then cast(c_custkey % 700 as int) end as max_hours_old,
 case when c_custkey % 5 <> 0 then c_mktsegment end as location, case when c_acctbal > 0 then 'sql' else '' end as skills,
 case c_custkey % 6 when 0 then '' when 1 then 'a' when 2 then 'a|b' when 3 then '' else 'b' end as sources from customer""")
def form_filters(spark, d):
    k = F.col("c_custkey")
    none = F.lit(None).cast("array<string>")
    listed = lambda *x: F.array(*[F.lit(s) for s in x])
    forms = B.table(spark, d, "customer").select(
        "c_custkey", F.when(k % 3 == 0, "any").otherwise((k % 30).cast("string")).alias("experience"),
        F.when(k % 4 == 0, "any").otherwise((k % 700).cast("string")).alias("recency"),
        F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("location"),
        (k % 2 == 0).alias("remote"), F.when(F.col("c_acctbal") > 0, listed("sql")).otherwise(none).alias("skills"),
        F.when(k % 6 == 1, listed("a")).when(k % 6 == 2, listed("a", "b")).when(k % 6 == 3, listed("a", "b", "c"))
        .when(k % 6 > 3, listed("b")).otherwise(none).alias("sources"))
    out = Q.form_filters(forms, ["a", "b", "c"])
    return out.select("c_custkey", "min_years", "max_hours_old", "location", F.array_join("skills", "|").alias("skills"),
                      F.array_join("sources", "|").alias("sources"))


# ------------------------------------------------------------------ a model's ranking
@query("rerank_requests", matches_sql(_QUERY) + """ select resume_id, '[' || string_agg('{"id":' || id || ',"title":"' || title || '",' ||
 coalesce('"company":"' || company || '",', '') || coalesce('"experience_years":' || experience_years || ',', '') || '"skills":[' ||
 coalesce('"' || nullif(array_to_string(list_slice(skills, 1, 15), '","'), '') || '"', '') || ']}', ',' order by rank) || ']' as jobs
 from ranked where rank <= 20 group by 1""")
def rerank_requests(spark, d):
    return Q.jobs_json(_matches(spark, d, _query_vectors(spark, d)), 15)


@query("simple_search_reranked", f"""{P}, {facts_sql()}, {CAND.format(k=30)}, {scored_sql('near', (0.50, 0.00, 0.00, 0.10, 0.15, 0.25))},
 ranked as (select *, {RANK.format(per='')} as prior from scored), answer as (select id, min(pos) as pos from (select
 unnest([id, id + 1, id, 0]) as id, prior * 4 + unnest([0, 1, 2, 3]) as pos from ranked where prior in (9, 4, 25)) group by 1),
 placed as (select r.*, row_number() over (order by pos asc nulls last, prior) as rank from ranked r left join answer a using (id))
 select rank, {OUT} from placed where rank <= 10""")
def simple_search_reranked(spark, d):
    """The answer lists some of the postings found, one twice, and others that were not found."""
    vec = Q.query_vector(B.table(spark, d, "embeddings"), 7)
    prior = Q.simple_search(B.postings(spark, d), vec, SEARCH.query, NOW, top_n=30)
    some = prior.where(F.col("rank").isin(9, 4, 25)).select("rank", F.array(F.col("id"), F.col("id") + 1, F.col("id"), F.lit(0).cast("long")).alias("ids"))
    answer = some.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ids"))), lambda x: x["ids"])).alias("ids"))
    rows = flat(Q.simple_search(B.postings(spark, d), vec, SEARCH.query, NOW, ranking=answer))
    return _longs(rows, "rank").withColumn("vec_score", F.round("vec_score", 4))
