"""Names, slugs, crawled URLs and boards; feed normalisers over payloads made from the given tables."""
from pyspark.sql import functions as F

from jobspan import bindings as B
from jobspan import vocab
from jobspan.checks.registry import query
from jobspan.functions import names as N
from jobspan.operators import boards as O
from jobspan.operators import keys as K
from jobspan.session import scratch_folder
from jobspan.sources import feeds, readers

P = "with " + B.POSTINGS_SQL
NOW = B.NOW
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def _sfx(words):
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


# company-like names: the brand with a part word, a suffix that the rules drop, and an ampersand
_COMPANY = ("(p_brand || ' ' || split_part(p_name, ' ', 1) || case when p_size % 3 = 0 then ' & Sons Inc.' when p_size % 3 = 1 "
            "then ', Group Ltd' else '_x Systems' end)")


def _companies(spark, d):
    n = F.col("p_size") % 3
    end = F.when(n == 0, " & Sons Inc.").when(n == 1, ", Group Ltd").otherwise("_x Systems")
    return B.table(spark, d, "part").select(
        "p_partkey", F.concat("p_brand", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)), end).alias("name"))


def _distinct(lst):
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


_CLEAN = (rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({{0}})), '&', ' and '), '{_sfx(vocab.CORPORATE_SUFFIXES)}\.?', ' ', 'g'),"
          r" '[^a-z0-9 -]', ' ', 'g'), '\s+', ' ', 'g'))")


def _variants_sql(frm: str, key: str, name: str) -> str:
    return f"""cleaned as (select *, coalesce(nullif({_CLEAN.format(name)}, ''), lower(trim({name}))) as base from {frm}),
 formed as (select *, list_filter([base, replace(base, ' ', ''), replace(base, ' ', '-'), replace(base, '-', ''),
 replace(base, '_', '-'), split_part(base, ' ', 1), base || 'inc', base || '-inc',
 case when contains(base, ' ') then array_to_string(list_slice(string_split(base, ' '), 1, 2), '') end,
 case when contains(base, ' ') then array_to_string(list_slice(string_split(base, ' '), 1, 2), '-') end],
 lambda v: length(v) >= 2) as forms from cleaned),
 variants as (select *, {_distinct('forms')} as slugs from formed)"""


@query("slug_variants", f"""with companies as (select p_partkey, {_COMPANY} as name from part),
 {_variants_sql('companies', 'p_partkey', 'name')} select p_partkey, base, array_to_string(slugs, '|') as slugs from variants""")
def slug_variants(spark, d):
    c = _companies(spark, d)
    return c.select("p_partkey", N.clean_company(F.col("name")).alias("base"),
                    F.array_join(N.slug_variants(F.col("name")), "|").alias("slugs"))


@query("supplier_slugs", f"""with {_variants_sql('supplier', 's_suppkey', 's_name')}
 select s_suppkey, array_to_string(slugs, '|') as slugs from variants""")
def supplier_slugs(spark, d):
    return B.table(spark, d, "supplier").select(
        "s_suppkey", F.array_join(N.slug_variants(F.col("s_name")), "|").alias("slugs"))


def _candidates_sql(name: str, suffixes) -> str:
    words = _WORDS.format(rf"regexp_replace(lower(regexp_replace({name}, '{_sfx(suffixes)}', '', 'g')), '[^a-z0-9\s]', '', 'g')")
    lst = f"[w[1], array_to_string(w, ''), array_to_string(w, '-')]"
    return words, _distinct(lst)


_W_SHORT, _L = _candidates_sql("name", vocab.SHORT_SUFFIXES)
_W_LONG, _ = _candidates_sql("name", vocab.LONG_SUFFIXES)


@query("slug_candidates", f"""with c as (select p_partkey, {_COMPANY} as name from part),
 s as (select p_partkey, {_W_SHORT} as w from c), l as (select p_partkey, {_W_LONG} as w from c)
 select p_partkey, a.x as short, b.x as long from (select p_partkey, array_to_string({_L}, '|') as x from s) a
 join (select p_partkey, array_to_string({_L}, '|') as x from l) b using (p_partkey)""")
def slug_candidates(spark, d):
    return _companies(spark, d).select(
        "p_partkey", F.array_join(N.slug_candidates(F.col("name")), "|").alias("short"),
        F.array_join(N.slug_candidates(F.col("name"), vocab.LONG_SUFFIXES), "|").alias("long"))


@query("board_candidates", f"""with c as (select distinct {_COMPANY} as name from part), s as (select name, {_W_LONG} as w from c),
 pairs as (select name, unnest({_L}) as slug from s), known as (select 'brand' || n_nationkey as slug from nation join region
 on r_regionkey = n_regionkey where r_name = 'EUROPE')
 select name, slug, unnest([1, 2, 3, 4, 5]) as wd_num from pairs
 where name not in (select name from pairs where slug in (select slug from known))""")
def board_candidates(spark, d):
    n, r = B.table(spark, d, "nation"), B.table(spark, d, "region").where("r_name = 'EUROPE'")
    known = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("brand"), F.col("n_nationkey").cast("string")).alias("tenant"))
    return O.board_candidates(_companies(spark, d), known)


@query("candidate_slugs", f"""with companies as (select 0 as list, s_suppkey as pos, s_name as name from supplier union all
 select 1, p_partkey, {_COMPANY} from part), {_variants_sql('companies', 'pos', 'name')},
 flat as (select list, pos, unnest(slugs) as slug, generate_subscripts(slugs, 1) - 1 as variant from variants)
 select slug, list as rank_list, pos as rank_pos, variant as rank_variant from flat
 qualify row_number() over (partition by slug order by list, pos, variant) = 1""")
def candidate_slugs(spark, d):
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    c = _companies(spark, d).select(F.col("p_partkey").alias("pos"), "name")
    return O.candidate_slugs([s, c]).withColumn("rank_variant", F.col("rank_variant").cast("long"))


@query("search_terms", "select distinct unnest(['', 'Europe', 'Asia']) as country, p_name as term from part")
def search_terms(spark, d):
    terms = B.table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    return O.search_terms(terms, ["", "Europe", "Asia"])


# ------------------------------------------------------------------ crawled URLs; the pattern fits the pages' own hosts
HOSTS = r"(?i)https?://(?:www\.|m\.|blog\.)?([a-z0-9-]+)\.example\.[a-z]+()/(?:(?:fr)/)?([^/?#\s]+)"
_SITE = f"regexp_extract(url, '{HOSTS}', 3)"
URLS = f"""urls as (select lower(regexp_extract(url, '{HOSTS}', 1)) as tenant, {_SITE} as career_site from pages
 where {_SITE} <> '' and lower({_SITE}) not in ('en', 'jobs'))"""


def _board():
    """Board of a page URL. The pages' hosts carry no server number, so one is put in where the pattern expects it."""
    return N.board_from_url(F.regexp_replace("url", r"\.example\.(com|net|org)", ".wd3.myworkdayjobs.com"),
                            HOSTS.replace(r"\.example\.[a-z]+()", r"\.wd(\d)\.myworkdayjobs\.com"), ["en", "jobs"])


@query("boards_in_urls", f"""select page_id, lower(regexp_extract(url, '{HOSTS}', 1)) as tenant, {_SITE} as career_site
 from pages where {_SITE} <> '' and lower({_SITE}) not in ('en', 'jobs')""")
def boards_in_urls(spark, d):
    b = _board()
    return B.table(spark, d, "pages").select("page_id", b.alias("b")).where("b is not null").select(
        "page_id", "b.tenant", "b.career_site")


@query("frequent_sites", f"""with {URLS}, n as (select tenant, career_site, count(*) as urls from urls group by all)
 select tenant, 3 as wd_num, career_site, urls from n
 qualify row_number() over (partition by tenant order by urls desc, career_site) = 1""")
def frequent_sites(spark, d):
    return O.frequent_sites(B.table(spark, d, "pages"), parse=_board())


@query("discovered_boards", f"""with {URLS}, n as (select tenant, career_site, 2 * count(*) as urls from urls group by all)
 select tenant, 3 as wd_num, career_site, urls from n where tenant not in (select 'th' || lower(substring(n_name, 1, 0)) ||
 'on' from nation) qualify row_number() over (partition by tenant order by urls desc, career_site) = 1""")
def discovered_boards(spark, d):
    pages = B.table(spark, d, "pages")
    known = B.table(spark, d, "nation").select(F.lit("thon").alias("tenant"))
    return O.discover_boards([pages, pages], known, parse=_board())


@query("career_sites", r"""with p as (select page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path from pages)
 select page_id, list_filter(string_split(regexp_replace(path, '(?i)^/[a-z]{2}[-_][a-z]{2}/', '/'), '/'),
 lambda s: s <> '' and lower(s) not in ('en', 'fr'))[1] as site from p""")
def career_sites(spark, d):
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    return B.table(spark, d, "pages").select("page_id", N.career_site(path, ["en", "fr"]).alias("site"))


@query("career_site_fallbacks", """select s_suppkey, 'External_Careers|External|Careers|' || upper(substring(slug, 1, 1)) ||
 lower(substring(slug, 2)) || '|' || slug as sites from (select s_suppkey, lower(s_name) as slug from supplier)""")
def career_site_fallbacks(spark, d):
    return B.table(spark, d, "supplier").select(
        "s_suppkey", F.array_join(N.career_site_fallbacks(F.lower("s_name")), "|").alias("sites"))


@query("canonical_links", """select page_id, case when contains(split_part(url, '?', 1), '/jobs/') then split_part(url, '?', 1)
 end as listed, 'https://jobs.example' || replace(split_part(substring(url, length(regexp_extract(url, '^https?://[^/]+')) + 1),
 '?', 1), '/en/', '/jobs/') as absolute, 'https://jobs.example/viewjob?jk=' || page_id as keyed,
 case when contains(url, '/de/') then url else 'https://jobs.example/x' || page_id end as by_href
 from pages""")
def canonical_links(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    jobs = F.concat(F.lit("/jobs/"), F.substring(path, 2, 1000))
    base, key = "https://jobs.example", F.col("page_id").cast("string")
    none = F.lit(None).cast("string")
    absolute = F.when(path.contains("/en/"), N.canonical_link(F.replace(path, F.lit("/en/"), F.lit("/jobs/")), base)).otherwise(
        F.concat(F.lit(base), F.split_part(path, F.lit("?"), F.lit(1))))
    href = F.when(F.col("url").contains("/de/"), F.col("url")).otherwise(F.concat(F.lit("/x"), key))
    return B.table(spark, d, "pages").select(
        "page_id", N.canonical_link(F.col("url"), base).alias("listed"), absolute.alias("absolute"),
        N.job_key_link(key, none, base).alias("keyed"), N.job_key_link(none, href, base).alias("by_href"))


@query("job_id_links", "select c_custkey, 'https://jobs.example/jobs/view/' || c_custkey as link from customer")
def job_id_links(spark, d):
    html = F.concat(F.lit('<a href="/jobs/view/'), F.col("c_custkey").cast("string"), F.lit('/?x=1">'), "c_name", F.lit("</a>"))
    return B.table(spark, d, "customer").select(
        "c_custkey", N.canonical_link(F.lit(None).cast("string"), "https://jobs.example", html).alias("link"))


@query("cohorts", """select o_orderkey, cast(case when o_orderstatus = 'P' then 0 else year(o_orderdate) end as int) as year,
 case when o_orderstatus = 'P' then 0 else (month(o_orderdate) - 1) // 3 end as season from orders""")
def cohorts(spark, d):
    season = F.element_at(F.array(*[F.lit(s) for s in vocab.SEASON_ORDER]), F.quarter("o_orderdate"))
    name = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(
        F.concat_ws(" ", season, F.year("o_orderdate").cast("string")))
    key = N.cohort_key(name)
    return B.table(spark, d, "orders").select(
        "o_orderkey", key["year"].alias("year"), key["season"].cast("long").alias("season"))


@query("display_names", r"""select p_partkey, array_to_string(list_transform(regexp_extract_all(replace(lower(p_name) || '-' ||
 lower(p_brand) || 'x-2b', '-', ' '), '\p{L}+|[^\p{L}]+'), lambda r: upper(substring(r, 1, 1)) || substring(r, 2)), '') as name
 from part""")
def display_names(spark, d):
    slug = F.concat(F.lower("p_name"), F.lit("-"), F.lower("p_brand"), F.lit("x-2b"))
    return B.table(spark, d, "part").select("p_partkey", N.display_name(slug).alias("name"))


@query("normal_roles", """select p_partkey, p_name as role, p_name || ' engineer' as twice from part""")
def normal_roles(spark, d):
    end = F.when(F.col("p_size") > 30, " Engineer").when(F.col("p_size") > 20, " ROLE ").when(
        F.col("p_size") > 10, " position").otherwise("")
    return B.table(spark, d, "part").select(
        "p_partkey", N.normalize_role(F.concat("p_name", end)).alias("role"),
        N.normalize_role(F.concat("p_name", F.lit(" engineer job"))).alias("twice"))


@query("company_guesses", r"""select doc_id, case when length(g1) > 2 and length(g1) < 50 then g1
 when length(g2) > 2 and length(g2) < 50 then g2 when length(g3) > 2 and length(g3) < 50 then g3 end as company from (select doc_id,
 trim(regexp_extract(text, '^([A-Z][A-Za-z0-9\s]+)\s+(?:is |are |''s )', 1), ' ' || chr(10)) as g1,
 trim(regexp_extract(text, '(?:at|for)\s+([A-Z][A-Za-z0-9\s&]+)(?:\s|,|$)', 1), ' ' || chr(10)) as g2,
 trim(regexp_extract(text, '(?:company|organization)\s+(?:is\s+)?(?:called\s+)?([A-Z][A-Za-z0-9\s&]+)', 1), ' ' || chr(10)) as g3
 from documents)""")
def company_guesses(spark, d):
    return B.table(spark, d, "documents").select(
        "doc_id", N.guess_company(F.col("text")).alias("company"))


# ------------------------------------------------------------------ boards
def _boards(spark, d):
    s, li = B.table(spark, d, "supplier"), B.table(spark, d, "lineitem")
    jobs = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("jobs"))
    return s.join(jobs, s.s_suppkey == jobs.l_suppkey, "left").select(
        F.col("s_suppkey").alias("key"), F.lower("s_name").alias("slug"), F.col("s_name").alias("name"),
        F.coalesce("jobs", F.lit(0)).alias("jobs"), (F.col("s_acctbal") > 0).alias("active"))


_BOARDS = """b as (select s_suppkey as key, lower(s_name) as slug, s_name as name, coalesce(n, 0) as jobs, s_acctbal > 0 as active
 from supplier left join (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on l_suppkey = s_suppkey)"""


@query("active_boards", f"with {_BOARDS} select key, slug from b where active")
def active_boards(spark, d):
    return O.active_boards(_boards(spark, d)).select("key", "slug")


@query("boards_by_jobs", f"with {_BOARDS} select key, slug, jobs from b where jobs >= 150 order by jobs desc, slug")
def boards_by_jobs(spark, d):
    return O.boards_by_jobs(_boards(spark, d), 150).select("key", "slug", "jobs")


@query("active_first", f"with {_BOARDS} select name, jobs from b where jobs > 0 order by jobs desc, name")
def active_first(spark, d):
    return O.active_first(_boards(spark, d)).select("name", "jobs")


@query("active_split", f"with {_BOARDS} select jobs > 200 as active, count(*) as boards, cast(sum(greatest(jobs - 200, 0)) as bigint) as jobs from b group by 1")
def active_split(spark, d):
    return O.active_split(_boards(spark, d).withColumn("jobs", F.greatest(F.col("jobs") - 200, F.lit(0))))


@query("refreshed_boards", f"""with {_BOARDS}, seen as (select l_suppkey as key, cast(count(*) filter (l_linestatus = 'O') as int) as n
 from lineitem where l_returnflag = 'A' group by 1) select key, slug, coalesce(n, -1) as job_count,
 case when n is not null then timestamp '{NOW}' else timestamp '2000-01-01' end as last_scraped from b left join seen using (key)""")
def refreshed_boards(spark, d):
    boards = _boards(spark, d).select("key", "slug", F.lit(-1).alias("job_count"),
                                      F.lit("2000-01-01").cast("timestamp").alias("last_scraped"))
    run = B.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("key"), F.when(F.col("l_linestatus") == "O", "inserted").otherwise("duplicate").alias("status"))
    return O.refresh_boards(boards, run, NOW)


@query("exported_boards", f"""with {_BOARDS} select name as company_name, slug as tenant, cast(key % 5 + 1 as int) as wd_num,
 'Careers' as career_site, jobs as job_count, 'https://' || slug || '.wd' || (key % 5 + 1) || '.myworkdayjobs.com/en-US/Careers'
 as board_url from b""")
def exported_boards(spark, d):
    b = _boards(spark, d).select(
        F.col("name").alias("company_name"), F.col("slug").alias("tenant"), (F.col("key") % 5 + 1).cast("int").alias("wd_num"),
        F.lit("Careers").alias("career_site"), F.col("jobs").alias("job_count"))
    return O.export_rows(b)


@query("merged_companies", """select coalesce(s.slug, c.slug) as slug, coalesce(s.name, c.name) as name from
 (select right(s_name, 4) as slug, s_name as name from supplier) s full join
 (select right(c_name, 4) as slug, min(c_name) as name from customer group by 1) c on c.slug = s.slug""")
def merged_companies(spark, d):
    s = B.table(spark, d, "supplier").select(F.right("s_name", F.lit(4)).alias("slug"), F.col("s_name").alias("name"))
    c = B.table(spark, d, "customer").select(F.right("c_name", F.lit(4)).alias("slug"), F.col("c_name").alias("name"))
    return K.merge_named(s, c, "slug", "name")


@query("new_slugs", """select distinct right(c_name, 4) as slug from customer
 where right(c_name, 4) not in (select right(s_name, 4) from supplier)""")
def new_slugs(spark, d):
    s = B.table(spark, d, "supplier").select(F.right("s_name", F.lit(4)).alias("slug"))
    return K.new_keys(B.table(spark, d, "customer").select(F.right("c_name", F.lit(4)).alias("slug")), s, "slug")


@query("newest_cohorts", """select c_custkey, 'C' || c_nationkey as name, 1990 + c_nationkey as year from customer
 order by year desc, name""")
def newest_cohorts(spark, d):
    c = B.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("name"),
        F.concat(F.lit("Fall "), (F.col("c_nationkey") + 1990).cast("string")).alias("batch"))
    return O.newest_cohort_first(c).select("c_custkey", "name", F.col("cohort.year").alias("year"))


@query("cohort_names", """select -(year(o_orderdate) * 10 + quarter(o_orderdate) - 1) as pos, unnest(case when o_orderstatus = 'P'
 then [o_orderpriority] else [lower(o_orderpriority), 'Order ' || o_orderkey] end) as name from orders""")
def cohort_names(spark, d):
    season = F.element_at(F.array(*[F.lit(s) for s in vocab.SEASON_ORDER]), F.quarter("o_orderdate"))
    rows = B.table(spark, d, "orders").select(
        F.concat_ws(" ", season, F.year("o_orderdate").cast("string")).alias("batch"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("slug"),
        F.when(F.col("o_orderstatus") == "P", F.lower("o_orderpriority")).otherwise(
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("name"))
    return O.cohort_names(rows).select(F.col("pos").cast("long").alias("pos"), "name")


# ------------------------------------------------------------------ feeds: payloads made from the tables, then normalised
RESPONSE_ORDERS = 2000  # a response holds a supplier's lines of so many order numbers, at most some thousands
_LINE = ("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_shipdate",  # what the feeds read of a line
         "p_name", "p_type", "p_brand", "p_size")


def _responses(spark, d):
    """The lines of each response of a supplier's board, as ``rows`` with the columns of all feeds: these alone are moved, and the feeds of
    one job share their shuffle, since none reads a part of it."""
    li = B.table(spark, d, "lineitem")
    p, s = B.table(spark, d, "part"), B.table(spark, d, "supplier")
    rows = li.join(p, p.p_partkey == li.l_partkey).select(
        "l_suppkey", F.floor(F.col("l_orderkey") / RESPONSE_ORDERS).alias("page"), F.struct(*_LINE).alias("row"))
    # Dealt out before they are collected, since a response has few lines in any one task; its supplier comes to the whole response.
    rows = rows.repartition("l_suppkey", "page").sortWithinPartitions("l_suppkey", "page")
    return rows.groupBy("l_suppkey", "page").agg(F.collect_list("row").alias("rows")).join(s, s.s_suppkey == F.col("l_suppkey"))


def _line(r):
    return F.concat_ws("-", r["l_orderkey"], r["l_partkey"], "l_suppkey", r["l_linenumber"])


def _landed(spark, d, job, wrap):
    """Responses of a supplier's board as landed text, each with several postings, one per line of an order, which ``job`` makes of its
    row; ``lines`` names them in their order."""
    return _responses(spark, d).select(
        F.transform("rows", _line).alias("lines"), F.col("s_name").alias("company_name"), F.lower("s_name").alias("slug"),
        F.to_json(wrap(F.transform("rows", job))).alias("payload"))


def _jobs(spark, d, feed, job, wrap):
    """The postings read back from the responses, each with its line by position."""
    jobs = readers.feed_jobs(_landed(spark, d, job, wrap), feed, position="pos")
    return jobs.withColumn("line", F.get("lines", F.col("pos"))).drop("lines", "pos")


LINES = """l as (select l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as line, * from lineitem
 join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey)"""


LEVER = f"""with {LINES} select line, p_name as title, s_name as company_name, p_type || chr(10) || chr(10) || 'Needs' ||
 chr(10) || chr(10) || 'p  ' || p_brand || case when l_returnflag = 'R' then chr(10) || chr(10) || 'More' else '' end as description,
 'https://lever.example/' || line as link, case when l_linestatus = 'O' then p_brand else p_type end as location,
 l_shipdate as posted_date, case when p_size > 25 then p_size * 1000.0::double end as pay_min,
 case when p_size > 25 then 'USD' end as currency, 'lever' as source from l"""


def _lever(spark, d):
    def job(r):
        return F.struct(
            F.concat(F.lit(" "), r["p_name"]).alias("text"),
            F.concat_ws("", F.lit("https://lever.example/"), _line(r)).alias("hostedUrl"),
            F.struct(F.when(r["l_linestatus"] == "O", r["p_brand"]).otherwise("").alias("location"),
                     F.array(r["p_type"]).alias("allLocations")).alias("categories"),
            r["p_type"].alias("descriptionPlain"),
            F.array(F.struct(F.lit("Needs").alias("text"), F.concat(F.lit("<p>p </b>"), r["p_brand"], F.lit("</p>")).alias("content")),
                    F.struct(F.lit("").alias("text"), F.lit("<br/>").alias("content"))).alias("lists"),
            F.when(r["l_returnflag"] == "R", "More").alias("additionalPlain"),
            F.struct(F.when(r["p_size"] > 25, r["p_size"] * 1000.0).alias("min")).alias("salaryRange"),
            F.unix_millis(r["l_shipdate"].cast("timestamp")).alias("createdAt"))

    return feeds.lever(_jobs(spark, d, "lever", job, lambda js: js), keep=["line"])


@query("feed_lever", LEVER)
def feed_lever(spark, d):
    return _lever(spark, d).select("line", "title", "company_name", "description", "link", "location", "posted_date",
                      F.col("salary.min").alias("pay_min"), F.col("salary.currency").alias("currency"), "source")


ASHBY = f"""with {LINES} select line, p_name as title, p_type || chr(10) || p_brand as description,
 case when l_returnflag = 'R' then 'https://x.example/' || line else 'https://jobs.ashbyhq.com/' || lower(s_name) || '/' || line
 end as link, case when l_linestatus = 'O' then p_brand else p_type end as location, case when l_returnflag = 'A' then null else
 l_shipdate end as posted_date from l"""


def _ashby(spark, d):
    def job(r):
        line = _line(r)
        return F.struct(
            line.alias("id"), r["p_name"].alias("title"),
            F.when(r["l_linestatus"] == "O", F.to_json(F.struct(r["p_brand"].alias("city")))).otherwise(r["p_type"]).alias("location"),
            F.when(r["l_returnflag"] == "R", F.concat(F.lit("https://x.example/"), line)).otherwise(" ").alias("applyLink"),
            F.lit("not a date").alias("publishedAt"),
            F.when(r["l_returnflag"] != "A", F.date_format(r["l_shipdate"], "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updatedAt"),
            F.concat(F.lit("<p>"), r["p_type"], F.lit("</p><ul><li> "), r["p_brand"], F.lit(" </li></ul>")).alias("descriptionHtml"))

    wrap = lambda js: F.struct(F.struct(F.struct(js.alias("jobPostings")).alias("jobBoardWithTeams")).alias("data"))
    return feeds.ashby(_jobs(spark, d, "ashby", job, wrap), keep=["line"])


@query("feed_ashby", ASHBY)
def feed_ashby(spark, d):
    return _ashby(spark, d).select("line", "title", "description", "link", "location", "posted_date")


SMARTRECRUITERS = f"""with {LINES} select line, p_name as title, 'About' || chr(10) || chr(10) || p_type || ' x' || chr(10) ||
 chr(10) || 'Skills' as description, 'https://jobs.smartrecruiters.com/' || lower(s_name) || '/' || line as link,
 case when p_size > 40 then 'Remote - US' when p_size > 30 then 'Remote - ' || p_type when p_size > 25 then 'Remote' when p_size > 20
 then p_brand || ', ' || p_type when p_size > 10 then p_brand || ', ' || 'FR' when p_size > 5 then p_brand when p_size > 2 then
 p_type end as location, l_shipdate as posted_date from l"""


def _smartrecruiters(spark, d):
    def job(r):
        line, size = _line(r), r["p_size"]
        place = F.struct(
            (size > 25).alias("remote"),
            F.when(size > 5, r["p_brand"]).alias("city"),
            F.when(((size > 20) & (size <= 25)) | ((size > 2) & (size <= 5)), r["p_type"]).alias("region"),
            F.when(size > 40, "usa").when(size > 30, r["p_type"]).when((size > 10) & (size <= 20), "FR").alias("country"))
        part = lambda t, x: F.struct(t.alias("title"), x.alias("text"))
        none = F.lit(None).cast("string")
        sections = F.struct(
            part(F.lit(" About "), F.concat(F.lit("<div>"), r["p_type"], F.lit("<br>  x</div>"))).alias("companyDescription"),
            part(none, F.lit("<p> </p>")).alias("jobDescription"), part(F.lit("Skills"), none).alias("qualifications"))
        return F.struct(line.alias("id"), r["p_name"].alias("name"), place.alias("location"),
                        F.date_format(r["l_shipdate"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("releasedDate"),
                        F.struct(sections.alias("sections")).alias("jobAd"))

    jobs = _jobs(spark, d, "smartrecruiters", job, lambda js: F.struct(js.alias("content")))
    return feeds.smartrecruiters(jobs, company_id="slug", keep=["line"])


@query("feed_smartrecruiters", SMARTRECRUITERS)
def feed_smartrecruiters(spark, d):
    return _smartrecruiters(spark, d).select("line", "title", "description", "link", "location", "posted_date")


GREENHOUSE = f"""with {LINES} select line, p_name as title, case when length(p_type || chr(10) || repeat(p_brand, 6)) > 50
 then p_type || chr(10) || repeat(p_brand, 6) end as description, case when l_returnflag = 'R' then 'https://gh.example/' || line else
 'https://boards.greenhouse.io/' || lower(s_name) || '/jobs/' || l_orderkey end as link, p_brand as location,
 p_brand || '|' || p_type || '|' || l_linestatus as locations from l"""


def _greenhouse(spark, d):
    def job(r):
        line = _line(r)
        office = F.struct(r["p_type"].alias("location"), r["l_linestatus"].alias("name"))
        return F.struct(
            r["l_orderkey"].alias("id"), r["p_name"].alias("title"),
            F.when(r["l_returnflag"] == "R", F.concat(F.lit("https://gh.example/"), line)).alias("absolute_url"),
            F.struct(r["p_brand"].alias("name")).alias("location"),
            F.array(office, F.struct(F.lit("").alias("location"), F.lit(None).cast("string").alias("name"))).alias("offices"),
            F.concat(F.lit("<h2>"), r["p_type"], F.lit("</h2><p>"), F.repeat(r["p_brand"], F.lit(6)), F.lit("</p>")).alias("content"))

    return feeds.greenhouse(_jobs(spark, d, "greenhouse", job, lambda js: F.struct(js.alias("jobs"))), keep=["line"])


@query("feed_greenhouse", GREENHOUSE)
def feed_greenhouse(spark, d):
    return _greenhouse(spark, d).select("line", "title", "description", "link", "location", F.array_join("locations", "|").alias("locations"))


WORKDAY = f"""with {LINES} select line, p_name as title, p_type || chr(10) || p_brand as description, 'https://' || lower(s_name)
 || '.wd' || 3 || '.myworkdayjobs.com/en-US/Careers/job/' || p_type || '/' || line as link, '/job/' || p_type || '/' || line as detail,
 p_brand || ', ' || p_type as location, p_brand || '|' || p_type as locations from l"""


def _workday(spark, d):
    def job(r):
        line = _line(r)
        html = F.concat(F.lit("<p>"), r["p_type"], F.lit("<br>"), r["p_brand"], F.lit("</p>"))
        return F.struct(
            r["p_name"].alias("title"), F.concat(F.lit("/en-US/Careers/job/"), r["p_type"], F.lit("/"), line).alias("externalPath"),
            F.concat(r["p_brand"], F.lit(", "), r["p_type"]).alias("locationsText"),
            F.when(r["l_returnflag"] == "R", html).alias("jobDescription"),
            F.struct(F.when(r["l_returnflag"] != "R", html).alias("jobDescription")).alias("jobPostingInfo"))

    jobs = _jobs(spark, d, "workday", job, lambda js: F.struct(js.alias("jobPostings")))
    return feeds.workday(jobs.withColumn("n", F.lit(3)), tenant="slug", wd_num="n", keep=["line", "job"])


@query("feed_workday", WORKDAY)
def feed_workday(spark, d):
    return _workday(spark, d).select("line", "title", "description", "link",
                      feeds.detail_path(F.col("job.externalPath"), F.lit("careers")).alias("detail"), "location",
                      F.array_join("locations", "|").alias("locations"))


@query("feed_aggregator", """select o_orderkey as line, o_orderpriority as title, case when o_orderstatus = 'F' then null else c_name end
 as company_name, 'https://agg.example/' || o_orderkey as link, c_mktsegment as location, o_orderdate as posted_date,
 case when o_orderstatus = 'O' then o_totalprice end as pay_max, case when o_orderstatus = 'O' then 'EUR' end as currency,
 case when o_orderstatus = 'O' then 'linkedin' else 'indeed' end as source from orders join customer on c_custkey = o_custkey
 where o_orderpriority <> '5-LOW'""")
def feed_aggregator(spark, d):
    o, c = B.table(spark, d, "orders"), B.table(spark, d, "customer")
    rows = o.join(c, c.c_custkey == o.o_custkey).select(
        F.col("o_orderkey").alias("line"), F.concat(F.lit("https://agg.example/"), F.col("o_orderkey").cast("string")).alias("job_url"),
        F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("c_name")).alias("company"),
        F.lit(None).cast("string").alias("description"), F.concat(F.lit(" "), "c_mktsegment").alias("location"),
        F.when(F.col("o_orderstatus") == "O", "LinkedIn").alias("site"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_posted"),
        F.lit(0.0).alias("min_amount"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("max_amount"),
        F.lit("EUR").alias("currency"))
    out = feeds.aggregator(rows, keep=["line"])
    return out.select("line", "title", "company_name", "link", "location", "posted_date", F.col("salary.max").alias("pay_max"),
                      F.col("salary.currency").alias("currency"), "source")


_COMMON = "title, description, link, location"
_UNITED = " union all ".join(f"select '{n}' as source, {_COMMON}, {at} as posted_date from ({sql})" for n, sql, at in (
    ("lever", LEVER, "posted_date"), ("ashby", ASHBY, "posted_date"), ("smartrecruiters", SMARTRECRUITERS, "posted_date"),
    ("greenhouse", GREENHOUSE, "null"), ("workday", WORKDAY, "null")))


@query("united_feeds", f"select * from ({_UNITED})")
def united_feeds(spark, d):
    """The five feeds, normalised, in one schema."""
    all_ = feeds.union_feeds([feed(spark, d) for feed in (_lever, _ashby, _smartrecruiters, _greenhouse, _workday)])
    return all_.select("source", "title", "description", "link", "location", "posted_date")


@query("united_feed_counts", f"""select source, count(*) as cnt, count(distinct link) as links, count(posted_date) as dated,
 cast(sum(length(description)) as bigint) as chars from ({_UNITED}) group by 1""")
def united_feed_counts(spark, d):
    return united_feeds(spark, d).groupBy("source").agg(
        F.count("*").alias("cnt"), F.count_distinct("link").alias("links"), F.count("posted_date").alias("dated"),
        F.sum(F.length("description")).alias("chars"))


@query("page_profiles", """select page_id, 'slug' || page_id as slug, 'Name ' || page_id as name from pages where length(html) <> 7
 union all select page_id, 'inner' || page_id, 'In ' || page_id from pages where length(url) % 2 = 0""")
def page_profiles(spark, d):
    i = F.col("page_id").cast("string")
    one = F.struct(F.concat(F.lit(" slug"), i).alias("slug"), F.concat(F.lit("Name "), i).alias("name"), F.lit("l.png").alias("logo"))
    again = F.struct(F.concat(F.lit("slug"), i).alias("slug"), F.lit("Second").alias("name"), F.lit("l.png").alias("logo"))
    inner = F.struct(F.concat(F.lit("inner"), i).alias("slug"), F.concat(F.lit("In "), i).alias("name"), F.lit("w").alias("website"))
    no = F.struct(F.lit("nologo").alias("slug"), F.lit("No logo").alias("name"))
    listed = F.to_json(F.struct(F.struct(F.struct(F.array(one, again).alias("customerProfiles")).alias("pageProps")).alias("props")))
    deep = F.to_json(F.struct(F.array(F.struct(one.alias("a"), no.alias("b"), F.array(inner).alias("c"), again.alias("d"))).alias("x")))
    island = F.when(F.length("url") % 2 == 0, deep).otherwise(listed)
    html = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), island, F.lit("</script>"))
    return readers.page_profiles(B.table(spark, d, "pages").select("page_id", html.alias("html")))


# ------------------------------------------------------------------ lists and dumps, written to the shared folder and read back
@query("company_lists", """select s_name as name, case when s_suppkey % 2 = 0 then 'slug' || s_suppkey else 'id' || s_suppkey end as key,
 case when s_suppkey % 3 = 0 then cast(s_suppkey as int) end as jobs from supplier""")
def company_lists(spark, d):
    """One JSON array of companies per nation."""
    s, path = B.table(spark, d, "supplier"), scratch_folder(spark, "lists")
    k = F.col("s_suppkey")
    entry = F.struct(F.col("s_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("slug"), k.cast("string"))).alias("slug"),
                     F.when(k % 2 != 0, F.concat(F.lit("id"), k.cast("string"))).alias("company_id"), F.when(k % 3 == 0, k).alias("jobs"))
    arrays = s.groupBy("s_nationkey").agg(F.to_json(F.collect_list(entry)).alias("value"))
    arrays.write.partitionBy("s_nationkey").text(path)
    return readers.company_list(spark, path).select("name", "key", "jobs")


@query("name_line_files", "select s_name as name from supplier where s_suppkey % 7 <> 0")
def name_line_files(spark, d):
    path = scratch_folder(spark, "names")
    line = F.when(F.col("s_suppkey") % 7 == 0, "  \t").otherwise(F.concat(F.lit("  "), "s_name", F.lit(" ")))
    B.table(spark, d, "supplier").select(line.alias("value")).write.text(path)
    return readers.name_lines(spark, path)


@query("crawl_index_dump", "select url from pages where page_id % 5 <> 0 and page_id % 7 <> 0")
def crawl_index_dump(spark, d):
    """JSON lines, of which some are broken and some have no URL."""
    path = scratch_folder(spark, "crawl")
    url = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("url"))
    line = F.when(F.col("page_id") % 5 == 0, '{"url": "broken').otherwise(F.to_json(F.struct(url.alias("url"), F.lit("200").alias("status"))))
    B.table(spark, d, "pages").select(line.alias("value")).write.text(path)
    return readers.crawl_urls(spark, path)
