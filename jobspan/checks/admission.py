"""Admission predicates, the cascade and duplicates over all raw postings and pages."""
from pyspark.sql import functions as F

from jobspan import bindings as B
from jobspan.checks.registry import query
from jobspan.operators import admission as A
from jobspan.operators import keys as K
from jobspan.plans.ingest import ingest
from jobspan.session import scratch_folder
from jobspan.sources.keyed import KeyedTable, ranged
from jobspan.sources import feeds, readers, writers

P = "with " + B.POSTINGS_SQL
RAW = "with " + B.RAW_SQL
NOW = B.NOW
RULES = A.AdmissionRules(
    blocked=["Supplier#000000003", "supplier#000000007"], title_keywords=["ring", "bolt", "gear", "widget"],
    title_excludes=["old widget"], state_codes=["ASIA", "EUROPE"], us_keywords=["nation_1"])
BLOCKED_SQL = r"coalesce(regexp_matches(company_name, '(?i)\b(supplier#000000003|supplier#000000007)\b'), false)"
TITLE_SQL = (r"coalesce(not contains(lower(title), 'old widget') and "
             r"regexp_matches(title, '(?i)\b(ring|bolt|gear|widget)\b'), false)")
US_SQL = r"coalesce(regexp_matches(location, '\b(ASIA|EUROPE)\b') or contains(lower(location), 'nation_1'), false)"
EST_SQL = "(coalesce(followers >= 20000, false) or coalesce(employees >= 1000, false))"
# Written out: the SQL borrows no pattern from the code that it checks.
_SUF = (
    r"\b(LLC|Inc\.?|Corp\.?|Ltd\.?|LLP|PLC|GmbH|Co\.?|Holdings?|Technologies?|Technology|Services?|Solutions?|"
    r"Consulting|Consultants?|Partners?|Group|Resources?|Staffing|Recruiting|Recruitment|Talent|"
    r"Staffing Solutions|Hiring)\b\.?,?"
)
CORE_SQL = rf"trim(regexp_replace(company_name, '(?i){_SUF}', '', 'g'), ' ,&' || chr(10))"
MENTION_SQL = rf"""(case when coalesce(company_name, '') = '' or coalesce(length(trim(description, ' ' || chr(10))), 0) < 150
 then true when length({CORE_SQL}) < 4 then true
 else contains(lower(description), lower({CORE_SQL}))
   or coalesce(contains(lower(description), lower(list_filter(regexp_split_to_array({CORE_SQL}, '\s+'),
        lambda w: length(w) >= 5)[1])), false)
   or len(list_filter(regexp_extract_all({CORE_SQL}, '[A-Z][a-z]+|[A-Z]+$|[a-z]+'),
        lambda w: length(w) >= 7 and contains(lower(description), lower(w)))) > 0 end)"""
FAIL_SQL = f"""case when {BLOCKED_SQL} then 'blocked' when not {TITLE_SQL} then 'bad_title' when not {US_SQL} then 'non_us'
 when not {EST_SQL} and not {MENTION_SQL} then 'no_company_ref' end"""
JUDGED_SQL = f"""{RAW}, {B.STORED_SQL}, tested as (select *, {FAIL_SQL} as fail from raw),
 judged as (select *, case when fail is not null then fail when link in (select link from stored) then 'duplicate'
 when row_number() over (partition by link, fail order by id) > 1 then 'duplicate' else 'inserted' end as status
 from tested)"""
_COUNTS = "count(*) as scraped, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in (
    "inserted", "duplicate", "blocked", "bad_title", "non_us", "no_company_ref", "error"))


def _statuses(spark, d, keep=(), rules=RULES):
    return A.statuses(B.raw_postings(spark, d), B.stored_links(spark, d), rules, keep=list(keep))[0]


@query("blocked_company", RAW + f" select id, {BLOCKED_SQL} as blocked from raw")
def blocked_company(spark, d):
    return B.raw_postings(spark, d).select("id", A.blocked_company(F.col("company_name"), RULES.blocked).alias("blocked"))


@query("good_title", RAW + f" select id, title, {TITLE_SQL} as good from raw")
def good_title(spark, d):
    return B.raw_postings(spark, d).select(
        "id", "title", A.good_title(F.col("title"), RULES.title_keywords, RULES.title_excludes).alias("good"))


@query("us_location", RAW + rf""" select id, {US_SQL} as us, coalesce(regexp_matches(location, '\b(ASIA|EUROPE)\b')
 or regexp_matches(lower(location), '\bnation_1\b'), false) as us_word from raw""")
def us_location(spark, d):
    return B.raw_postings(spark, d).select(
        "id", A.us_location(F.col("location"), RULES.state_codes, RULES.us_keywords).alias("us"),
        A.us_location(F.col("location"), RULES.state_codes, RULES.us_keywords, mode="word").alias("us_word"))


@query("us_any_location", RAW + r""" select id, regexp_matches(array_to_string(locations, ' | '), '\b(ASIA|EUROPE)\b')
 or contains(lower(array_to_string(locations, ' | ')), 'nation_1') as us from raw""")
def us_any_location(spark, d):
    return B.raw_postings(spark, d).select("id", A.us_any_location(
        F.col("locations"), codes=RULES.state_codes, keywords=RULES.us_keywords).alias("us"))


@query("company_mentioned", RAW + f""" select id, {MENTION_SQL} as mentioned, case when {MENTION_SQL} then '' else
 chr(39) || {CORE_SQL} || chr(39) || ' not found in description' end as reason from raw""")
def company_mentioned(spark, d):
    hit = A.company_mentioned(F.col("company_name"), F.col("description"))
    return B.raw_postings(spark, d).select(
        "id", hit.alias("mentioned"), A.mention_reason(F.col("company_name"), hit).alias("reason"))


@query("established_company", RAW + f" select id, {EST_SQL} as established from raw")
def established_company(spark, d):
    return B.raw_postings(spark, d).select("id", A.established(F.col("followers"), F.col("employees")).alias("established"))


@query("admission_status", JUDGED_SQL + " select id, status from judged")
def admission_status(spark, d):
    return _statuses(spark, d)


@query("admitted_postings", JUDGED_SQL + " select id, title, md5(description) as text, status from judged")
def admitted_postings(spark, d):
    """Whole rows with their status."""
    rows = A.admit(B.raw_postings(spark, d), B.stored_links(spark, d), RULES)
    return rows.select("id", "title", F.md5(F.col("description").cast("binary")).alias("text"), "status")


@query("admission_errors", f"""{RAW}, {B.STORED_SQL}, broken as (select * replace (case when id % 37 = 5 then null else link end as link)
 from raw), tested as (select *, coalesce({FAIL_SQL}, case when link is null then 'error' end) as fail from broken)
 select id, case when fail is not null then fail when link in (select link from stored) then 'duplicate'
 when row_number() over (partition by link, fail order by id) > 1 then 'duplicate' else 'inserted' end as status from tested""")
def admission_errors(spark, d):
    """Rows without a link can't be stored."""
    raw = B.raw_postings(spark, d).withColumn("link", F.when(F.col("id") % 37 != 5, F.col("link")))
    return A.statuses(raw, B.stored_links(spark, d), RULES)[0]


@query("admission_known_links_first", f"""{RAW}, {B.STORED_SQL}, tested as (select *, case when link in
 (select link from stored) then 'duplicate' else {FAIL_SQL} end as fail from raw)
 select id, case when fail is not null then fail
 when row_number() over (partition by link, fail order by id) > 1 then 'duplicate' else 'inserted' end as status
 from tested""")
def admission_known_links_first(spark, d):
    rules = A.AdmissionRules(**{**RULES.__dict__, "known_links_first": True})
    return _statuses(spark, d, rules=rules)


@query("admission_counts", f"{JUDGED_SQL} select keyword, {_COUNTS} from judged group by keyword")
def admission_counts(spark, d):
    return A.status_counts(_statuses(spark, d, ["keyword"]), ["keyword"])


@query("scrape_log", f"""{JUDGED_SQL} select keyword, count(*) as cards_scraped,
 {', '.join(f"count(*) filter (status = '{s}') as {s}" for s in ('inserted', 'duplicate', 'blocked', 'bad_title', 'error'))},
 (select count(*) from stored) as total_in_db, timestamp '{NOW}' as completed_at from judged group by keyword""")
def scrape_log(spark, d):
    return A.scrape_log(_statuses(spark, d, ["keyword"]), B.stored_links(spark, d), NOW)


@query("rows_to_store", f"""{JUDGED_SQL} select id, title, link, source, coalesce(posted_date, timestamp '{NOW}')
 as posted_date from judged where status = 'inserted'""")
def rows_to_store(spark, d):
    done = ingest(B.raw_postings(spark, d), B.stored_links(spark, d), NOW, RULES)
    return done.postings.select("id", "title", "link", "source", "posted_date")


def _safe(expr):
    return (f"substring(regexp_replace(regexp_replace(trim({expr}), '[<>:\"/\\\\|?*]', '', 'g'), "
            "'\\s+', ' ', 'g'), 1, 100)")


_DESCRIBED = f"""'descriptions/' || {_safe("coalesce(company_name, 'unknown')")} || '/' || {_safe('title')} || '_'
 || substring(sha1(link), 1, 12) || '.txt'"""


@query("stored_postings", f"""{JUDGED_SQL} select id, company_name, title, case when description <> '' then 'gs://texts/' || {_DESCRIBED}
 else description end as description, description as text, link, location, coalesce(posted_date, timestamp '{NOW}') as posted_date,
 cast(null as double) as pay_min, source, cast(null as varchar) as skills, cast(null as int) as experience_years,
 cast(null as timestamp) as enriched_at, cast(null as int) as n_embedding, cast(round(epoch(timestamp '{NOW}') / 3600) as int) as added_at
 from judged where status = 'inserted'""")
def stored_postings(spark, d):
    """Postings as they are stored, with their texts read back through the addresses."""
    done = ingest(B.raw_postings(spark, d), B.stored_links(spark, d), NOW, RULES, text_root="gs://texts")
    rows = readers.resolve_descriptions(done.postings, writers.text_uris(done.descriptions, "gs://texts"))
    return rows.select("id", "company_name", "title", "description", "text", "link", "location", "posted_date",
                       F.col("salary.min").alias("pay_min"), "source", F.array_join("skills", "|").alias("skills"), "experience_years",
                       "enriched_at", F.cardinality("embedding").alias("n_embedding"), "added_at")


@query("ingest", f"{JUDGED_SQL} select source, {_COUNTS} from judged group by source")
def ingest_counts(spark, d):
    return ingest(B.raw_postings(spark, d), B.stored_links(spark, d), NOW, RULES).counts


@query("deduped_batch", f"""{RAW}, {B.STORED_SQL} select id, case when link in (select link from stored) or row_number() over
 (partition by link order by id) > 1 then 'duplicate' else 'inserted' end as status from raw""")
def deduped_batch(spark, d):
    done = ingest(B.raw_postings(spark, d), B.stored_links(spark, d), NOW, admission=False)
    return done.statuses.select("id", "status")


@query("description_paths", JUDGED_SQL + f""" select 'descriptions/' || {_safe("coalesce(company_name, 'unknown')")}
 || '/' || {_safe('title')} || '_' || substring(sha1(link), 1, 12) || '.txt' as path, description as text
 from judged where status = 'inserted' and coalesce(description, '') <> ''""")
def description_paths(spark, d):
    return ingest(B.raw_postings(spark, d), B.stored_links(spark, d), NOW, RULES).descriptions


@query("chunk_paths", P + r""", c as (select id, company_name, title, unnest(string_split(description, chr(10))) as text,
 generate_subscripts(string_split(description, chr(10)), 1) - 1 as chunk_index from postings)
 select id, chunk_index, 'chunks/' || company_name || '/' || title || '_' || id || '_chunk_' || chunk_index || '.txt'
 as path, text from c""")
def chunk_paths(spark, d):
    rows = B.postings(spark, d).withColumn("chunks", F.split("description", "\n"))
    return writers.chunk_table(rows).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("data_tech_title", P + """ select id, case when coalesce(title, '') = '' then true
 else contains(lower(title), 'ring') or contains(lower(title), 'econ') end as on_topic from postings""")
def data_tech_title(spark, d):
    return B.postings(spark, d).select("id", A.data_tech_title(F.col("title"), ["ring", "econ"]).alias("on_topic"))


@query("title_relevant", P + r""" select id, title, contains(lower(title), 'gear s') or
 (regexp_matches(lower(title), '\bgear') and regexp_matches(lower(title), '\bs')) as relevant from postings""")
def title_relevant(spark, d):
    return B.postings(spark, d).select("id", "title", A.title_relevant(F.col("title"), " Gear S").alias("relevant"))


@query("pending_backlog", P + """ select id, title from postings where description is not null
 and description not like '%??%' and skills is null and source = 'lever' order by id limit 200""")
def pending_backlog(spark, d):
    return A.pending(B.postings(spark, d), "skills", 200, "lever").select("id", "title")


@query("pending_all", P + """ select id, 'skills' as target from postings where description is not null
 and description not like '%??%' and skills is null union all
 select id, 'years' from postings where description is not null and description not like '%??%'
 and experience_years is null union all
 select id, 'any' from postings where description is not null and description not like '%??%'""")
def pending_all(spark, d):
    p = B.postings(spark, d)
    parts = [A.pending(p, "skills").select("id", F.lit("skills").alias("target")),
             A.pending(p, "experience_years").select("id", F.lit("years").alias("target")),
             A.pending(p, "embedding", force=True).select("id", F.lit("any").alias("target"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CARD = """(o_orderpriority || ' ' || case when o_custkey % 3 = 0 then 'Over ' || o_custkey || ' applicants' when
 o_custkey % 3 = 1 then o_custkey || ' applicants' else 'new' end || case when o_orderstatus = 'P' then ' Reposted today'
 else '' end || ' by ' || c_mktsegment)"""


@query("listing_reason", rf"""with cards as (select o_orderkey, o_custkey, {_CARD} as text from orders
 join customer on c_custkey = o_custkey), t as (select *, lower(text) as low,
 try_cast(nullif(regexp_extract(text, '(?i)(\d+)\s+applicants?', 1), '') as bigint) as n from cards)
 select o_orderkey, case when o_custkey in (select s_suppkey from supplier) then 'seen'
 when contains(low, 'reposted') then 'reposted' when regexp_matches(text, '(?i)over\s+\d+\s+applicants?') or n >= 700
 then 'applicants' when contains(low, 'machinery') or contains(replace(low, ' ', ''), 'byhousehold') then 'blocked' end
 as reason from t""")
def listing_reason(spark, d):
    o, c, s = (B.table(spark, d, t) for t in ("orders", "customer", "supplier"))
    n = F.col("o_custkey").cast("string")
    text = F.concat(
        "o_orderpriority", F.lit(" "),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Over "), n, F.lit(" applicants")))
        .when(F.col("o_custkey") % 3 == 1, F.concat(n, F.lit(" applicants"))).otherwise("new"),
        F.when(F.col("o_orderstatus") == "P", " Reposted today").otherwise(""), F.lit(" by "), "c_mktsegment")
    seen = s.select(F.col("s_suppkey").alias("o_custkey"), F.lit(True).alias("seen"))
    cards = o.join(c, c.c_custkey == o.o_custkey).join(seen, "o_custkey", "left")
    why = A.listing_reason(text, ["Machinery", "by household"], 700, F.col("seen"))
    return cards.select("o_orderkey", why.alias("reason"))


@query("real_names", r"""select page_id, name from (select page_id, unnest(string_split(regexp_extract(html,
 '(?s)<title>(.*?)</title>', 1), ' ')) as name from pages) where length(name) between 3 and 79
 and not regexp_matches(name, '(?i)^(the|that|\d+)$')""")
def real_names(spark, d):
    p = B.table(spark, d, "pages")
    names = p.select("page_id", F.explode(F.split(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), " ")).alias("name"))
    return names.where(A.real_name(F.col("name"), r"^(the|that|\d+)$"))


@query("page_state", """select page_id, case when contains(lower(url), '/de/') or contains(lower(url), 'casino') then
 'captcha' when contains(lower(url), 'utm_source') then 'login_wall' when contains(lower(html), 'error') or
 contains(lower(html), 'tion the') then 'expired' else 'ok' end as state,
 contains(lower(html), 'track(3)') or contains(lower(html), 'sitemap') as challenge from pages""")
def page_state(spark, d):
    p = B.table(spark, d, "pages")
    state = A.page_state(F.col("url"), F.col("html"), ["/de/", "casino"], ["utm_source"], ["error", "tion the"])
    return p.select("page_id", state.alias("state"),
                    A.challenge_page(F.col("html"), ["track(3)", "sitemap"]).alias("challenge"))


@query("text_at_least", "select page_id, case when length(html) > 5000 then html end as long_html from pages")
def text_at_least(spark, d):
    return B.table(spark, d, "pages").select("page_id", feeds.at_least(F.col("html"), 5000).alias("long_html"))


@query("open_board_postings", rf"""with boards as (select s_suppkey as key, s_name as company_name from supplier where
 not regexp_matches(s_name, '(?i)\b(supplier#000000003|supplier#000000007)\b'))
 select p_partkey, company_name from lineitem join boards on key = l_suppkey join part on p_partkey = l_partkey
 where not contains(lower(p_name), 'old widget') and regexp_matches(p_name, '(?i)\b(ring|bolt|gear|widget)\b')""")
def open_board_postings(spark, d):
    s, p, li = (B.table(spark, d, t) for t in ("supplier", "part", "lineitem"))
    boards = A.open_boards(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("company_name")), RULES.blocked)
    jobs = li.join(p, p.p_partkey == li.l_partkey)
    jobs = jobs.where(A.good_title(F.col("p_name"), RULES.title_keywords, RULES.title_excludes))
    return jobs.join(boards, "l_suppkey").select("p_partkey", "company_name")


# ------------------------------------------------------------------ keys
@query("unknown_links", f"{RAW}, {B.STORED_SQL} select id from raw where link not in (select link from stored)")
def unknown_links(spark, d):
    return K.unknown_only(B.raw_postings(spark, d), B.stored_links(spark, d), "link", "id").select("id")


@query("unknown_links_of_source", f"""{RAW}, kept as (select link from raw where source = 'greenhouse')
 select id, source from raw where link not in (select link from kept)""")
def unknown_links_of_source(spark, d):
    raw = B.raw_postings(spark, d)
    return K.unknown_in_source(raw, raw.select("link", "source"), "greenhouse", row_id="id").select("id", "source")


@query("first_per_link", P + """ select id, link, source from postings
 qualify row_number() over (partition by link order by posted_date asc nulls first, id) = 1""")
def first_per_link(spark, d):
    return K.first_per_key(B.postings(spark, d), ["link"], ["posted_date"], "id").select("id", "link", "source")


@query("first_event_per_user", """select event_id, user_id, event_type from events
 qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1""")
def first_event_per_user(spark, d):
    e = B.table(spark, d, "events")
    return K.first_per_key(e, ["user_id", "event_type"], ["ts"], "event_id").select("event_id", "user_id", "event_type")


@query("requested_postings", P + " select id, title from postings where id in (select vec_id * 3 from embeddings)")
def requested_postings(spark, d):
    ids = B.table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("id"))
    return K.known_only(B.postings(spark, d), ids, "id", "id").select("id", "title")


@query("details_by_key", P + """ select id, coalesce(label, -1) as label from postings
 left join embeddings on vec_id = id""")
def details_by_key(spark, d):
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return feeds.merge_details(B.postings(spark, d).select("id"), e, "id", "label", -1)


@query("upserted_suppliers", """select coalesce(s_suppkey, c_custkey) as key,
 case when s_suppkey is not null then s_name else c_name end as name,
 case when c_custkey is not null then c_acctbal else s_acctbal end as balance
 from supplier full join (select * from customer where c_mktsegment = 'MACHINERY') on c_custkey = s_suppkey""")
def upserted_suppliers(spark, d):
    s, c = B.table(spark, d, "supplier"), B.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    old = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return K.upsert(old, new, "key", ["balance"])


@query("inserted_if_absent", """select s_suppkey as key, s_name as name from supplier union all
 select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)""")
def inserted_if_absent(spark, d):
    s, c = B.table(spark, d, "supplier"), B.table(spark, d, "customer")
    return K.insert_if_absent(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
                              c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), "key")


_UPDATED = P + """ select id, case when o_orderkey is not null then cast(o_custkey % 21 as int)
 else experience_years end as experience_years, coalesce(case when o_orderstatus = 'O' then o_orderpriority end, source)
 as source from postings left join (select * from orders where o_totalprice > 250000) on o_orderkey = id"""


def _updates(spark, d):
    o = B.table(spark, d, "orders").where("o_totalprice > 250000")
    years = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 21).cast("int").alias("experience_years"))
    found = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("source"))
    return B.postings(spark, d).select("id", "experience_years", "source"), years, found


@query("updated_postings", _UPDATED)
def updated_postings(spark, d):
    base, years, found = _updates(spark, d)
    once = K.apply_updates(base, years, "id", ["experience_years"])
    return K.apply_updates(once, found, "id", ["source"], only_found=True)


@query("updated_parts", _UPDATED)
def updated_parts(spark, d):
    """The same updates in place: only ranges of ids that have one are rewritten."""
    base, years, found = _updates(spark, d)
    table = KeyedTable(spark, scratch_folder(spark, "postings"), "id", ranged(100)).write(base)
    ours = lambda rows: rows.join(table.read().select("id"), "id", "left_semi")  # noqa: E731 - the table as it is by then
    table.update(ours(years), ["experience_years"])
    table.update(ours(found), ["source"], only_found=True)
    return table.read()


@query("conformed_schema", P + """ select id, title, cast(null as varchar) as currency, cast(experience_years as int)
 as experience_years, cast(null as int) as added_at from postings""")
def conformed_schema(spark, d):
    from jobspan import schemas

    rows = schemas.conform(B.postings(spark, d), schemas.POSTINGS)
    return rows.select("id", "title", F.col("salary.currency").alias("currency"), "experience_years", "added_at")
