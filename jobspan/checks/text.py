"""Text operators over all pages and documents: HTML, sections, years, skills, paths, answers."""
from pyspark.sql import functions as F

from jobspan import bindings as B
from jobspan import vocab
from jobspan.checks.registry import query
from jobspan.functions import answers as A
from jobspan.functions import parse as V
from jobspan.functions import skills as K
from jobspan.functions import text as T
from jobspan.operators import vocabulary as L
from jobspan.operators.keys import carry_forward
from jobspan.session import written

P = "with " + B.POSTINGS_SQL
NOW = B.NOW
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# Those that the pages hold.
ENTITIES = {"nbsp": "\xa0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "copy": "©", "middot": "·", "eacute": "é"}


def _entities(expr: str) -> str:
    for name, char in ENTITIES.items():
        expr = f"replace({expr}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({expr}, '&amp;', '&')"


_CUT = (r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(1), 'g'), "
        r"'</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>', chr(1), 'g')")
HTML_SQL = f"""translate(array_to_string(list_filter(list_transform(string_split({_entities(_CUT)}, chr(1)),
 lambda p: trim(p, {WS})), lambda p: p <> ''), chr(10)), '‘’‚‛“”„‟' || chr(160), '''''''''""\"" ')"""
HTML_SQL = HTML_SQL.replace("""'''''''''""\"" '""", "chr(39)||chr(39)||chr(39)||chr(39)||'\"\"\"\" '")


@query("html_text", f"select page_id, {HTML_SQL} as text from pages")
def html_text(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("stripped_tags", r"""select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ',
 'g')) as text from pages""")
def stripped_tags(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


# Headings in the documents' own words; neighbours are spelled out because word boundaries differ between engines.
HEADS = {
    "STOP": "(^|[^a-z])(was|que)([^a-z]|$)",
    "requirements": "(^|[^a-z])(the|der) [a-z]+",
    "skills": "(^|[^a-z])(and|la)([^a-z]|$)",
    "responsibilities": "(^|[^a-z])(of|de)([^a-z]|$)",
}
SHAPE = dict(patterns=HEADS, max_len=200, ratio=0.05)
_CORE = f"trim(regexp_replace(trim(line, {WS}), ':+$', ''), {WS})"
_CLASS = f"case when length({_CORE}) = 0 or length({_CORE}) > 200 then null " + " ".join(
    f"when length(regexp_extract({_CORE}, '(?i){p}')) / cast(length({_CORE}) as double) >= 0.05 then '{n}'"
    for n, p in HEADS.items()) + " end"
LINES = f"""lines as (select doc_id, pos, line, {_CLASS} as head from (select doc_id,
 unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))"""
CARRIED = f"""{LINES}, carried as (select *, last_value(head ignore nulls) over (partition by doc_id order by pos
 rows between unbounded preceding and current row) as section from lines)"""


def _lines(spark, d):
    docs = B.table(spark, d, "documents")
    rows = docs.select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line",
                       T.header_class(F.col("line"), **SHAPE).alias("head"))


@query("heading_class", f"with {LINES} select doc_id, pos, head from lines")
def heading_class(spark, d):
    return _lines(spark, d).select("doc_id", "pos", "head")


@query("heading_carried", f"with {CARRIED} select doc_id, pos, section from carried")
def heading_carried(spark, d):
    return carry_forward(_lines(spark, d), "head", "section", ["doc_id"], ["pos"]).select("doc_id", "pos", "section")


_SECTIONS = f"""with {CARRIED}, kept as (select doc_id, pos, trim(line, {WS}) as line, case section when 'requirements'
 then 1 when 'skills' then 2 when 'responsibilities' then 3 end as place from carried
 where head is null and section <> 'STOP' and trim(line, {WS}) <> ''), parts as (
 select doc_id, string_agg(line, ' ' order by place, pos) as part from kept group by doc_id),
 sections as (select d.doc_id, coalesce(part, text) as section from documents d
 left join parts p on p.doc_id = d.doc_id)"""


@query("section_text", _SECTIONS + " select doc_id, section from sections")
def section_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.section_text(F.col("text"), **SHAPE).alias("section"))


@query("embed_text", f"""{_SECTIONS} select doc_id, case when coalesce(lang, '') <> '' then lang || chr(10) || chr(10)
 || section else section end as embed_text from sections join documents using (doc_id)""")
def embed_text(spark, d):
    parsed = T.section_text(F.col("text"), **SHAPE)
    return B.table(spark, d, "documents").select("doc_id", T.embed_text(F.col("lang"), parsed).alias("embed_text"))


_YEARS_TEXT = """(l_linenumber || ' years in town. ' || cast(l_quantity as int) || '+ years of experience, including ' ||
 l_linenumber || ' years here and plus ' || (l_partkey % 9) || ' years; ' || (l_suppkey % 30) ||
 ' to 40 years of related experience')"""
# Written out: the SQL borrows no pattern from the code that it checks.
_YP = (r"'(\d{1,2})\s*(?:\+|[-–]\s*\d{1,2}|\s+(?:to|or\s+more)\s+\d{0,2})?\s*\+?\s*years?\s+"
       r"(?:(?:of\s+)?(?:relevant\s+|professional\s+|work\s+|related\s+)?(?:experience|exp(?:erience)?)|in\b)'")
_SP = r"'(?:including|of\s+which|comprising|of\s+that|plus)\s+(\d{1,2})\s*\+?\s*years?'"


@query("years_of_experience", f"""with t as (select l_orderkey, l_linenumber, l_partkey, {_YEARS_TEXT} as text from lineitem),
 v as (select *, list_filter(list_transform(regexp_extract_all(text, {_YP}, 1, 'i'), lambda x: cast(x as int)),
 lambda x: x between 1 and 20) as every, list_filter(list_transform(regexp_extract_all(text, {_SP}, 1, 'i'),
 lambda x: cast(x as int)), lambda x: x between 1 and 20) as sub from t)
 select l_orderkey, l_linenumber, l_partkey, coalesce(list_filter(every, lambda x: not list_contains(sub, x))[1],
 every[1]) as years from v""")
def years_of_experience(spark, d):
    s = lambda c: F.col(c).cast("string")
    text = F.concat(
        s("l_linenumber"), F.lit(" years in town. "), F.col("l_quantity").cast("int").cast("string"),
        F.lit("+ years of experience, including "), s("l_linenumber"), F.lit(" years here and plus "),
        (F.col("l_partkey") % 9).cast("string"), F.lit(" years; "), (F.col("l_suppkey") % 30).cast("string"),
        F.lit(" to 40 years of related experience"))
    return B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", T.extract_years(text).alias("years"))


# ------------------------------------------------------------------ skills
REGISTRY = {"ring": "Ring", "and the": "AND-THE", "of": "Of", "bolt": "Bolt", "le": "Le", "der": "Der", "the": "The",
            "la": "La", "y la": "Y La", "gear": "Gear", "tion": "Of"}
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\p{{M}}]+')"


def _scan_sql(text: str) -> str:
    hits = []
    for k, v in REGISTRY.items():
        test = (f"list_contains(toks, '{k}')" if k.isalnum()
                else f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])')")
        hits.append(f"case when {test} then '{v}' end")
    firsts = ", ".join(hits)
    return f"list_filter([{firsts}], lambda x: x is not null)"


_SCAN = f"""scanned as (select *, {_scan_sql('text')} as raw_names from (select *, {_TOKENS.format('text')} as toks,
 lower(text) as low from documents)), named as (select *, list_filter(raw_names, lambda x, i:
 list_position(raw_names, x) = i) as names from scanned)"""


@query("vocabulary_scan", f"with {_SCAN} select doc_id, array_to_string(names, '|') as skills from named")
def vocabulary_scan(spark, d):
    docs = B.table(spark, d, "documents")
    low = docs.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.array_join(K.scan_vocabulary(F.col("low"), REGISTRY), "|").alias("skills"))


@query("vocabulary_join", f"with {_SCAN} select doc_id, array_to_string(names, '|') as skills from named")
def vocabulary_join(spark, d):
    """The same keys through the join."""
    keys = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(REGISTRY.items())], "key string, name string, pos long")
    found = L.scan_large(B.table(spark, d, "documents"), L.vocabulary_table(keys), "doc_id")
    return found.select("doc_id", F.array_join("skills", "|").alias("skills"))


# The default keys, of which each text names two more than it may hold by chance.
_KEYS = list(vocab.KNOWN_SKILLS.items())
_VALUES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_KEYS))
_MENTIONS = rf"""keys as (select * from (values {_VALUES}) t(pos, key, name)), texts as (select doc_id, lower(coalesce(text, '') || ' (' || a.key
 || '), ' || b.key || '_') as low from documents join keys a on a.pos = doc_id % {len(_KEYS)} join keys b on b.pos = doc_id * 7 % {len(_KEYS)}),
 toks as (select *, {_TOKENS.format('low')} as toks from texts),
 hits as (select doc_id, name, min(pos) as pos from toks join keys on case when regexp_matches(key, '^\w+$') then list_contains(toks, key)
 when contains(low, key) and regexp_matches(key, '\w$') then regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(key) || '($|[^\p{{L}}\p{{N}}_])')
 when contains(low, key) then regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(key) || '($|[^a-z0-9])') else false end group by all)
 select doc_id, coalesce(string_agg(name, '|' order by pos) filter (name is not null), '') as skills from texts left join hits using (doc_id)
 group by 1"""


def _mentions(spark, d):
    keys = F.array(*[F.lit(k) for k, _ in _KEYS])
    named = lambda times: F.get(keys, (F.col("doc_id") * times % len(_KEYS)).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" ("), named(1), F.lit("), "), named(7), F.lit("_"))
    return B.table(spark, d, "documents").select("doc_id", text.alias("text"))


@query("vocabulary_default", f"with {_MENTIONS}")
def vocabulary_default(spark, d):
    """The 220 default keys as expressions."""
    low = _mentions(spark, d).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.array_join(K.scan_vocabulary(F.col("low")), "|").alias("skills"))


@query("vocabulary_default_join", f"with {_MENTIONS}")
def vocabulary_default_join(spark, d):
    """The 220 default keys through the join."""
    keys = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(_KEYS)], "key string, name string, pos long")
    return L.scan_large(_mentions(spark, d), L.vocabulary_table(keys), "doc_id").select("doc_id", F.array_join("skills", "|").alias("skills"))


_PAIRS = r"""runs as (select doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as r,
 regexp_split_to_array(lower(text), '[\p{L}\p{N}_]+') as s from documents),
 places as (select doc_id, lang, r, s, unnest(range(1, len(r))) as i from runs),
 pairs as (select distinct doc_id, lang, r[i] || ' ' || r[i + 1] as key from places where s[i + 1] = ' '),
 vocabulary as (select distinct key from pairs where lang = 'en' and regexp_matches(key, '^[a-z]+ [a-z]+$'))"""


@query("vocabulary_large", f"""with {_PAIRS}, hits as (select doc_id, key from pairs join vocabulary using (key))
 select d.doc_id, count(key) as n, md5(coalesce(string_agg(key, '|' order by key), '')) as keys from documents d
 left join hits h on h.doc_id = d.doc_id group by 1""")
def vocabulary_large(spark, d):
    """All pairs of words of the English texts as keys, 100,000 and more, sought in all texts."""
    docs = B.table(spark, d, "documents")
    low = F.lower("text")
    pair = r"(?<![\p{L}\p{N}_])(?=([a-z]++ [a-z]++)(?![\p{L}\p{N}_]))[a-z]++"  # a pair is looked at whole, its first word passed
    between = docs.where("lang = 'en'").select(F.explode(F.regexp_extract_all(low, F.lit(pair), F.lit(1))).alias("key")).distinct()
    keys = L.vocabulary_table(between.select("key", F.col("key").alias("name"), F.lit(0).alias("pos")))
    found = L.scan_large(docs, written(keys, "vocabulary"), "doc_id")
    return found.select("doc_id", F.size("skills").cast("long").alias("n"),
                        F.md5(F.array_join(F.sort_array("skills"), "|").cast("binary")).alias("keys"))


_GUARD = dict(blocklist=["red", "old"], short=["x1"], canonical={"ring": "RING", "bolt": "Bolts", "gear": "Bolts"})
# the offered skills: words of the part, one with blanks, one generic, one of the company, one short
_OFFER = "[' ' || p_name || ' ', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), upper(split_part(p_name, ' ', 2)), p_brand, 'zz', 'x1', 'Gear']"
_DESC = "lower(p_name || ' ' || p_type || ' x1 gear ' || case when p_size > 25 then p_brand else '' end)"


def _guard_sql(offer: str, desc: str, company: str) -> str:
    norm = r"regexp_replace(trim(lower(s)), '\s+', ' ', 'g')"
    words = rf"list_concat([lower({company})], list_filter(regexp_split_to_array(lower({company}), '[\s,.&]+'), lambda t: t not in ('', 'inc', 'corp', 'llc', 'ltd', 'co', 'the')))"
    canon = f"case {norm} when 'ring' then 'RING' when 'bolt' then 'Bolts' when 'gear' then 'Bolts' else trim(s) end"
    kept = (f"list_filter({offer}, lambda s: trim(s) <> '' and (length({norm}) >= 3 or {norm} in ('x1')) and {norm} not in "
            f"('red', 'old') and not list_contains({words}, {norm}) and contains({desc}, {norm}))")
    return f"list_transform({kept}, lambda s: {canon})"


@query("guarded_skills", f"""with g as (select p_partkey, {_guard_sql(_OFFER, _DESC, "p_type || ' Hot, Inc.'")} as k from part)
 select p_partkey, array_to_string(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i),
 '|') as skills from g""")
def guarded_skills(spark, d):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    offer = F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), first, second, F.upper(second), "p_brand",
                    F.lit("zz"), F.lit("x1"), F.lit("Gear"))
    desc = F.lower(F.concat("p_name", F.lit(" "), "p_type", F.lit(" x1 gear "),
                            F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("")))
    company = F.concat("p_type", F.lit(" Hot, Inc."))
    p = B.table(spark, d, "part").withColumn("low", desc)
    return p.select("p_partkey", F.array_join(K.guard_skills(offer, F.col("low"), company, **_GUARD), "|").alias("skills"))


@query("skill_union", """select p_partkey, array_to_string(list_concat(string_split(p_name, ' '), list_filter([upper(split_part(
 p_name, ' ', 1)), p_brand, p_type], lambda s: not list_contains(string_split(p_name, ' '), lower(s)))), '|') as skills from part""")
def skill_union(spark, d):
    have = F.split("p_name", " ")
    extra = F.array(F.upper(F.get(have, F.lit(0))), F.col("p_brand"), F.col("p_type"))
    return B.table(spark, d, "part").select("p_partkey", F.array_join(K.add_missing(have, extra), "|").alias("skills"))


# ------------------------------------------------------------------ values on cards
@query("salary_card", """select o_orderkey, case when o_orderstatus = 'O' then cast(o_custkey * 2080 as double)
 when o_orderstatus = 'F' then cast(o_custkey * 1000 as double) end as low, case when o_orderstatus = 'O' then cast(o_custkey * 2080 as double)
 when o_orderstatus = 'F' then cast(cast(o_totalprice as bigint) as double) end as high, case when o_orderstatus <> 'P' then 'USD' end
 as currency from orders""")
def salary_card(spark, d):
    n, total = F.col("o_custkey").cast("string"), F.bround("o_totalprice").cast("long")
    text = (F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("$"), n, F.lit("/hr")))
            .when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), n, F.lit("K/yr - $"), F.format_number(total, 0)))
            .otherwise("competitive"))
    pay = V.parse_salary(text)
    return B.table(spark, d, "orders").select(
        "o_orderkey", pay["min"].alias("low"), pay["max"].alias("high"), pay["currency"].alias("currency"))


@query("salary_plain", """select o_orderkey, cast(o_custkey * 2080 as double) as low, cast(cast(o_totalprice as bigint) * 2080 as double) as high from orders""")
def salary_plain(spark, d):
    text = F.concat(F.col("o_custkey").cast("string"), F.lit(" to $"),
                    F.format_number(F.bround("o_totalprice").cast("long"), 0), F.lit(" an Hour"))
    pay = V.parse_salary(text, "plain")
    return B.table(spark, d, "orders").select("o_orderkey", pay["min"].alias("low"), pay["max"].alias("high"))


_AGO = """case l_linenumber when 1 then timestamp '{0}' - interval (l_suppkey) second when 2 then timestamp '{0}' -
 interval (l_suppkey) minute when 3 then timestamp '{0}' - interval (l_suppkey) hour when 4 then timestamp '{0}' -
 interval (l_suppkey) day when 5 then timestamp '{0}' - interval (l_suppkey * 7) day when 6 then timestamp '{0}' end"""


@query("relative_times", f"""select l_orderkey, l_partkey, l_linenumber, {_AGO.format(NOW)} as at from lineitem""")
def relative_times(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("seconds ago", "Minutes", "hours", "day", "weeks", "x", "months")]),
                        F.col("l_linenumber"))
    text = F.when(F.col("l_linenumber") == 6, "Just now").otherwise(
        F.concat(F.lit("Posted "), F.col("l_suppkey").cast("string"), F.lit(" "), unit))
    return B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", V.relative_time(text, NOW).alias("at"))


@query("relative_days", f"""select o_orderkey, case o_orderstatus when 'O' then timestamp '{NOW}' - interval (o_custkey) day
 when 'F' then timestamp '{NOW}' - interval 30 day else timestamp '{NOW}' end as at from orders""")
def relative_days(spark, d):
    text = (F.when(F.col("o_orderstatus") == "O", F.concat(F.col("o_custkey").cast("string"), F.lit(" days ago")))
            .when(F.col("o_orderstatus") == "F", "30+ Days").otherwise("Active today"))
    return B.table(spark, d, "orders").select("o_orderkey", V.relative_day(text, NOW).alias("at"))


@query("iso_and_epoch_times", """select event_id, date_trunc('second', ts) as iso, case when event_type <> 'view' then
 date_trunc('millisecond', ts) end as from_ms from events""")
def iso_and_epoch_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ms = F.when(F.col("event_type") != "view", F.unix_millis(ts)).otherwise(0)
    return B.table(spark, d, "events").select(
        "event_id", V.iso_time(iso).alias("iso"), V.epoch_ms_time(ms).alias("from_ms"))


@query("followers_and_employees", """select o_orderkey, case when o_orderstatus = 'O' then o_custkey * 1000 else
 cast(o_totalprice as bigint) end as followers, cast(o_totalprice as bigint) as employees from orders""")
def followers_and_employees(spark, d):
    n = F.format_number(F.bround("o_totalprice").cast("long"), 0)
    follow = F.when(F.col("o_orderstatus") == "O", F.concat(F.col("o_custkey").cast("string"), F.lit("K followers"))
                    ).otherwise(F.concat(n, F.lit(" Followers")))
    staff = F.when(F.col("o_orderstatus") == "F", F.concat(n, F.lit("+ employees"))).otherwise(
        F.concat(n, F.lit("-9,000,000 employees")))
    return B.table(spark, d, "orders").select(
        "o_orderkey", V.followers(follow).alias("followers"), V.employees(staff).alias("employees"))


@query("clean_titles", "select p_partkey, p_name as title from part")
def clean_titles(spark, d):
    badge = F.when(F.col("p_size") > 30, " with verification").when(F.col("p_size") > 15, "  Promoted ").otherwise("")
    return B.table(spark, d, "part").select("p_partkey", V.clean_title(F.concat("p_name", badge)).alias("title"))


# ------------------------------------------------------------------ requests and answers
_HEAD = """'List the technical skills named in this posting and the minimum years of experience it asks for.
Answer as JSON: {"required_skills": [...], "experience_years": n or null}

Posting:
'"""


@query("skill_requests", P + f""" select id, {_HEAD} || description as request from postings
 where description is not null""")
def skill_requests(spark, d):
    p = B.postings(spark, d).where("description is not null")
    return p.select("id", A.request_text("skills", F.col("description")).alias("request"))


def _answers(spark, d):
    """Answers as a model might give them, made from the parts: lists, bad lists, numbers, text, fences, broken JSON."""
    p = B.table(spark, d, "part")
    words = F.split("p_name", " ")
    good = F.to_json(F.struct(words.alias("required_skills"), F.col("p_size").alias("experience_years")))
    other = F.to_json(F.struct(words.alias("skills"), F.concat(F.col("p_size").cast("string"), F.lit(" years")).alias(
        "experience_years")))
    wrong = F.to_json(F.struct(F.col("p_name").alias("required_skills"), (-F.col("p_size")).alias("experience_years")))
    raw = (F.when(F.col("p_type") == "ECONOMY", good).when(F.col("p_type") == "PROMO", other)
           .when(F.col("p_type") == "LARGE", wrong).when(F.col("p_type") == "SMALL", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
           .when(F.col("p_type") == "MEDIUM", F.lit("sorry, no")))
    return p.select("p_partkey", "p_name", raw.alias("raw"))


@query("skills_answers", """select p_partkey, coalesce(p_type in ('ECONOMY', 'PROMO', 'LARGE'), false) as ok,
 case when p_type in ('ECONOMY', 'PROMO') then replace(p_name, ' ', '|') when p_type in ('LARGE') then '' else '' end as skills,
 case when p_type in ('ECONOMY', 'PROMO') then p_size end as years from part""")
def skills_answers(spark, d):
    a = A.skills_answer(F.col("raw"))
    return _answers(spark, d).select(
        "p_partkey", a["ok"].alias("ok"), F.array_join(a["skills"], "|").alias("skills"), a["years"].alias("years"))


@query("years_answers", """select p_partkey, case when p_type in ('ECONOMY', 'SMALL') and p_size <= 40 then p_size
 when p_type = 'PROMO' then p_size end as years, case p_type when 'MEDIUM' then 'not json' when 'STANDARD' then 'missing' end
 as problem from part""")
def years_answers(spark, d):
    return _answers(spark, d).select(
        "p_partkey", A.years_answer(F.col("raw")).alias("years"), A.answer_problem(F.col("raw")).alias("problem"))


@query("two_tier_years", P + """ select id, coalesce(experience_years, cast(length(title) as int)) as years,
 case when experience_years is not null then 'rule' else 'model' end as origin from postings""")
def two_tier_years(spark, d):
    years, origin = A.two_tier(F.col("experience_years"), F.length("title"))
    return B.postings(spark, d).select("id", years.alias("years"), origin.alias("origin"))


@query("resume_answers", """select p_partkey, case when p_size > 25 then replace(p_name, ' ', '|') else '' end as skills,
 case when p_size > 25 then p_size end as years, case when p_size > 25 then p_type else p_brand || ' resume'
 end as summary from part""")
def resume_answers(spark, d):
    raw = F.when(F.col("p_size") > 25, F.concat(F.lit("```"), F.to_json(F.struct(
        F.split("p_name", " ").alias("skills"), F.col("p_size").alias("experience_years"), F.col("p_type").alias("summary"))),
        F.lit("```"))).otherwise("{broken")
    a = A.resume_answer(raw, F.concat("p_brand", F.lit(" resume")))
    return B.table(spark, d, "part").select(
        "p_partkey", F.array_join(a["skills"], "|").alias("skills"), a["experience_years"].alias("years"),
        a["summary"].alias("summary"))


@query("company_and_role_answers", """select p_partkey, case when p_size > 25 then p_brand when p_size > 10 then 'Unnamed' end
 as company, case when p_size > 10 then p_name end as role, case when p_size > 10 then replace(p_name, ' ', '|') end as words
 from part""")
def company_and_role_answers(spark, d):
    doc = F.struct(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("company_name"),
                   F.col("p_name").alias("role"), F.split("p_name", " ").alias("key_keywords"))
    raw = F.when(F.col("p_size") > 10, F.to_json(doc)).otherwise("no")
    c, r = A.company_answer(raw, F.lit("Unnamed")), A.role_answer(raw)
    return B.table(spark, d, "part").select(
        "p_partkey", c["company_name"].alias("company"), r["role"].alias("role"),
        F.array_join(r["key_keywords"], "|").alias("words"))


@query("explanations", """select p_partkey, p_partkey + 1 as job_id, p_name as explanation from part where p_name <> ''
 union all select p_partkey, p_partkey, p_type from part where p_size > 10""")
def explanations(spark, d):
    one, two = (F.col("p_partkey") + 1).cast("string"), F.col("p_partkey").cast("string")
    raw = F.concat(F.lit("```json\n"), F.to_json(F.map_from_arrays(
        F.array(one, two), F.array(F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("")))), F.lit("```"))
    return B.table(spark, d, "part").select("p_partkey", F.explode(A.text_by_id(raw)).alias("job_id", "explanation"))


@query("question_classes", """select p_partkey, case when p_size > 25 then 'skill_gap' when p_size > 10 then 'top_skills'
 else 'off_topic' end as category, case when p_size > 25 then lower(p_type) else '' end as role,
 case when p_size > 25 then replace(p_name, ' ', '|') else '' end as known from part""")
def question_classes(spark, d):
    full = F.to_json(F.struct(F.lit("skill_gap").alias("category"), F.concat(F.lit(" "), "p_type").alias("role"),
                              F.split("p_name", " ").alias("skills_known")))
    raw = F.when(F.col("p_size") > 25, full).when(F.col("p_size") > 10, F.lit('{"category": "top_skills", "role": null}')
                                                  ).otherwise("hm")
    c = A.question_class(raw)
    return B.table(spark, d, "part").select("p_partkey", c["category"].alias("category"), c["role"].alias("role"),
                                            F.array_join(c["skills_known"], "|").alias("known"))


@query("ranked_id_answers", """select vec_id, vec_id || ',' || (vec_id + 3) as ids from embeddings""")
def ranked_id_answers(spark, d):
    v = F.col("vec_id")
    raw = F.concat(F.lit("```json\n["), v.cast("string"), F.lit(", "), (v + 3).cast("string"), F.lit("]\n```"))
    return B.table(spark, d, "embeddings").select(
        "vec_id", F.array_join(A.id_list(raw).cast("array<string>"), ",").alias("ids"))
