"""Enrichment passes over the whole backlog, and the streams with their batch twins."""
from pyspark.sql import functions as F

from jobspan import bindings as B
from jobspan.checks import admission as CA
from jobspan.checks import text as CT
from jobspan.checks.registry import query
from jobspan.functions.text import split_lines
from jobspan.operators import insights as I
from jobspan.operators.keys import apply_updates
from jobspan.plans import enrich as E
from jobspan.session import scratch_folder, written
from jobspan.sources import readers
from jobspan.sources.keyed import KeyedTable, hashed
from jobspan.streaming import jobs as S

P = "with " + B.POSTINGS_SQL
NOW = B.NOW
OPTIONS = dict(titles=["ring", "bolt", "gear", "widget"], registry=CT.REGISTRY, **CT._GUARD)
_TOPIC = "(contains(lower(title), 'ring') or contains(lower(title), 'bolt') or contains(lower(title), 'gear') or contains(lower(title), 'widget'))"


def _stored_texts(spark, d):
    """Postings whose description is an address on every document of even length, with the texts as a table."""
    p = B.postings(spark, d).withColumn("skills", F.lit(None).cast("array<string>"))
    uri = F.concat(F.lit("gs://texts/"), F.col("id").cast("string"), F.lit(".txt"))
    moved = (F.length("description") % 2 == 0)
    texts = p.where(moved & (F.col("source") != "lever")).select(uri.alias("uri"), F.col("description").alias("text"))
    return p.withColumn("description", F.when(moved, uri).otherwise(F.col("description"))), texts


_RESOLVED = f"""{P}, texts as (select *, case when length(description) % 2 = 0 and source = 'lever' then null else description
 end as text from postings)"""


@query("resolved_descriptions", f"{_RESOLVED} select id, text from texts")
def resolved_descriptions(spark, d):
    rows, texts = _stored_texts(spark, d)
    return readers.resolve_descriptions(rows, texts).select("id", "text")


def _responses(spark, d):
    """Answers for the postings: the part's words as skills and, on some, years; none or no JSON on others."""
    p = B.table(spark, d, "part")
    doc = F.struct(F.split("p_name", " ").alias("required_skills"), F.when(F.col("p_size") > 30, F.col("p_size")).alias("experience_years"))
    raw = F.when(F.col("p_size") > 10, F.to_json(doc)).when(F.col("p_size") > 5, "none")
    return p.where("p_size > 3").select(F.col("p_partkey").alias("id"), raw.alias("raw"))


def _enriched(spark, d):
    rows, texts = _stored_texts(spark, d)
    backlog = E.backlog(rows, "skills", texts, html=False)
    return E.enrich(backlog, _responses(spark, d), NOW, **OPTIONS)


_SCAN_TEXT = CT._scan_sql("text")
_ENRICHED = f"""{_RESOLVED}, joined as (select t.id, t.company_name, t.title, t.text, {_TOPIC} as on_topic, p_size, p_name from texts t
 left join part on p_partkey = t.id where t.description is not null),
 toks as (select *, {CT._TOKENS.format('text')} as toks, lower(text) as low from joined),
 scan as (select *, {_SCAN_TEXT} as raw_scan from toks), one as (select *, list_filter(raw_scan, lambda x, i:
 list_position(raw_scan, x) = i) as scan from scan),
 kept as (select *, {CT._guard_sql("list_concat(string_split(p_name, ' '), scan)", "low", "coalesce(company_name, '')")} as k from one),
 final as (select *, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) as found,
 text is not null and p_size > 10 as good from kept),
 enriched as (select id, case when not on_topic then [] when good then found end as skills,
 case when on_topic and good and p_size > 30 then p_size end as experience_years from final),
 outcomes as (select *, case when skills is not null then timestamp '{NOW}' end as enriched_at,
 case when skills is null then 'error' when len(skills) > 0 then 'ok' else 'empty' end as outcome from enriched)"""


@query("enrich", f"{_ENRICHED} select id, array_to_string(skills, '|') as skills, experience_years, enriched_at, outcome from outcomes")
def enrich(spark, d):
    return _enriched(spark, d).withColumn("skills", F.array_join("skills", "|"))


@query("enrich_outcomes", f"{_ENRICHED} select outcome, count(*) as cnt from outcomes group by 1")
def enrich_outcomes(spark, d):
    return I.outcome_counts(_enriched(spark, d))


@query("enriched_postings", f"""{_ENRICHED} select p.id, array_to_string(o.skills, '|') as skills, o.experience_years, o.enriched_at
 from postings p left join outcomes o on o.id = p.id""")
def enriched_postings(spark, d):
    base = B.postings(spark, d).select("id", F.lit(None).cast("array<string>").alias("skills"),
                                       F.lit(None).cast("int").alias("experience_years"),
                                       F.lit(None).cast("timestamp").alias("enriched_at"))
    out = apply_updates(base, _enriched(spark, d), "id", ["skills", "experience_years", "enriched_at"])
    return out.withColumn("skills", F.array_join("skills", "|"))


@query("skill_request_backlog", f"""{_RESOLVED} select id, {CT._HEAD} || text as request from texts
 where description is not null and text is not null and {_TOPIC}""")
def skill_request_backlog(spark, d):
    rows, texts = _stored_texts(spark, d)
    return E.skill_requests(E.backlog(rows, "skills", texts, html=False), OPTIONS["titles"])


@query("embed_inputs", f"""{CT._SECTIONS}, {B.POSTINGS_SQL} select id, title || chr(10) || chr(10) || section as embed_text
 from postings join sections on doc_id = id where description is not null and embedding is null""")
def embed_inputs(spark, d):
    return E.embed_inputs(B.postings(spark, d), sections=CT.SHAPE)


_NUM = dict(pattern=r"([0-9]{1,2})[a-z ]*\.", sub_pattern=r"and ([0-9]{1,2})")


@query("backfill_years", f"""{_RESOLVED}, todo as (select id, text from texts where description is not null and experience_years is null),
 ruled as (select id, text, list_filter(list_transform(regexp_extract_all(lower(text), '{_NUM["pattern"]}', 1), lambda x: cast(x as int)),
 lambda x: x between 1 and 20) as every, list_filter(list_transform(regexp_extract_all(lower(text), '{_NUM["sub_pattern"]}', 1),
 lambda x: cast(x as int)), lambda x: x between 1 and 20) as sub from todo),
 found as (select id, text, coalesce(list_filter(every, lambda x: not list_contains(sub, x))[1], every[1]) as rule,
 case when p_size > 30 and p_size <= 40 then p_size end as answer from ruled left join part on p_partkey = id)
 select id, case when text is not null then coalesce(rule, answer) end as experience_years, case when text is null then 'skip'
 when rule is not null then 'regex' when answer is not null then 'llm' else 'null' end as outcome from found""")
def backfill_years(spark, d):
    rows, texts = _stored_texts(spark, d)
    backlog = E.backlog(rows, "experience_years", texts, html=False)
    return E.backfill_years(backlog, _responses(spark, d), **_NUM)


# ------------------------------------------------------------------ streams; each has the SQL of its batch twin
def _event_stream(spark, d):
    schema = B.table(spark, d, "events").schema
    return S.file_stream(spark, d, schema, 1, "events*.parquet")


_WINDOWS = "select date_trunc('day', ts) as window_start, event_type, user_id, count(*) as cnt from events group by all"


@query("status_windows", _WINDOWS)
def status_windows(spark, d):
    return S.status_windows(B.table(spark, d, "events"), ["event_type", "user_id"])


@query("status_windows_stream", _WINDOWS)
def status_windows_stream(spark, d):
    out = scratch_folder(spark, "windows")
    return S.status_windows_stream(_event_stream(spark, d), ["event_type", "user_id"], out, out + "-checkpoint", delay="40 days")


@query("fresh_events", """select event_id, user_id from events where ts >= timestamp '2024-01-31' - interval 240 hour""")
def fresh_events(spark, d):
    now = F.lit("2024-01-31").cast("timestamp")
    return S.fresh_only(B.table(spark, d, "events"), now, 240, "ts").select("event_id", "user_id")


_SAVED = """with e as (select *, cast(json_extract(props, '$.k') as bigint) % 10 as job_id, case when event_type in ('click', 'view')
 then 'toggle' when event_type = 'error' then 'remove' end as action from events), cleared as (
 select user_id, job_id, max((ts, event_id)) as c from e where action = 'remove' group by all)
 select e.user_id, e.job_id, max(ts) as saved_at from e left join cleared c on c.user_id = e.user_id and c.job_id = e.job_id
 where action = 'toggle' and (c.c is null or (ts, event_id) > c.c) group by all having count(*) % 2 = 1"""


def _saved_events(df):
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "view"), "toggle").when(kind == "error", "remove")
    job = F.get_json_object("props", "$.k").cast("bigint") % 10
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", job.alias("job_id"), action.alias("action")
                     ).where("action is not null")


@query("saved_set", _SAVED)
def saved_set(spark, d):
    return S.saved_set(_saved_events(B.table(spark, d, "events")), ["user_id", "job_id"])


@query("saved_set_stream", _SAVED)
def saved_set_stream(spark, d):
    out = scratch_folder(spark, "saved")
    return S.saved_set_from_stream(_saved_events(_event_stream(spark, d)), ["user_id", "job_id"], out, out + "-checkpoint")


@query("unique_links_stream", "select user_id as link, event_type from events group by all")
def unique_links_stream(spark, d):
    out = scratch_folder(spark, "unique")
    rows = _event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("link"), "event_type",
                                          F.concat_ws("-", "user_id", "event_type").alias("key"))
    S.update_stream(S.unique_links(rows, link="key", delay="40 days"), lambda b: b, out, out + "-checkpoint")
    return spark.read.parquet(out).select("link", "event_type")


@query("ingest_stream", f"{CA.JUDGED_SQL} select source, {CA._COUNTS} from judged group by source")
def ingest_stream(spark, d):
    """The raw postings land as one table in the shared folder and are read back as a stream, batch by batch, against a table that
    holds links already."""
    out = scratch_folder(spark, "ingest")
    raw = B.raw_postings(spark, d)
    raw.write.parquet(out + "/landed")
    B.stored_links(spark, d).write.parquet(out + "/table")
    stream = S.file_stream(spark, out + "/landed", raw.schema)
    S.ingest_stream(stream, out + "/table", out + "/counts", out + "/checkpoint", NOW, CA.RULES)
    counts = spark.read.parquet(out + "/counts")
    return counts.groupBy("source").agg(*[F.sum(c).alias(c) for c in counts.columns if c not in ("source", "run", "batch")])


@query("first_links_stream", """select event_type as link, event_id, user_id from events
 qualify row_number() over (partition by event_type order by ts, event_id) = 1""")
def first_links_stream(spark, d):
    out = scratch_folder(spark, "firsts")
    rows = _event_stream(spark, d).select(F.col("event_type").alias("link"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.first_links(rows, out, out + "-checkpoint", ["ts", "event_id"]).select("link", "event_id", "user_id")


@query("enrich_stream", f"{_ENRICHED} select outcome, count(*) as cnt from outcomes group by 1")
def enrich_stream(spark, d):
    """The backlog lands as one table and is enriched batch by batch, each with the parts of the text store that it points to; twin of
    ``enrich_outcomes``."""
    out = scratch_folder(spark, "enrich")
    rows, texts = _stored_texts(spark, d)
    rows.write.parquet(out + "/landed")
    store = KeyedTable(spark, out + "/texts", "uri", hashed(64)).write(texts)

    def work(batch):
        texts = store.at(batch.where(F.col("description").startswith("gs://")).select(F.col("description").alias("uri")))
        ids = written(batch.select("id"), "batch-ids")
        answers = _responses(batch.sparkSession, d).where(F.col("id").isin(ids))  # the batch's own: the others would move with every batch
        return E.enrich(E.backlog(batch, "skills", texts, html=False), answers, NOW, **OPTIONS)

    S.update_stream(S.file_stream(spark, out + "/landed", rows.schema, 4), work, out + "/updates", out + "/checkpoint")
    return I.outcome_counts(spark.read.parquet(out + "/updates"))


@query("document_lines", """select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from (select doc_id,
 unnest(regexp_split_to_array(text, chr(10))) as line from documents) group by 1""")
def document_lines(spark, d):
    lines = split_lines(F.col("text"))
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return B.table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), total.alias("n_chars"))
