"""The given tables read as job-market tables.

``postings`` are documents with the fields of the part, supplier, place and order of the same number; ``raw_postings``
is the same as it would arrive from feeds. Both cover every document.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-01 00:00:00"  # the newest order date; reports never read the clock


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow tables are joined first, so that the texts are dealt out once, by their id."""
    d = table(spark, sf_dir, "documents").withColumn("third_word", F.split_part("text", F.lit(" "), F.lit(3)))
    p, s, n, r, o = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region", "orders"))
    suppliers = s.select(F.count("*").alias("n")).scalar()
    facts = (
        o.join(p.hint("shuffle_hash"), o.o_orderkey == p.p_partkey)  # orders, the longest, need no sort
        .join(s, s.s_suppkey == F.pmod(p.p_partkey, suppliers))
        .join(n, n.n_nationkey == s.s_nationkey)
        .join(r, r.r_regionkey == n.n_regionkey)
    )
    return d.join(facts, d.doc_id == facts.p_partkey)


def _unless(every: int, col):
    """Missing on every n-th document."""
    return F.when(F.col("doc_id") % every != 0, col)


def _link():
    """Documents 1, 11, 21 ... repost the link of the one before."""
    first = F.when(F.col("doc_id") % 10 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return F.concat(F.lit("https://jobs.example/view/"), first.cast("string"))


_SOURCE = ["linkedin", "greenhouse", "indeed", "lever"]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    base = _base(spark, sf_dir)
    return base.join(e, e.vec_id == base.doc_id, "left").select(
        F.col("doc_id").alias("id"),
        _unless(23, F.col("s_name")).alias("company_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        _unless(29, F.col("text")).alias("description"),
        _link().alias("link"),
        _unless(11, F.concat_ws(", ", "n_name", "r_name")).alias("location"),
        _unless(13, F.col("o_orderdate")).alias("posted_date"),
        F.get(F.array(*[F.lit(s) for s in _SOURCE]), (F.col("doc_id") % 4).cast("int")).alias("source"),
        _unless(5, F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("skills"),
        _unless(3, F.col("p_size") % 21).alias("experience_years"),
        "embedding",
    )


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat("third_word", F.lit(" Holdings"))
    return _base(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        _unless(23, F.when(F.col("lang") == "en", named).otherwise(F.col("s_name"))).alias("company_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        _unless(29, F.col("text")).alias("description"),
        _link().alias("link"),
        _unless(11, F.concat_ws(", ", "n_name", "r_name")).alias("location"),
        F.array("n_name", "r_name").alias("locations"),
        _unless(13, F.col("o_orderdate")).alias("posted_date"),
        F.get(F.array(*[F.lit(s) for s in _SOURCE]), (F.col("doc_id") % 4).cast("int")).alias("source"),
        F.floor(F.col("s_acctbal") * 4).cast("long").alias("followers"),
        F.floor(F.col("s_acctbal") / 8).cast("long").alias("employees"),
        F.col("p_type").alias("keyword"),
    )


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links stored before the batch: those of finished orders."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.concat(F.lit("https://jobs.example/view/"), F.col("o_orderkey").cast("string")).alias("link"),
                    F.lit("linkedin").alias("source"))


# ------------------------------------------------------------------ the same tables for the SQL checks
_FROM = """
from documents d
join part p on p.p_partkey = d.doc_id
join supplier s on s.s_suppkey = d.doc_id % (select count(*) from supplier)
join nation n on n.n_nationkey = s.s_nationkey
join region r on r.r_regionkey = n.n_regionkey
join orders o on o.o_orderkey = d.doc_id
"""
_COMMON = """
       p.p_name || ' ' || p.p_type as title,
       case when d.doc_id % 29 = 0 then null else d.text end as description,
       'https://jobs.example/view/' || cast(d.doc_id - case when d.doc_id % 10 = 1 then 1 else 0 end as varchar) as link,
       case when d.doc_id % 11 = 0 then null else n.n_name || ', ' || r.r_name end as location,
       case when d.doc_id % 13 = 0 then null else o.o_orderdate end as posted_date,
       case d.doc_id % 4 when 0 then 'linkedin' when 1 then 'greenhouse' when 2 then 'indeed' else 'lever' end as source,
"""
POSTINGS_SQL = f"""postings as (
select d.doc_id as id, case when d.doc_id % 23 = 0 then null else s.s_name end as company_name, {_COMMON}
       case when d.doc_id % 5 = 0 then null else string_split(p.p_name || ' ' || p.p_brand, ' ') end as skills,
       case when d.doc_id % 3 = 0 then null else p.p_size % 21 end as experience_years,
       e.embedding {_FROM} left join embeddings e on e.vec_id = d.doc_id)"""
RAW_SQL = f"""raw as (
select d.doc_id as id,
       case when d.doc_id % 23 = 0 then null when d.lang = 'en' then split_part(d.text, ' ', 3) || ' Holdings'
            else s.s_name end as company_name, {_COMMON}
       [n.n_name, r.r_name] as locations,
       cast(floor(s.s_acctbal * 4) as bigint) as followers, cast(floor(s.s_acctbal / 8) as bigint) as employees,
       p.p_type as keyword {_FROM})"""
STORED_SQL = """stored as (
select 'https://jobs.example/view/' || cast(o_orderkey as varchar) as link, 'linkedin' as source
from orders where o_orderstatus = 'F')"""
