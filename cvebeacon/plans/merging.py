"""Queries: unification, merging, incremental updates, file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cvebeacon.operators import unify as U
from cvebeacon.operators.upsert import append_posts, pending, update_cleaned
from cvebeacon.plans import views as V
from cvebeacon.plans.cleaning import restated
from cvebeacon.plans.registry import query
from cvebeacon.schemas import OBSERVATION_COLUMNS
from cvebeacon.session import shared_folder, state_session
from cvebeacon.sources import files as S
from cvebeacon.sources.checked import QUARANTINE
from cvebeacon.streaming.ingest import ingest, posts_with_cve, read_store

# ---- raw sources over the given tables --------------------------------------

_MASTODON_CVE = V.cve_of("conv_id % 500") + " || ', cve-2022-00' || cast(10 + turn as varchar(20)) || ' x'"
_MASTODON_TIME = "'2024-02-' || lpad(cast(conv_id % 28 + 1 as varchar(20)), 2, '0') || ' 07:05:00'"
_TELEGRAM_CVE = "case when user_id % 6 = 0 then 'none' else " + V.cve_of("user_id % 500") + " end"
_EXPLOITDB_CVE = V.cve_of("o_custkey % 500") + " || ';' || " + V.cve_of("o_custkey % 300", 2023)
_BLEEPING_CVE = V.cve_of("s_suppkey % 500", 2020)


def reddit_raw(spark, sf_dir):
    cleaned = V.posts(spark, sf_dir).select(
        "permalink", "title", F.col("text").alias("clean_text"), "timestamp",
        F.array(F.expr(V.cve_of("doc_id % 500")), F.expr("lower(" + V.cve_of("doc_id % 7") + ")")).alias("cves"),
        F.create_map(F.lit("x"), F.lit(1)).alias("cve_counts"),
        F.array(F.lit("c")).alias("clean_comments"),
    )
    return cleaned


def mastodon_raw(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select(
        F.expr(_MASTODON_CVE).alias("cve"), F.expr(_MASTODON_TIME).alias("created_at"),
        F.col("text").alias("body"),
    )


def telegram_raw(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        F.expr(_TELEGRAM_CVE).alias("CVE ID"), F.expr(_TELEGRAM_CVE).alias("CVE ID.1"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"),
        F.col("event_type").alias("Message"),
    )


def exploitdb_raw(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(
        F.expr(_EXPLOITDB_CVE).alias("cves"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("text"),
    )


def bleeping_raw(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").select(
        F.expr(_BLEEPING_CVE).alias("cves"), F.lit("2024-03-01").alias("date"),
        F.col("s_name").alias("text"),
    )


def raw_sources(spark, sf_dir):
    return [
        U.Source("mastodon_22_05", mastodon_raw(spark, sf_dir)),
        U.Source("telegram_21_05_cleaned", telegram_raw(spark, sf_dir)),
        U.Source("cleaned_reddit_posts", reddit_raw(spark, sf_dir), "json"),
        U.Source("exploitdb_22_05_cve_cleaned", exploitdb_raw(spark, sf_dir), clean=False),
        U.Source("bleepingcomputer_22_05_cve_cleaned", bleeping_raw(spark, sf_dir), clean=False),
    ]


_IDS = "regexp_extract_all(upper({}), 'CVE-\\d{{4}}-\\d{{4,7}}')"

_RAW_SQL = f"""raw as (
  select 'mastodon_22_05' as source, {_MASTODON_CVE} as cell, strftime(cast({_MASTODON_TIME} as timestamp), '%Y-%m-%d') as date,
    strftime(cast({_MASTODON_TIME} as timestamp), '%H:%M') as time, text, true as cleaned,
    cast(null as varchar) as extra from conversations
  union all select 'telegram_21_05_cleaned', {_TELEGRAM_CVE}, strftime(ts, '%Y-%m-%d'), strftime(ts, '%H:%M'), event_type, true, null from events
  union all select 'cleaned_reddit_posts', {V.cve_of("doc_id % 500")} || ',' || lower({V.cve_of("doc_id % 7")}),
    strftime(cast(timestamp as timestamp), '%Y-%m-%d'), strftime(cast(timestamp as timestamp), '%H:%M'), text, true, permalink || title from posts
  union all select 'exploitdb_22_05_cve_cleaned', {_EXPLOITDB_CVE}, strftime(o_orderdate, '%Y-%m-%d'), null, o_orderpriority, false, null from orders
  union all select 'bleepingcomputer_22_05_cve_cleaned', {_BLEEPING_CVE}, '2024-03-01', null, s_name, false, null from supplier),
normal as (select distinct source, unnest({_IDS.format('cell')}) as cve, date, time, text, cleaned, extra from raw),
unified as (select cve, source, date, time, case when cleaned then {restated('text', 'unified')} else text end as text from normal)"""


def _unified_sql(select: str) -> str:
    return "with " + V.SQL_VIEWS["posts"] + ",\n" + _RAW_SQL + "\n" + select


@query("unify_sources", _unified_sql("select * from unified"))
def unify_sources(spark, sf_dir):
    ready = U.unify_sources(raw_sources(spark, sf_dir))
    return U.merge(list(ready.values())).select(*OBSERVATION_COLUMNS)


@query(
    "source_stats",
    _unified_sql(
        """select r.source as path, r.n as initial, k.n as after_normalize,
  case when r.cleaned then k.n end as after_clean
from (select source, cleaned, count(*) as n from raw group by all) r
join (select source, count(*) as n from normal group by all) k using (source)
union all select 'TOTAL', null, null, count(*) from unified"""
    ),
)
def source_stats(spark, sf_dir):
    return U.source_stats(raw_sources(spark, sf_dir))


_LOADED_SQL = f"""loaded as (
  select trim({_MASTODON_CVE}) as cve, strftime(cast({_MASTODON_TIME} as timestamp), '%Y-%m-%d') as timestamp, 'mastodon' as source, text from conversations
  union all select {_TELEGRAM_CVE}, strftime(ts, '%Y-%m-%d'), 'telegram', event_type from events
  union all select unnest([{V.cve_of("doc_id % 500")}, lower({V.cve_of("doc_id % 7")})]), strftime(cast(timestamp as timestamp), '%Y-%m-%d'), 'reddit', text from posts
  union all select {_EXPLOITDB_CVE}, strftime(o_orderdate, '%Y-%m-%d'), 'exploitdb', o_orderpriority from orders
  union all select {_BLEEPING_CVE}, '2024-03-01', 'bleepingcomputer', s_name from supplier)"""


def loaded_sources(spark, sf_dir):
    return {
        "mastodon": U.load_source(mastodon_raw(spark, sf_dir), "mastodon"),
        "telegram": U.load_source(telegram_raw(spark, sf_dir), "telegram"),
        "reddit": U.load_source(reddit_raw(spark, sf_dir), "reddit"),
        "exploitdb": U.load_source(exploitdb_raw(spark, sf_dir), "exploitdb"),
        "bleepingcomputer": U.load_source(bleeping_raw(spark, sf_dir), "bleepingcomputer"),
    }


@query("load_sources", "with " + V.SQL_VIEWS["posts"] + ", " + _LOADED_SQL + " select * from loaded")
def load_sources(spark, sf_dir):
    return U.merge(list(loaded_sources(spark, sf_dir).values()))


@query(
    "merge_dedup",
    "with " + V.SQL_VIEWS["posts"] + ", " + _LOADED_SQL + " select distinct * from loaded",
)
def merge_dedup(spark, sf_dir):
    loaded = loaded_sources(spark, sf_dir)
    stored = U.merge([loaded["telegram"], loaded["exploitdb"]])
    return U.merge_into(stored, list(loaded.values()))


# ---- incremental updates ----------------------------------------------------


@query(
    "upsert_new_posts",
    """select permalink, text from (
  select '/r/' || source || '/' || cast(doc_id as varchar(20)) as permalink,
         case when doc_id % 2 = 0 then 'stored' else 'new' end as text from documents)""",
)
def upsert_new_posts(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumn("permalink", F.expr(V.POST_PERMALINK))
    stored = docs.filter("doc_id % 2 = 0").select("permalink", F.lit("stored").alias("text"))
    new = docs.select("permalink", F.lit("new").alias("text"))
    return append_posts(stored, new)


@query(
    "update_cleaned_posts",
    V.with_views(
        "posts",
        f"""select permalink, case when doc_id % 2 = 0 then 'stored' else
  trim(concat_ws(' ', nullif(trim(title), ''), nullif({restated('text', 'reddit')}, ''),
  nullif({restated('article_text', 'reddit')}, '')), ' ') end as clean_text from posts""",
    ),
)
def update_cleaned_posts(spark, sf_dir):
    raw = V.posts(spark, sf_dir).drop("doc_id")
    keyed = V.posts(spark, sf_dir)
    stored = keyed.filter("doc_id % 2 = 0").select(
        "permalink", "title", "timestamp", F.lit("stored").alias("clean_text"),
        F.array().cast("array<string>").alias("clean_comments"),
    )
    nameless = stored.withColumn("permalink", F.lit(None).cast("string"))
    again = raw.withColumn("title", F.concat("title", F.lit(" zz")))
    updated = update_cleaned(stored.unionByName(nameless), raw.unionByName(again), ["title"])
    return updated.select("permalink", "clean_text")


@query(
    "resume_pending",
    V.with_views("obs", "select o_orderkey, cve, date from obs where o_orderkey % 3 <> 1"),
)
def resume_pending(spark, sf_dir):
    wanted = V.observations(spark, sf_dir).select("o_orderkey", "cve", "date")
    done = wanted.filter("o_orderkey % 3 = 1")
    return pending(wanted, done, ["o_orderkey"])


_EVENT_POST = "event_type || case when event_id % 4 <> 0 then ' cve-2024-10' || cast(10 + event_id % 80 as varchar(20)) else '' end"


@query(
    "stream_upsert",
    f"select event_id, {_EVENT_POST} as text from events where event_id % 4 <> 0",
)
def stream_upsert(spark, sf_dir):
    """The whole events table arrives as a file stream, twice, into one store."""
    store, schema = shared_folder(spark, "store"), "event_id BIGINT, text STRING"
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    streams = state_session(spark)
    for _ in range(2):
        arriving = (
            streams.readStream.schema(source)
            .parquet(f"{sf_dir}/events*.parquet")
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.expr(_EVENT_POST).alias("text"), F.lit("").alias("title"))
        )
        found = posts_with_cve(arriving).select("event_id", "ts", "text")
        job = ingest(
            found, store, schema, shared_folder(spark, "progress"), key="event_id", time="ts",
            lateness="1 hour", order=["text"],
        )
        job.awaitTermination()
    return read_store(spark, store, schema).select("event_id", "text")


# ---- file formats -----------------------------------------------------------


@query(
    "csv_round_trip",
    "select doc_id, regexp_replace(text, '\\s', ' ', 'g') || '\"q\", end' as body, 'part' as stem, n_chars from documents",
)
def csv_round_trip(spark, sf_dir):
    """Texts with quotes, commas and line breaks through a CSV file."""
    folder = shared_folder(spark, "csv")
    docs = V.table(spark, sf_dir, "documents")
    S.write_csv(docs.select("doc_id", F.concat("text", F.lit('"q", end')).alias("body"), "n_chars"), folder)
    back = S.with_file_stem(S.read_csv(spark, folder, "doc_id BIGINT, body STRING, n_chars BIGINT"))
    return back.select(
        "doc_id", F.regexp_replace("body", r"\s", " ").alias("body"),
        F.regexp_extract("source", "^[a-z]+", 0).alias("stem"), "n_chars",
    )


@query(
    "json_round_trip",
    V.with_views(
        "posts",
        """select permalink, title, p.text, article_text, 'unknown' as source,
  'CVE-2024-' || lpad(cast(doc_id % 500 as varchar(20)), 4, '0') as first_cve,
  'first **note** on ' || d.source as first_comment, 2::bigint as n_comments
from posts p join documents d using (doc_id)""",
    ),
)
def json_round_trip(spark, sf_dir):
    folder = shared_folder(spark, "json")
    written = V.posts(spark, sf_dir).select(
        "permalink", "title", "text", "article_text", F.array(F.expr(V.cve_of("doc_id % 500"))).alias("cves"), "comments"
    )
    S.write_json(written, folder)
    schema = (
        "permalink STRING, title STRING, text STRING, article_text STRING, cves ARRAY<STRING>, "
        "comments ARRAY<STRUCT<score:INT,text:STRING,level:INT>>"
    )
    back = S.read_json_folder(spark, folder, schema, lines=True)
    return back.select(
        "permalink", "title", "text", "article_text", "source", F.col("cves")[0].alias("first_cve"),
        F.col("comments")[0]["text"].alias("first_comment"), F.size("comments").cast("long").alias("n_comments"),
    )


_BAD_SQL = """stored as (select doc_id, lang, n_chars, doc_id // 100 as part, doc_id % 17 = 3 as mistyped,
  doc_id // 100 % 7 = 3 as cut from documents)"""


@query(
    "store_with_bad_records",
    f"""with {_BAD_SQL} select 'kept' as state, doc_id, lang, n_chars from stored where not mistyped and not cut
union all select 'record', doc_id, null, null from stored where mistyped and not cut
union all select 'file', part, null, null from stored where cut group by part""",
)
def store_with_bad_records(spark, sf_dir):
    """Files of JSON arrays, some objects mistyped, some files cut off; what is kept and what is not.

    The files are made of the documents, a hundred to a file, so they grow in number only.
    """
    folder, quarantine = shared_folder(spark, "stores"), shared_folder(spark, "quarantine")
    count = F.col("n_chars").cast("string")
    value = F.when(F.col("doc_id") % 17 == 3, F.lit('"many"')).otherwise(count)
    record = F.concat(
        F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang", F.lit('",\n "n_chars": '),
        value, F.lit("}"),
    )
    files = (
        V.table(spark, sf_dir, "documents")
        .groupBy(F.expr("doc_id div 100").alias("part"))
        .agg(F.array_join(F.collect_list(record), ",\n").alias("body"))
        .select("part", F.concat(F.lit("["), "body", F.when(F.col("part") % 7 == 3, "").otherwise("]")).alias("value"))
    )
    files.write.partitionBy("part").text(folder)
    read = S.read_json_checked(spark, f"{folder}/*/*.txt", "doc_id BIGINT, lang STRING, n_chars BIGINT", quarantine)
    bad = spark.read.schema(QUARANTINE).parquet(quarantine)
    number = F.when(F.col("reason") == "record", F.get_json_object("record", "$.doc_id")).otherwise(
        F.regexp_extract("file", r"part=(\d+)", 1)
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("n_chars", "long"))]
    kept = read.rows.select(F.lit("kept").alias("state"), "doc_id", "lang", "n_chars")
    return kept.unionByName(bad.select(F.col("reason").alias("state"), number.cast("long").alias("doc_id"), *nothing))


@query(
    "source_names",
    V.with_views(
        "obs",
        "select o_orderkey, source as stem, case when source like 'reddit%' then 'reddit' "
        "when source like 'telegram%' then 'telegram' when source like 'mastodon%' then 'mastodon' "
        "else 'unknown' end as source from obs",
    ),
)
def source_names(spark, sf_dir):
    path = F.concat(F.lit("/data/Reddit/"), "source", F.lit(".json"))
    return V.observations(spark, sf_dir).select(
        "o_orderkey", S.source_from_stem(path).alias("stem"), S.source_from_name(path).alias("source")
    )
