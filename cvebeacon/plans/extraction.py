"""Queries: vulnerability ids in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cvebeacon.functions import cve as C
from cvebeacon.functions.text import uppercase_cves
from cvebeacon.functions.time import epoch_to_iso, iso_date, split_timestamp
from cvebeacon.operators.features import feature_rows
from cvebeacon.operators.unify import outbound_urls
from cvebeacon.plans import views as V
from cvebeacon.plans.registry import query

_ALL_FOUND = """all_found as (
  select doc_id, unnest(regexp_extract_all(upper(t), 'CVE-\\d{4}-\\d{4,7}')) as cve
  from (select doc_id, title || '|' || text || '|' || coalesce(article_text, '') as t from posts))"""


@query(
    "cve_explode",
    V.with_views("posts found", "select distinct doc_id, cve from found"),
)
def cve_explode(spark, sf_dir):
    return C.explode_cves(V.post_texts(spark, sf_dir), "text").select("doc_id", "cve")


@query(
    "cve_counts",
    V.with_views(
        "posts",
        f"select doc_id, cve, count(*) as mentions from (with {_ALL_FOUND} select * from all_found) "
        "group by all",
    ),
)
def cve_counts(spark, sf_dir):
    return C.count_mentions(
        V.posts(spark, sf_dir), ["doc_id"], ["title", "text", "article_text"]
    )


@query(
    "cve_recount",
    V.with_views(
        "posts",
        f"""select doc_id, string_agg(cve, ',' order by cve) as cves,
  string_agg(cve || '=' || n, ',' order by cve) as counts, max(distinct_n) as n_cves
from (select *, count(*) over (partition by doc_id) as distinct_n from
  (select doc_id, cve, count(*) as n from (with {_ALL_FOUND} select * from all_found) group by all))
group by doc_id""",
    ),
)
def cve_recount(spark, sf_dir):
    counted = C.recount(V.posts(spark, sf_dir))
    pairs = F.transform(
        F.array_sort(F.map_entries("cve_counts")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return counted.select(
        "doc_id",
        F.array_join("cves", ",").alias("cves"),
        F.array_join(pairs, ",").alias("counts"),
        F.size("cves").cast("long").alias("n_cves"),
    )


@query(
    "cve_upper",
    V.with_views(
        "posts",
        "select doc_id, regexp_replace(text, '(?i)\\bcve-(\\d{4}-\\d{4,})\\b', 'CVE-\\1', 'g') as text, "
        "regexp_replace(text, '(?i)\\bcve-(\\d{4}-\\d{4,7})\\b', 'CVE-\\1', 'g') as text_short "
        "from posts",
    ),
)
def cve_upper(spark, sf_dir):
    return V.post_texts(spark, sf_dir).select(
        "doc_id",
        uppercase_cves()(F.col("text")).alias("text"),
        uppercase_cves(max_digits=7)(F.col("text")).alias("text_short"),
    )


@query(
    "cve_posts_only",
    "select source, count(*) as posts from documents "
    "where regexp_matches(case when doc_id % 2 = 0 then text || ' cVe-2020-77777' else text end, "
    "'(?i)cve-\\d{4}-\\d{4,7}') group by source",
)
def cve_posts_only(spark, sf_dir):
    text = F.expr("case when doc_id % 2 = 0 then text || ' cVe-2020-77777' else text end")
    return (
        V.table(spark, sf_dir, "documents")
        .filter(C.has_cve(text))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("posts"))
    )


@query(
    "cve_column_characters",
    V.with_views(
        "obs",
        "select o_orderkey, regexp_replace('[' || cve || '; ' || text || ']', '[^CVE0-9\\-]', '', 'g') "
        "as cve from obs",
    ),
)
def cve_column_characters(spark, sf_dir):
    cell = F.concat(F.lit("["), "cve", F.lit("; "), "text", F.lit("]"))
    return V.observations(spark, sf_dir).select(
        "o_orderkey", C.keep_cve_characters(cell).alias("cve")
    )


@query(
    "feature_rows_inner",
    V.with_views(
        "posts epss",
        f"""select f.doc_id, f.cve, f.source, f.entry_date, f.entry_date as timestamp,
  f.cve_count, round(e.epss, 6) as epss_score
from (select a.doc_id, a.cve, source, cast('1998-01-01' as date) + cast(a.doc_id % 365 as integer) as dd,
        strftime(cast('1998-01-01' as date) + cast(a.doc_id % 365 as integer), '%Y-%m-%d') as entry_date,
        a.n as cve_count
      from (select doc_id, cve, count(*) as n from (with {_ALL_FOUND} select * from all_found) group by all) a
      join documents using (doc_id)) f
join epss e on e.cve = f.cve and e.d = f.dd""",
    ),
)
def feature_rows_inner(spark, sf_dir):
    day = "date_add(date'1998-01-01', cast(doc_id % 365 as int))"
    entries = C.recount(V.posts(spark, sf_dir)).select(
        "doc_id",
        "cves",
        "cve_counts",
        F.split("permalink", "/")[2].alias("source"),
        F.concat(F.expr(day).cast("string"), F.lit("T08:00:00")).alias("timestamp"),
    )
    rows = feature_rows(entries, V.epss_history(spark, sf_dir))
    return rows.withColumn("epss_score", F.round("epss_score", 6)).withColumn(
        "cve_count", F.col("cve_count").cast("long")
    )


@query(
    "timestamps_normalized",
    """select event_id, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H:%M') as time,
  strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d') as epoch_date,
  strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') as iso,
  case when event_id % 10 <> 0 then strftime(ts, '%Y-%m-%d') end as text_date,
  case when event_id % 10 <> 0 then strftime(ts, '%H:%M') end as text_time
from events""",
)
def timestamps_normalized(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").select("event_id", "ts")
    seconds = F.expr("cast(unix_timestamp(ts) as bigint)")
    text = F.when(
        F.col("event_id") % 10 == 0, F.lit("yesterday, about noon")
    ).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    base = events.select("event_id", F.col("ts").alias("Created_At"), seconds.alias("s"), text.alias("t"))
    native = split_timestamp(base)
    by_number = split_timestamp(native.withColumnsRenamed({"date": "d0", "time": "t0", "s": "created_utc"})
                                .withColumn("iso", epoch_to_iso(F.col("created_utc"))))
    by_text = split_timestamp(
        by_number.withColumnsRenamed({"date": "epoch_date", "time": "epoch_time", "t": "timestamp"})
    )
    return by_text.select(
        "event_id", F.col("d0").alias("date"), F.col("t0").alias("time"), "epoch_date", "iso",
        F.col("date").alias("text_date"), F.col("time").alias("text_time"),
    )


@query(
    "iso_dates",
    """select o_orderkey, case when o_orderkey % 9 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as day
from orders""",
)
def iso_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    return V.table(spark, sf_dir, "orders").select("o_orderkey", iso_date(text).alias("day"))


@query(
    "internal_urls",
    V.with_views(
        "posts",
        """select doc_id, unnest(list_concat(
  case when doc_id % 2 = 0 then ['https://out.test/' || doc_id] else [] end,
  regexp_extract_all(text, 'https?://[^\\s\\p{Z}]+'))) as url from posts""",
    ),
)
def internal_urls(spark, sf_dir):
    urls = outbound_urls(
        F.col("doc_id") % 2 == 1, F.concat(F.lit("https://out.test/"), F.col("doc_id").cast("string")),
        F.col("text"),
    )
    return V.post_texts(spark, sf_dir).select("doc_id", F.explode(urls).alias("url"))
