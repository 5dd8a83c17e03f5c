"""Inputs the operators need, derived from the given tables row by row.

Each view exists twice: as a DataFrame and as a common table expression for
the checking SQL. Expressions both engines accept are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvebeacon.operators.enrich import one_score_per_day
from cvebeacon.schemas import NVD_CVE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: str, select: str) -> str:
    """Checking SQL: the named views followed by the query."""
    found = [x for n in names.split() for x in (("versions", n) if n == "cvss" else (n,))]
    return "with " + ",\n".join(SQL_VIEWS[n] for n in found) + "\n" + select


def cve_of(number: str, year: int = 2024) -> str:
    """The id of a number: four digits, more where it needs them."""
    digits = f"cast({number} as varchar(20))"
    return f"'CVE-{year}-' || case when {number} < 1000 then lpad({digits}, 4, '0') else {digits} end"


# ---- expressions shared by both engines -----------------------------------

OBS_CVE = cve_of("o_custkey")
OBS_SOURCE = (
    "case o_orderkey % 5 when 0 then 'reddit_22_05' when 1 then 'mastodon_22_05' "
    "when 2 then 'telegram_21_05' when 3 then 'exploitdb_22_05' else 'bleepingcomputer_22_05' end"
)
EPSS_CVE = cve_of("l_partkey")
# Two parts are two versions of one record.
NVD_ID = cve_of("cast(floor(p_partkey / 2) as bigint)")
NVD_DAYS = "cast((p_partkey * 37) % 2400 as int)"

POST_TEXT = (
    "text || ' cve-2024-' || lpad(cast(doc_id % 500 as varchar(20)), 4, '0')"
    " || case when doc_id % 3 = 0 then ' and Cve-2023-'"
    " || lpad(cast(doc_id % 300 as varchar(20)), 4, '0') || '.' else '' end"
    " || case when doc_id % 4 = 0 then ' CVE-2024-'"
    " || lpad(cast(doc_id % 500 as varchar(20)), 4, '0') else '' end"
    " || case when doc_id % 7 = 0 then ' cve-2022-1234'"
    " || lpad(cast(doc_id % 9000 as varchar(20)), 4, '0') else '' end"
    " || case doc_id % 12"
    " when 0 then ' https://ex.test/a?b=1'"
    " when 1 then ' www.ex.test/x and https:// spaced.test'"
    " when 2 then ' @user_1 said'"
    " when 3 then ' #tag and # other ##'"
    " when 4 then ' **bold** and _it_ and ~~no~~ and `code`'"
    " when 5 then ' wow!!!! --- ok... \"\"quoted\"\"'"
    " when 6 then ' ```code ' || chr(10) || 'x``` end'"
    " when 7 then ' a &amp; b &lt;c&gt; <br> d'"
    " when 8 then ' fire \U0001f525 and \U0001f44d ok'"
    " when 9 then ' zero\u200bwidth'"
    " when 10 then chr(10) || '## heading ' || chr(10) || '> quoted'"
    " else ' [label](https://ex.test/p) (x) [y] [m](mailto:a@b.test)' end"
)
POST_PERMALINK = "'/r/' || source || '/' || cast(doc_id as varchar(20))"
POST_TIME = "'2024-01-' || lpad(cast(doc_id % 28 + 1 as varchar(20)), 2, '0') || 'T10:15:00'"


# ---- DataFrames -----------------------------------------------------------


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, cve, source, date, time, text."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(OBS_CVE).alias("cve"),
        F.expr(OBS_SOURCE).alias("source"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.date_format("o_orderdate", "HH:mm").alias("time"),
        F.col("o_orderpriority").alias("text"),
    )


def epss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cve, date, epss with several rows per key."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(EPSS_CVE).alias("cve"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_discount").alias("epss"),
    )


def daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per (cve, date): the input of the distribution statistics."""
    return one_score_per_day(epss_history(spark, sf_dir)).withColumnRenamed("epss", "epss_score")


_V3 = {
    "attackVector": "case when p_size % 5 = 0 then '' else "
    "element_at(array('NETWORK', 'LOCAL', 'PHYSICAL'), p_size % 3 + 1) end",
    "accessVector": "case when p_size % 5 = 0 then 'ADJACENT' end",
    "attackComplexity": "element_at(array('LOW', 'HIGH', 'LOW'), p_size % 3 + 1)",
    "privilegesRequired": "element_at(array('NONE', 'LOW', 'HIGH'), p_size % 3 + 1)",
    "userInteraction": "element_at(array('NONE', 'REQUIRED', 'NONE'), p_size % 3 + 1)",
    "scope": "element_at(array('UNCHANGED', 'CHANGED', 'UNCHANGED'), p_size % 3 + 1)",
    "confidentialityImpact": "element_at(array('HIGH', 'LOW', 'NONE'), p_size % 3 + 1)",
    "integrityImpact": "element_at(array('HIGH', 'LOW', 'NONE'), p_size % 3 + 1)",
    "availabilityImpact": "element_at(array('HIGH', 'LOW', 'NONE'), p_size % 3 + 1)",
}
_V2 = {
    "accessVector": "element_at(array('NETWORK', 'ADJACENT_NETWORK', 'LOCAL'), p_size % 3 + 1)",
    "accessComplexity": "element_at(array('LOW', 'MEDIUM', 'HIGH'), p_size % 3 + 1)",
    "authentication": "element_at(array('NONE', 'SINGLE', 'MULTIPLE'), p_size % 3 + 1)",
    "confidentialityImpact": "element_at(array('COMPLETE', 'PARTIAL', 'NONE'), p_size % 3 + 1)",
    "integrityImpact": "element_at(array('COMPLETE', 'PARTIAL', 'NONE'), p_size % 3 + 1)",
    "availabilityImpact": "element_at(array('COMPLETE', 'PARTIAL', 'NONE'), p_size % 3 + 1)",
}
_CVSS_FIELDS = (
    "baseScore attackVector accessVector attackComplexity accessComplexity privilegesRequired "
    "authentication userInteraction scope confidentialityImpact integrityImpact availabilityImpact"
).split()


def _metric(fields: dict[str, str]) -> str:
    values = {"baseScore": "(p_size % 101) / 10.0D", **fields}
    parts = [
        f"'{f}', cast({values.get(f, 'null')} as {'double' if f == 'baseScore' else 'string'})"
        for f in _CVSS_FIELDS
    ]
    return f"array(named_struct('cvssData', named_struct({', '.join(parts)})))"


def nvd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested vulnerability records, one per part: several versions of an id."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_size", F.expr(NVD_ID).alias("id"),
        F.date_format(F.expr(f"date_add(date'1992-01-01', {NVD_DAYS})"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("modified"),
    )
    english = "named_struct('lang', 'en', 'value', p_name)"
    record = f"""named_struct(
        'id', id,
        'descriptions', case when p_partkey % 2 = 0
            then array(named_struct('lang', 'es', 'value', 'es ' || p_name), {english},
                       named_struct('lang', 'en', 'value', 'later'))
            else array({english}) end,
        'metrics', named_struct(
            'cvssMetricV31', case when p_partkey % 4 = 0 then {_metric(_V3)} end,
            'cvssMetricV30', case when p_partkey % 4 = 1 then {_metric(_V3)} end,
            'cvssMetricV2', case when p_partkey % 4 in (0, 2) then {_metric(_V2)} end),
        'lastModified', modified)"""
    return parts.select(F.expr(record).cast(NVD_CVE).alias("cve"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reddit-like posts: permalink, title, text, article_text, timestamp, comments."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(POST_PERMALINK).alias("permalink"),
        F.expr("' ' || source || ' cve-2021-0001 '").alias("title"),
        F.expr(POST_TEXT).alias("text"),
        F.expr("case when doc_id % 5 = 0 then 'Seen CVE-2021-0001 in ' || lang end").alias(
            "article_text"
        ),
        F.expr(POST_TIME).alias("timestamp"),
        F.expr(
            "array(named_struct('score', 3, 'text', 'first **note** on ' || source, 'level', 0),"
            " named_struct('score', 1, 'text', '  ', 'level', 1))"
        ).alias("comments"),
    )


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(POST_TEXT).alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_discount").alias("actual"),
        F.col("l_tax").alias("predicted"),
    )


def comment_id(turn: str) -> str:
    """Ids of 20 characters, like those of a forum."""
    return f"'t1_' || lpad(cast({turn} as varchar(20)), 17, '0')"


COMMENT_SCORE = (
    "case when turn % 7 = 0 then null when length(text) % 5 = 0 then cast(-2000000000000 - length(text) % 100 as bigint) "
    "else cast(length(text) % 100 as bigint) end"
)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread rows: replies hang below turn (turn - 1) / 2; turn 0 is the post."""
    return (
        table(spark, sf_dir, "conversations")
        .filter("turn > 0")
        .select(
            F.col("conv_id").alias("post"),
            F.expr(comment_id("turn")).alias("comment"),
            F.expr("case when turn > 2 then " + comment_id("cast(floor((turn - 1) / 2) as bigint)") + " end").alias("parent"),
            F.expr(COMMENT_SCORE).alias("score"),
            F.col("role").alias("author"),
            "text",
        )
    )


# ---- the same views for the checking SQL ----------------------------------

_PICK = "list_extract([{}], p_size % 3 + 1)"


def _pick(*values: str) -> str:
    return _PICK.format(", ".join(f"'{v}'" for v in values))


SQL_VIEWS = {
    "obs": f"""obs as (
  select o_orderkey, {OBS_CVE} as cve, {OBS_SOURCE} as source,
         strftime(o_orderdate, '%Y-%m-%d') as date, strftime(o_orderdate, '%H:%M') as time,
         o_orderpriority as text, cast(o_orderdate as date) as d
  from orders)""",
    "epss": f"""epss as (
  select {EPSS_CVE} as cve, cast(l_shipdate as date) as d, min(l_discount) as epss
  from lineitem group by 1, 2)""",
    "scored": """near_scores as (
  select k.cve, k.d, max(case when h.d = k.d then h.epss end) as exact,
         arg_max(h.epss, h.d) filter (where h.d < k.d) as prev,
         arg_min(h.epss, h.d) filter (where h.d > k.d) as nxt
  from (select distinct cve, d from obs) k
  left join epss h on h.cve = k.cve and h.d between k.d - 30 and k.d + 30
  group by k.cve, k.d),
scored as (
  select o.*, case when exact is not null then exact
                   when prev is not null and nxt is not null then (prev + nxt) / 2
                   when prev is not null and prev <> 0 then prev else nxt end as epss_score,
         case when exact is not null then 'original' else 'enriched' end as epss_status
  from obs o join near_scores s on s.cve = o.cve and s.d = o.d)""",
    "versions": f"""versions as (
  select {NVD_ID} as cve, date '1992-01-01' + {NVD_DAYS} as modified, p_name as description,
    case p_partkey % 4 when 0 then '3.1' when 1 then '3.0' when 2 then '2.0' end as cvss_version,
    case when p_partkey % 4 < 3 then (p_size % 101) / 10.0::double end as cvss_score,
    case when p_partkey % 4 < 2 and p_size % 5 = 0 then 'ADJACENT'
         when p_partkey % 4 < 2 then {_pick('NETWORK', 'LOCAL', 'PHYSICAL')}
         when p_partkey % 4 = 2 then {_pick('NETWORK', 'ADJACENT_NETWORK', 'LOCAL')} end as attack_vector,
    case when p_partkey % 4 < 2 then {_pick('LOW', 'HIGH', 'LOW')}
         when p_partkey % 4 = 2 then {_pick('LOW', 'MEDIUM', 'HIGH')} end as attack_complexity,
    case when p_partkey % 4 < 2 then {_pick('NONE', 'LOW', 'HIGH')}
         when p_partkey % 4 = 2 then {_pick('NONE', 'SINGLE', 'MULTIPLE')} end as privileges_required,
    case when p_partkey % 4 < 2 then {_pick('NONE', 'REQUIRED', 'NONE')} end as user_interaction,
    case when p_partkey % 4 < 2 then {_pick('UNCHANGED', 'CHANGED', 'UNCHANGED')} end as scope,
    {", ".join(f'''case when p_partkey % 4 < 2 then {_pick('HIGH', 'LOW', 'NONE')}
         when p_partkey % 4 = 2 then {_pick('COMPLETE', 'PARTIAL', 'NONE')} end as {c}'''
         for c in ('confidentiality_impact', 'integrity_impact', 'availability_impact'))}
  from part)""",
    "cvss": """cvss as (
  select * exclude (modified) from versions
  qualify row_number() over (partition by cve order by modified desc) = 1)""",
    "posts": f"""posts as (
  select doc_id, {POST_PERMALINK} as permalink, ' ' || source || ' cve-2021-0001 ' as title,
         {POST_TEXT} as text,
         case when doc_id % 5 = 0 then 'Seen CVE-2021-0001 in ' || lang end as article_text,
         {POST_TIME} as timestamp
  from documents)""",
    "found": """found as (
  select doc_id, unnest(regexp_extract_all(upper(text), 'CVE-\\d{4}-\\d{4,7}')) as cve
  from posts)""",
    "pred": """pred as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount as actual, l_tax as predicted
  from lineitem)""",
}
