"""Queries: score and severity enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cvebeacon.operators import enrich as E
from cvebeacon.operators.metrics import missing_report
from cvebeacon.operators.resume import SlicedJob, enrich_in_slices
from cvebeacon.plans import views as V
from cvebeacon.plans.registry import query
from cvebeacon.schemas import CVSS_COLUMNS, REQUIRED_FOR_USABLE
from cvebeacon.session import shared_folder

_CVSS = ", ".join(f"c.{c}" for c in CVSS_COLUMNS)
_USABLE = " and ".join(f"{c} is not null" for c in REQUIRED_FOR_USABLE)


@query(
    "epss_exact_join",
    V.with_views(
        "obs epss",
        "select o_orderkey, o.cve, date, round(epss, 6) as epss_score from obs o "
        "left join epss e on e.cve = o.cve and e.d = o.d",
    ),
)
def epss_exact_join(spark, sf_dir):
    obs = V.observations(spark, sf_dir).select("o_orderkey", "cve", "date")
    scored = E.exact_scores(obs, V.epss_history(spark, sf_dir))
    return scored.withColumn("epss_score", F.round("epss_score", 6))


@query(
    "epss_asof_30d",
    V.with_views(
        "obs epss scored",
        "select o_orderkey, cve, date, round(epss_score, 6) as epss_score, epss_status from scored",
    ),
)
def epss_asof_30d(spark, sf_dir):
    obs = V.observations(spark, sf_dir).select("o_orderkey", "cve", "date")
    scored = E.enrich_epss(obs, V.epss_history(spark, sf_dir))
    return scored.withColumn("epss_score", F.round("epss_score", 6))


@query(
    "epss_asof_keep_zero",
    V.with_views(
        "obs epss scored",
        """select o_orderkey, round(case when exact is not null then exact
  when prev is not null and nxt is not null then (prev + nxt) / 2 else coalesce(prev, nxt) end, 6) as epss_score
from obs o join near_scores s on s.cve = o.cve and s.d = o.d""",
    ),
)
def epss_asof_keep_zero(spark, sf_dir):
    obs = V.observations(spark, sf_dir).select("o_orderkey", "cve", "date")
    scored = E.enrich_epss(obs, V.epss_history(spark, sf_dir), zero_is_missing=False)
    return scored.select("o_orderkey", F.round("epss_score", 6).alias("epss_score"))


@query(
    "epss_status_by_source",
    V.with_views(
        "obs epss scored",
        "select source, epss_status, count(*) as observations, count(epss_score) as scored, "
        "round(avg(epss_score), 6) as mean_score from scored group by source, epss_status",
    ),
)
def epss_status_by_source(spark, sf_dir):
    obs = V.observations(spark, sf_dir).select("cve", "source", "date")
    scored = E.enrich_epss(obs, V.epss_history(spark, sf_dir))
    return scored.groupBy("source", "epss_status").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("epss_score").alias("scored"),
        F.round(F.avg("epss_score"), 6).alias("mean_score"),
    )


_BAD_DATE = "case when o_orderkey % 97 = 0 then 'soon' else date end"
_HAVE = "case when o_orderkey % 3 = 0 then 0.5 end"


@query(
    "epss_fill_missing",
    V.with_views(
        "obs epss scored",
        f"""select o_orderkey, {_BAD_DATE} as date, 'kept' as epss_status,
  round(case when o_orderkey % 3 = 0 then 0.5 when o_orderkey % 97 = 0 then null else epss_score end, 6) as epss_score
from scored""",
    ),
)
def epss_fill_missing(spark, sf_dir):
    scored = V.observations(spark, sf_dir).select(
        "o_orderkey", "cve", F.expr(_BAD_DATE).alias("date"), F.lit("kept").alias("epss_status"),
        F.expr(_HAVE).cast("double").alias("epss_score"),
    )
    filled = E.fill_missing_scores(scored, V.epss_history(spark, sf_dir))
    return filled.withColumn("epss_score", F.round("epss_score", 6)).drop("cve")


@query("cvss_details", V.with_views("cvss", "select * from cvss"))
def cvss_details(spark, sf_dir):
    return E.cvss_details(V.nvd_records(spark, sf_dir))


@query(
    "cvss_attach",
    V.with_views("obs cvss", f"select o_orderkey, o.cve, {_CVSS} from obs o left join cvss c using (cve)"),
)
def cvss_attach(spark, sf_dir):
    obs = V.observations(spark, sf_dir).select("o_orderkey", "cve")
    return E.attach_cvss(obs, V.nvd_records(spark, sf_dir))


@query(
    "cvss_asof",
    V.with_views(
        "obs versions",
        f""", spans as (select *, lead(modified) over (partition by cve order by modified) as until from versions)
select o_orderkey, o.cve, o.date, {_CVSS} from obs o left join spans c
on c.cve = o.cve and o.d >= c.modified and (c.until is null or o.d < c.until)""",
    ),
)
def cvss_asof(spark, sf_dir):
    obs = V.observations(spark, sf_dir).select("o_orderkey", "cve", "date")
    return E.attach_cvss_asof(obs, V.nvd_records(spark, sf_dir))


def enriched(spark, sf_dir):
    return E.enrich(
        V.observations(spark, sf_dir), V.epss_history(spark, sf_dir), V.nvd_records(spark, sf_dir)
    )


ENRICHED_SQL = f"""enriched as (
  select *, {_USABLE} as usable from (
    select s.o_orderkey, s.cve, s.source, s.date, s.time, s.text, s.epss_score, s.epss_status, {_CVSS}
    from scored s left join cvss c using (cve)))"""


@query(
    "enriched_observations",
    V.with_views("obs epss scored cvss", ", " + ENRICHED_SQL + """
select * exclude (epss_score), round(epss_score, 6) as epss_score from enriched"""),
)
def enriched_observations(spark, sf_dir):
    return enriched(spark, sf_dir).withColumn("epss_score", F.round("epss_score", 6))


class Stopped(Exception):
    """The run was stopped on purpose."""


@query(
    "enrich_resume",
    V.with_views("obs epss scored cvss", ", " + ENRICHED_SQL + """
select * exclude (epss_score), round(epss_score, 6) as epss_score from enriched"""),
)
def enrich_resume(spark, sf_dir):
    """Enrichment in four slices, stopped when the third was written but not entered, then called again."""
    given = V.observations(spark, sf_dir), V.epss_history(spark, sf_dir), V.nvd_records(spark, sf_dir)
    job = SlicedJob(shared_folder(spark, "enrich"), 4)

    def stop(number):
        if number == 2:
            raise Stopped

    try:
        enrich_in_slices(*given, job, written=stop)
    except Stopped:
        pass
    return enrich_in_slices(*given, job).withColumn("epss_score", F.round("epss_score", 6))


@query(
    "missing_report",
    V.with_views("obs epss scored cvss", ", " + ENRICHED_SQL + """
select 'epss_score' as column, count(*) - count(epss_score) as missing, count(epss_score) as present from enriched
union all select 'scope', count(*) - count(scope), count(scope) from enriched"""),
)
def missing(spark, sf_dir):
    return missing_report(enriched(spark, sf_dir), ["epss_score", "scope"])
