"""Exploit-probability and severity enrichment of observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.operators.skew import lookup_join
from cvebeacon.schemas import CVSS_COLUMNS, REQUIRED_FOR_USABLE
from cvebeacon.session import materialize

MAX_DAYS = 30


def _require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def with_day(df: DataFrame, date: str = "date", out: str = "__day") -> DataFrame:
    """Day as DATE from a DATE, TIMESTAMP or ISO-string column; bad text is NULL."""
    kind = df.schema[date].dataType.simpleString()
    column = F.col(date)
    return df.withColumn(out, column.try_cast("date") if kind == "string" else column.cast("date"))


def one_score_per_day(history: DataFrame) -> DataFrame:
    """One row per (cve, date): the smallest score; a record without a score counts as 0."""
    return (
        with_day(history)
        .groupBy("cve", F.col("__day").alias("date"))
        .agg(F.min(F.coalesce("epss", F.lit(0.0))).alias("epss"))
    )


def fallback_score(previous: Column, following: Column, zero_is_missing: bool = True) -> Column:
    """Mean of both neighbours, else the one that exists.

    With ``zero_is_missing`` an earlier score of exactly 0 and no later score
    gives NULL.
    """
    both = previous.isNotNull() & following.isNotNull()
    usable = previous.isNotNull()
    if zero_is_missing:
        usable = usable & (previous != 0)
    return (
        F.when(both, (previous + following) / 2).when(usable, previous).otherwise(following)
    )


def _per_day(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """One row per (cve, day) with the exact score and the number of wanted rows.

    Wanted keys and history meet in one aggregate, so a key is resolved once
    however often it occurs and hot keys are combined before the shuffle.
    Wanted keys may be NULL.
    """
    asked = wanted.select(
        "cve", "__day", F.lit(None).cast("double").alias("epss"), F.lit(1).alias("asked")
    )
    scored = with_day(history).select(
        "cve", "__day", F.coalesce("epss", F.lit(0.0)).alias("epss"), F.lit(0).alias("asked")
    ).dropna(subset=["cve", "__day"])
    return asked.unionByName(scored).groupBy("cve", "__day").agg(
        F.min("epss").alias("exact_score"), F.sum("asked").alias("asked_rows")
    )


def resolve_scores(
    wanted: DataFrame,
    history: DataFrame,
    max_days: int = MAX_DAYS,
    zero_is_missing: bool = True,
) -> DataFrame:
    """Score of every distinct wanted (cve, day), with its number of wanted rows.

    The window sees at most one row per id and calendar day.
    """
    per_day = _per_day(wanted, history).withColumn("n", F.unix_date("__day"))
    # The nearest scored day on either side; one sort serves both directions.
    known = F.when(F.col("exact_score").isNotNull(), F.struct("n", "exact_score"))
    over = "ignore nulls over (partition by cve order by n)"
    nearest = per_day.withColumn("known", known).withColumns(
        {"p": F.expr(f"lag(known, 1) {over}"), "f": F.expr(f"lead(known, 1) {over}")}
    )
    previous = F.when(F.col("n") - F.col("p.n") <= max_days, F.col("p.exact_score"))
    following = F.when(F.col("f.n") - F.col("n") <= max_days, F.col("f.exact_score"))
    resolved = nearest.filter("asked_rows > 0").select(
        "cve",
        "__day",
        "asked_rows",
        "exact_score",
        fallback_score(previous, following, zero_is_missing).alias("near_score"),
    )
    return resolved


def exact_scores(obs: DataFrame, history: DataFrame) -> DataFrame:
    """Left lookup of the score of the same id and day."""
    _require(obs, ["cve", "date"])
    dated = with_day(obs)
    scores = _per_day(dated, history).filter("asked_rows > 0").select(
        "cve", "__day", "asked_rows", F.col("exact_score").alias("epss_score")
    )
    return _lookup(dated, materialize(scores, "scores"))


def _lookup(dated: DataFrame, scores: DataFrame) -> DataFrame:
    return lookup_join(dated, scores, ["cve", "__day"], weight="asked_rows").drop("__day")


def _score_table(
    dated: DataFrame, history: DataFrame, max_days: int, zero_is_missing: bool
) -> DataFrame:
    """Score and status per wanted key, stored: the lookup reads it several times."""
    scores = resolve_scores(dated, history, max_days, zero_is_missing).select(
        "cve",
        "__day",
        "asked_rows",
        F.coalesce("exact_score", "near_score").alias("epss_score"),
        F.when(F.col("exact_score").isNotNull(), "original")
        .otherwise("enriched")
        .alias("epss_status"),
    )
    return materialize(scores, "scores")


def enrich_epss(
    obs: DataFrame,
    history: DataFrame,
    max_days: int = MAX_DAYS,
    zero_is_missing: bool = True,
) -> DataFrame:
    """Add ``epss_score`` and ``epss_status``.

    The score of the day is ``original``; otherwise the nearest scores within
    ``max_days`` before and after stand in and the status is ``enriched``, also
    when nothing was found. The distinct keys are resolved and stored when the
    function is called; the lookup itself is lazy.
    """
    _require(obs, ["cve", "date"])
    dated = with_day(obs)
    return _lookup(dated, _score_table(dated, history, max_days, zero_is_missing))


def fill_missing_scores(
    scored: DataFrame,
    history: DataFrame,
    max_days: int = MAX_DAYS,
    zero_is_missing: bool = True,
) -> DataFrame:
    """Fill NULL ``epss_score`` only; bad dates stay NULL, other columns untouched."""
    dated = with_day(scored)
    gaps = dated.filter(F.col("epss_score").isNull())
    found = _score_table(gaps, history, max_days, zero_is_missing).select(
        "cve", "__day", "asked_rows", F.col("epss_score").alias("__filled")
    )
    filled = lookup_join(gaps, found, ["cve", "__day"], weight="asked_rows")
    filled = filled.withColumn("epss_score", F.coalesce("epss_score", "__filled"))
    complete = dated.filter(F.col("epss_score").isNotNull())
    return complete.unionByName(filled.drop("__filled")).drop("__day")


# ---- severity records -----------------------------------------------------

# Metric block, version label, in order of preference.
CVSS_BLOCKS = [("cvssMetricV31", "3.1"), ("cvssMetricV30", "3.0"), ("cvssMetricV2", "2.0")]


def _either(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def cvss_versions(nvd: DataFrame) -> DataFrame:
    """Flat severity columns with ``modified``, one row per record.

    The first metric block present wins and its first element counts; version-2
    names stand in where the newer field is missing or empty. A record without
    a readable time has a NULL ``modified`` and is older than all others.
    """
    blocks = [(F.get(F.col(f"cve.metrics.{name}"), F.lit(0)), label) for name, label in CVSS_BLOCKS]
    present = [(F.col(f"cve.metrics.{name}").isNotNull(), label) for name, label in CVSS_BLOCKS]
    version = reduce(
        lambda chain, p: chain.when(p[0], p[1]), present[1:], F.when(*present[0])
    )
    chosen = reduce(
        lambda chain, i: chain.when(present[i][0], blocks[i][0]["cvssData"]),
        range(1, len(blocks)),
        F.when(present[0][0], blocks[0][0]["cvssData"]),
    )
    english = F.get(F.filter("cve.descriptions", lambda d: d["lang"] == "en"), F.lit(0))
    flat = nvd.select(
        F.col("cve.id").alias("id"),
        F.col("cve.lastModified").try_cast("timestamp").alias("modified"),
        english["value"].alias("description"),
        version.alias("cvss_version"),
        chosen.alias("m"),
    ).select(
        F.col("id").alias("cve"),
        "modified",
        "description",
        "cvss_version",
        F.col("m.baseScore").alias("cvss_score"),
        _either(F.col("m.attackVector"), F.col("m.accessVector")).alias("attack_vector"),
        _either(F.col("m.attackComplexity"), F.col("m.accessComplexity")).alias(
            "attack_complexity"
        ),
        _either(F.col("m.privilegesRequired"), F.col("m.authentication")).alias(
            "privileges_required"
        ),
        F.col("m.userInteraction").alias("user_interaction"),
        F.col("m.scope").alias("scope"),
        F.col("m.confidentialityImpact").alias("confidentiality_impact"),
        F.col("m.integrityImpact").alias("integrity_impact"),
        F.col("m.availabilityImpact").alias("availability_impact"),
    )
    return flat


def cvss_details(nvd: DataFrame) -> DataFrame:
    """The newest version of each id: one row per id, combined before the shuffle.

    Of versions modified at the same time the greatest row counts.
    """
    versions = cvss_versions(nvd)
    rest = [c for c in versions.columns if c != "cve"]
    newest = versions.groupBy("cve").agg(F.max(F.struct(*rest)).alias("r"))
    return newest.select("cve", *[F.col(f"r.{c}") for c in rest if c != "modified"])


def attach_cvss(obs: DataFrame, nvd: DataFrame) -> DataFrame:
    """Left lookup of the severity columns by id; an unknown id gets NULLs."""
    _require(obs, ["cve"])
    return lookup_join(obs, cvss_details(nvd).select("cve", *CVSS_COLUMNS), ["cve"])


def attach_cvss_asof(obs: DataFrame, nvd: DataFrame) -> DataFrame:
    """Left lookup of the version that was valid at the end of the post's day.

    A version is valid from its ``modified`` until the next one of its id. Days
    before the first version, unknown ids and bad dates get NULLs; a version
    without a time is valid from the beginning. Wanted keys are distinct before
    they meet the versions, so the window sees one row per id and day.
    """
    _require(obs, ["cve", "date"])
    dated = with_day(obs)
    versions = cvss_versions(nvd)
    row = F.struct(*CVSS_COLUMNS)
    # Several versions of one day: the last of the day stands.
    by_day = versions.groupBy("cve", F.coalesce(F.to_date("modified"), F.lit("0001-01-01").cast("date")).alias("__day")).agg(
        F.max_by(row, F.struct("modified", row)).alias("version"), F.lit(0).cast("long").alias("asked_rows")
    )
    asked = dated.groupBy("cve", "__day").agg(
        F.lit(None).cast(by_day.schema["version"].dataType).alias("version"), F.count(F.lit(1)).alias("asked_rows")
    )
    both = by_day.unionByName(asked).groupBy("cve", "__day").agg(
        F.first("version", ignorenulls=True).alias("version"), F.sum("asked_rows").alias("asked_rows")
    )
    until = Window.partitionBy("cve").orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = F.when(
        F.col("__day").isNotNull() & F.col("cve").isNotNull(), F.last("version", ignorenulls=True).over(until)
    )
    resolved = both.withColumn("version", current).filter("asked_rows > 0")
    found = materialize(resolved.select("cve", "__day", "asked_rows", "version.*"), "versions")
    return _lookup(dated, found)


def with_usable(df: DataFrame) -> DataFrame:
    """``usable``: every field a model needs is known."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED_FOR_USABLE])
    return df.withColumn("usable", known)


def enrich(
    obs: DataFrame,
    history: DataFrame,
    nvd: DataFrame,
    max_days: int = MAX_DAYS,
    zero_is_missing: bool = True,
) -> DataFrame:
    """All appended columns in their published order.

    Scores and severity meet per distinct (cve, day) first, which has at most
    one row per id and day, so the observations are joined only once.
    """
    _require(obs, ["cve", "date"])
    dated = with_day(obs)
    scores = _score_table(dated, history, max_days, zero_is_missing)
    details = cvss_details(nvd).select("cve", *CVSS_COLUMNS)
    full = with_usable(_lookup(dated, scores.join(details, "cve", "left")))
    added = ["epss_score", "epss_status", *CVSS_COLUMNS, "usable"]
    return full.select(*obs.columns, *added)
