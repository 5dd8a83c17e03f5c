"""Explicit schemas at the edges: raw sources, lookup tables and results."""

from __future__ import annotations

REDDIT_RAW = (
    "cves ARRAY<STRING>, cve_counts MAP<STRING,INT>, title STRING, text STRING, "
    "permalink STRING, timestamp STRING, article_text STRING, "
    "comments ARRAY<STRUCT<score:INT,text:STRING,level:INT>>"
)
REDDIT_CLEAN = (
    "cves ARRAY<STRING>, cve_counts MAP<STRING,INT>, title STRING, permalink STRING, "
    "timestamp STRING, clean_text STRING, clean_comments ARRAY<STRING>"
)
MASTODON = "cve STRING, created_at STRING, body STRING"
TELEGRAM = "`CVE ID` STRING, `CVE ID.1` STRING, Timestamp STRING, Message STRING"
EXPLOITDB = "cves STRING, date STRING, text STRING"
BLEEPINGCOMPUTER = EXPLOITDB

EPSS_HISTORY = "cve STRING, date DATE, epss DOUBLE"

_CVSS_DATA = (
    "STRUCT<baseScore:DOUBLE, attackVector:STRING, accessVector:STRING, "
    "attackComplexity:STRING, accessComplexity:STRING, privilegesRequired:STRING, "
    "authentication:STRING, userInteraction:STRING, scope:STRING, "
    "confidentialityImpact:STRING, integrityImpact:STRING, availabilityImpact:STRING>"
)
_METRIC_LIST = f"ARRAY<STRUCT<cvssData:{_CVSS_DATA}>>"
NVD_CVE = (
    "STRUCT<id:STRING, descriptions:ARRAY<STRUCT<lang:STRING,value:STRING>>, "
    f"metrics:STRUCT<cvssMetricV31:{_METRIC_LIST}, cvssMetricV30:{_METRIC_LIST}, "
    f"cvssMetricV2:{_METRIC_LIST}>, lastModified:STRING>"
)
NVD = f"cve {NVD_CVE}"

OBSERVATION = "cve STRING, source STRING, date STRING, time STRING, text STRING"
OBSERVATION_COLUMNS = ["cve", "source", "date", "time", "text"]

CVSS_CATEGORICALS = [
    "attack_vector",
    "attack_complexity",
    "privileges_required",
    "user_interaction",
    "scope",
    "confidentiality_impact",
    "integrity_impact",
    "availability_impact",
]
CVSS_COLUMNS = ["description", "cvss_version", "cvss_score", *CVSS_CATEGORICALS]
REQUIRED_FOR_USABLE = ["epss_score", "cvss_score", *CVSS_CATEGORICALS]
ENRICHED = (
    OBSERVATION + ", epss_score DOUBLE, epss_status STRING, description STRING, "
    "cvss_version STRING, cvss_score DOUBLE, "
    + ", ".join(f"{c} STRING" for c in CVSS_CATEGORICALS)
    + ", usable BOOLEAN"
)
PREDICTIONS = "actual DOUBLE, predicted DOUBLE"
