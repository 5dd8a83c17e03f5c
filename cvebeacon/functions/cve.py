"""Vulnerability-id extraction and counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the id pattern. No word boundary, so a longer tail is cut at 7 digits.
CVE_PATTERN = r"(?i)CVE-\p{Nd}{4}-\p{Nd}{4,7}"


def find_cves(text: Column) -> Column:
    """All ids in order of appearance, upper-cased, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(CVE_PATTERN), F.lit(0)), F.upper)


def find_cves_in(*texts: Column) -> Column:
    """Ids over several texts; a missing text counts as empty."""
    found = [F.coalesce(find_cves(t), F.array().cast("array<string>")) for t in texts]
    return reduce(lambda a, b: F.concat(a, b), found)


def distinct_cves(cves: Column) -> Column:
    return F.array_sort(F.array_distinct(cves))


def cve_counts(cves: Column) -> Column:
    """Map of id to number of mentions, keys in id order."""
    return F.map_from_entries(
        F.transform(
            distinct_cves(cves),
            lambda x: F.struct(x, F.size(F.filter(cves, lambda y: y == x))),
        )
    )


def mention_count(counts: Column, cve: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, cve), F.lit(0))


def keep_cve_characters(cve: Column) -> Column:
    """Strip everything but the letters of 'CVE', digits and hyphens."""
    return F.regexp_replace(cve, r"[^CVE0-9\-]", "")


def has_cve(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(CVE_PATTERN)), F.lit(False))


def explode_cves(df: DataFrame, column: str, out: str = "cve") -> DataFrame:
    """One row per distinct id in ``column``; rows without an id vanish."""
    return df.withColumn(out, F.explode(F.array_distinct(find_cves(F.col(column)))))


def count_mentions(df: DataFrame, key: list[str], texts: list[str]) -> DataFrame:
    """Table form of the counts: one row per (key, id)."""
    found = find_cves_in(*[F.col(t) for t in texts])
    return (
        df.select(*key, F.explode(found).alias("cve"))
        .groupBy(*key, "cve")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def recount(df: DataFrame, texts: tuple[str, ...] = ("title", "text", "article_text")) -> DataFrame:
    """Rebuild ``cves`` and ``cve_counts`` of post objects from their texts."""
    staged = df.withColumn("__found", find_cves_in(*[F.col(t) for t in texts]))
    return (
        staged.withColumn("cves", distinct_cves(F.col("__found")))
        .withColumn("cve_counts", cve_counts(F.col("__found")))
        .drop("__found")
    )
