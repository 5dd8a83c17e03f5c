"""From raw sources to the canonical observation table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.functions.cve import explode_cves, find_cves
from cvebeacon.functions.text import NONSPACE, clean_column, clean_items, trim_space
from cvebeacon.functions.time import iso_date, split_timestamp
from cvebeacon.schemas import OBSERVATION_COLUMNS
from cvebeacon.session import materialize

# ---- schema unification ---------------------------------------------------


def rename_cve_column(df: DataFrame) -> DataFrame:
    """Rename the one column whose name contains ``cve`` to ``cve``."""
    found = [c for c in df.columns if "cve" in c.lower()]
    if len(found) != 1:
        raise ValueError(f"expected one column naming a CVE, found {found}")
    return df.withColumnRenamed(found[0], "cve")


def _filled(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def text_column(df: DataFrame, kind: str) -> DataFrame:
    """Bring the text of a ``json`` or ``csv`` source under the name ``text``."""
    if kind == "json":
        if "clean_text" in df.columns:
            return df.drop("text").withColumnRenamed("clean_text", "text")
        parts = [c for c in ("title", "text", "article_text") if c in df.columns]
        return df.withColumn("text", F.concat_ws(" ", *[_filled(F.col(c)) for c in parts]))
    for name in ("body", "Message", "text"):
        # names match exactly, unlike Spark's own resolution
        if name in df.columns:
            return df if name == "text" else df.withColumnRenamed(name, "text")
    raise ValueError(f"no text column among {df.columns}")


def drop_source_extras(df: DataFrame, source: str) -> DataFrame:
    """Drop the duplicate id column (telegram), counts and comments (reddit).

    The id list of a reddit post becomes one comma-separated cell.
    """
    if "telegram" in source.lower():
        return df.drop("CVE ID.1")
    if "reddit" in source.lower():
        df = df.drop("cve_counts", "clean_comments")
        if "cves" in df.columns and df.schema["cves"].dataType.typeName() == "array":
            df = df.withColumn("cves", F.array_join("cves", ","))
    return df


def _dated(df: DataFrame, source: str, kind: str) -> DataFrame:
    """Extras dropped, text, date and time named, the id cell under ``cve``."""
    df = drop_source_extras(df, source)
    df = text_column(df, kind).withColumn("source", F.lit(source))
    df = rename_cve_column(split_timestamp(df))
    missing = [c for c in ("date", "time") if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing})


def normalize_source(df: DataFrame, source: str, kind: str) -> DataFrame:
    """Canonical rows of one source: one row per distinct (post, id).

    Duplicates are removed over all columns of the source, before projection
    and before cleaning; equal rows combine on the map side first.
    """
    df = explode_cves(_dated(df, source, kind), "cve")
    return df.dropDuplicates().select(*OBSERVATION_COLUMNS)


def normalize_counted(df: DataFrame, source: str, kind: str) -> DataFrame:
    """As ``normalize_source``, with ``raw_rows``: NULL but in one more row per source.

    Every raw row adds a blank row to the rows of its ids; equal blanks combine
    where they are read, and the number of them is the number of raw rows. So
    one scan gives both counts, also when tasks run twice. The blank row has no
    id; a source without rows has none.
    """
    df = _dated(df, source, kind)
    ids = F.coalesce(F.array_distinct(find_cves(F.col("cve"))), F.array().cast("array<string>"))
    blank = F.array(F.lit(None).cast("string"))
    rows = df.withColumn("cve", F.explode(F.concat(blank, ids)))
    real = F.col("cve").isNotNull()
    rest = [c for c in rows.columns if c not in ("cve", "source")]
    rows = rows.withColumns({c: F.when(real, F.col(c)) for c in rest})
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.select(*OBSERVATION_COLUMNS, F.when(~real, F.col("__n")).alias("raw_rows"))


def clean_observations(obs: DataFrame, profile: str = "unified") -> DataFrame:
    return clean_column(obs, "text", profile)


@dataclass(frozen=True)
class Source:
    """One raw input: its frame, its name and whether its text gets cleaned."""

    name: str
    frame: DataFrame
    kind: str = "csv"
    clean: bool = True


def unify_sources(sources: list[Source]) -> dict[str, DataFrame]:
    """Canonical, cleaned table per source name."""
    ready = {}
    for s in sources:
        canonical = normalize_source(s.frame, s.name, s.kind)
        ready[s.name] = clean_observations(canonical) if s.clean else canonical
    return ready


def merge(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def _stats(counted: DataFrame, sources: list[Source]) -> DataFrame:
    """Rows per stage from the counted rows of all sources; one aggregate, TOTAL included."""
    spark = counted.sparkSession
    names = spark.createDataFrame([(s.name, s.clean) for s in sources], "path STRING, cleaned BOOLEAN")
    sums = (
        counted.groupBy(F.col("source").alias("path"))
        .agg(F.sum("raw_rows").alias("initial"), F.count("cve").alias("kept"))
    )
    # A handful of names; a source without rows has no sums.
    known = names.join(sums, "path", "left").select(
        "path", "cleaned", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("initial", "kept")]
    )
    total = F.grouping("path") == 1
    return known.rollup("path").agg(
        F.when(total, None).otherwise(F.sum("initial")).alias("initial"),
        F.when(total, None).otherwise(F.sum("kept")).alias("after_normalize"),
        F.when(total | F.bool_and("cleaned"), F.sum("kept")).alias("after_clean"),
        total.alias("__total"),
    ).select(
        F.when(F.col("__total"), "TOTAL").otherwise(F.col("path")).alias("path"),
        "initial", "after_normalize", "after_clean",
    )


def source_stats(sources: list[Source]) -> DataFrame:
    """Rows per source: ``initial``, ``after_normalize``, ``after_clean``, and TOTAL.

    Cleaning maps rows one to one, so its count is that of normalisation; the
    total counts the merged table. Every source is scanned once.
    """
    return _stats(merge([normalize_counted(s.frame, s.name, s.kind) for s in sources]), sources)


def unify_with_stats(sources: list[Source]) -> tuple[DataFrame, DataFrame]:
    """The merged, cleaned observations and the counts of their stages, from one scan per source.

    The merged rows are written to the shared folder, the counts beside them.
    """
    frames = []
    for s in sources:
        counted = normalize_counted(s.frame, s.name, s.kind)
        frames.append(clean_observations(counted) if s.clean else counted)
    stored = materialize(merge(frames), "unified")
    return stored.filter("cve is not null").select(*OBSERVATION_COLUMNS), _stats(stored, sources)


# ---- older per-source loaders ---------------------------------------------

# Source -> (id column, time column, text column).
LOADERS = {
    "exploitdb": ("cves", "date", "text"),
    "mastodon": ("cve", "created_at", "body"),
    "reddit": ("cves", "timestamp", "clean_text"),
    "telegram": ("CVE ID", "Timestamp", "Message"),
    "bleepingcomputer": ("cves", "date", "text"),
}
MERGED_KEY = ["cve", "timestamp", "source", "text"]


def load_source(df: DataFrame, source: str) -> DataFrame:
    """(cve, timestamp, source, text) of one source.

    A cell naming several ids stays one value, except reddit's list, which is
    exploded. Blank ids drop the row; an unparsable time is an error.
    """
    if source not in LOADERS:
        raise ValueError(f"unknown source {source!r}; known: {sorted(LOADERS)}")
    cve, time, text = LOADERS[source]
    is_list = df.schema[cve].dataType.typeName() == "array"
    ids = F.explode(F.col(f"`{cve}`")) if is_list else trim_space(F.col(f"`{cve}`"))
    rows = df.select(
        ids.alias("cve"),
        iso_date(F.col(time), strict=True).alias("timestamp"),
        F.lit(source).alias("source"),
        F.col(text).alias("text"),
    )
    return rows if is_list else rows.filter(F.col("cve") != "")


def merge_into(stored: DataFrame | None, new: list[DataFrame]) -> DataFrame:
    """Stored and new rows without duplicates on the four columns."""
    frames = [f.select(*MERGED_KEY) for f in ([stored] if stored is not None else []) + new]
    return merge(frames).dropDuplicates(MERGED_KEY)


# ---- reddit posts ---------------------------------------------------------


def outbound_urls(is_self: Column, url: Column, text: Column) -> Column:
    """Link target of a link post, then every address in the body."""
    empty = F.array().cast("array<string>")
    linked = F.when(~is_self & (F.coalesce(url, F.lit("")) != ""), F.array(url)).otherwise(empty)
    written = F.regexp_extract_all(text, F.lit(f"(?U)https?://{NONSPACE}+"), F.lit(0))
    return F.concat(linked, F.coalesce(written, empty))


def drop_blank_comments(comments: Column) -> Column:
    return F.filter(comments, lambda c: trim_space(c["text"]) != "")


def clean_comments(df: DataFrame, column: str = "comments", out: str = "clean_comments") -> DataFrame:
    """Clean each comment, drop empty ones, prefix its level where known."""
    texts = F.transform(column, lambda c: c["text"])
    staged = clean_items(df.withColumn("__texts", texts), "__texts", "reddit", "__texts")
    zipped = F.zip_with(
        column,
        "__texts",
        lambda c, t: F.when(
            t != "",
            F.when(
                c["level"].isNotNull(),
                F.concat(F.lit("Level "), c["level"].cast("string"), F.lit(": "), t),
            ).otherwise(t),
        ),
    )
    kept = F.filter(F.coalesce(zipped, F.array().cast("array<string>")), lambda t: t.isNotNull())
    return staged.withColumn(out, kept).drop("__texts")


def clean_posts(posts: DataFrame) -> DataFrame:
    """Add ``clean_text`` and ``clean_comments``, drop the raw fields."""
    df = posts
    for field in ("text", "article_text"):
        df = clean_column(df, field, "reddit", f"__{field}")
    parts = [trim_space(F.col("title")), F.col("__text"), F.col("__article_text")]
    df = df.withColumn("clean_text", trim_space(F.concat_ws(" ", *[_filled(p) for p in parts])))
    df = clean_comments(df)
    return df.drop("__text", "__article_text", "text", "article_text", "comments")
