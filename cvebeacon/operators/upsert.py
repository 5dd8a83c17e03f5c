"""Incremental merging into a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.operators.skew import lookup_join
from cvebeacon.operators.unify import clean_posts

KEY = "permalink"


def _identity(keys: list[str]) -> Column:
    """Text of the key columns; a missing key is a value of its own."""
    # All digits of a timestamp: the default format stops at milliseconds.
    exact = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    return F.to_json(F.struct(*keys), exact)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def _seen(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Asked-for ids the store holds.

    Only key columns of the store are read, and they are reduced to the ids the
    batch asks for, so the long history stays put when the batch is the small side.
    """
    asked = new.select("__id").distinct()
    return stored.join(asked, "__id", "left_semi").distinct()


def unseen(new: DataFrame, stored: DataFrame, key: str | list[str] = KEY) -> DataFrame:
    """Rows of ``new`` whose key is not stored; many rows may share a key."""
    keys = _keys(key)
    new = new.withColumn("__id", _identity(keys))
    seen = _seen(new, stored.select(_identity(keys).alias("__id")))
    marked = lookup_join(new, seen.withColumn("__stored", F.lit(True)), ["__id"])
    return marked.filter(F.col("__stored").isNull()).drop("__id", "__stored")


def unseen_unique(new: DataFrame, stored: DataFrame, key: str | list[str] = KEY) -> DataFrame:
    """``unseen`` for a batch with one row per key: nothing to spread, one anti join."""
    keys = _keys(key)
    new = new.withColumn("__id", _identity(keys))
    seen = _seen(new, stored.select(_identity(keys).alias("__id")))
    return new.join(seen, "__id", "left_anti").drop("__id")


def first_per_key(df: DataFrame, key: str = KEY, order: list[str] | None = None) -> DataFrame:
    """One whole row per key, the smallest by ``order``; NULL keys stay one group.

    An aggregate rather than a window: copies of a hot key combine before the
    shuffle and are never collected in one task.
    """
    order = order or [c for c in df.columns if c != key and _sortable(df, c)]
    rank = F.struct(*order)
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), rank).alias("__row"))
        .select(key, "__row.*")
        .select(*df.columns)
    )


def _sortable(df: DataFrame, column: str) -> bool:
    return "map<" not in df.schema[column].dataType.simpleString()


def append_posts(stored: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """Stored rows win; new rows join only when their key is not stored."""
    return stored.unionByName(unseen(new, stored, key))


def update_cleaned(stored: DataFrame, raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add the posts the cleaned store lacks, cleaning only those.

    Of several new posts with one permalink the first is kept; stored rows
    without a permalink are dropped.
    """
    keyed = stored.filter(F.coalesce(F.col(KEY), F.lit("")) != "")
    return keyed.unionByName(new_cleaned(keyed, raw, order))


def new_cleaned(stored: DataFrame, raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    # Copies of a post combine first, so a hot key is one row before it shuffles.
    return clean_posts(unseen_unique(first_per_key(raw, KEY, order), stored))


def pending(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Resume: the rows whose key has no result yet.

    A result whose key was never asked for means the two tables do not belong
    together; ``check_resume`` turns that into an error.
    """
    return unseen(wanted, done, key)


def check_resume(wanted: DataFrame, done: DataFrame, key: list[str]) -> None:
    if not unseen_unique(done.select(*key).distinct(), wanted, key).isEmpty():
        raise ValueError("the stored output does not match the input; cannot resume")
