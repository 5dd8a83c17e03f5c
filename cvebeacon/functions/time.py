"""Timestamp parsing and formatting; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted names of the timestamp column, any letter case.
TIMESTAMP_ALIASES = ("timestamp", "datetime", "created_at", "created_utc", "posted_at")

# Range of nanosecond timestamps in seconds; values outside become NULL.
_MAX_EPOCH_SECONDS = 9_223_372_036


def epoch_to_timestamp(seconds: Column) -> Column:
    inside = seconds.between(-_MAX_EPOCH_SECONDS, _MAX_EPOCH_SECONDS)
    return F.timestamp_seconds(F.when(inside, seconds))


def parse_timestamp(value: Column, data_type: T.DataType) -> Column:
    """Numbers are epoch seconds, strings are ISO; what does not parse is NULL."""
    if isinstance(data_type, T.NumericType):
        return epoch_to_timestamp(value)
    if isinstance(data_type, T.StringType):
        return F.try_to_timestamp(value)
    return value.cast("timestamp")


def iso_date(value: Column, strict: bool = False) -> Column:
    """``yyyy-MM-dd`` of an ISO string; ``strict`` raises on unparsable text."""
    day = F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd")
    if not strict:
        return day
    message = F.concat(F.lit("not an ISO timestamp: "), value)
    return F.when(day.isNull() & value.isNotNull(), F.raise_error(message)).otherwise(day)


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(epoch_to_timestamp(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def split_timestamp(df: DataFrame) -> DataFrame:
    """Replace the first timestamp-like column by ``date`` and ``time`` strings."""
    name = next((c for c in df.columns if c.lower() in TIMESTAMP_ALIASES), None)
    if name is None:
        return df
    when = parse_timestamp(F.col(f"`{name}`"), df.schema[name].dataType)
    return (
        df.withColumn("__ts", when)
        .withColumn("date", F.date_format("__ts", "yyyy-MM-dd"))
        .withColumn("time", F.date_format("__ts", "HH:mm"))
        .drop("__ts", name)
    )
