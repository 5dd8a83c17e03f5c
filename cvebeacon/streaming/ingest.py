"""Incremental collection as a Structured Streaming job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cvebeacon.functions.cve import has_cve
from cvebeacon.operators.upsert import KEY, first_per_key, unseen_unique
from cvebeacon.sources.files import read_or_empty

JOB_COLUMN = "ingest_job"
BATCH_COLUMN = "ingest_batch"


def posts_with_cve(posts: DataFrame, texts: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Posts that name at least one id in one of the texts."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    return posts.filter(has_cve(joined))


def recent_only(posts: DataFrame, time: str, window: str = "1 hour", now: Column | None = None) -> DataFrame:
    """Posts of the last hour, as an hourly collection sees them."""
    now = F.current_timestamp() if now is None else now
    return posts.filter(F.col(time) >= now - F.expr(f"INTERVAL {window}"))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored rows; an absent store is empty."""
    owned = f"{schema}, {JOB_COLUMN} STRING, {BATCH_COLUMN} BIGINT"
    return read_or_empty(spark, path, owned, "parquet")


def store_batch(
    store: str,
    schema: str,
    job: str,
    key: str = KEY,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    order: list[str] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that appends unseen keys.

    Each micro-batch of a job owns one partition folder of the store and
    compares itself with all other folders, so replaying a batch after a failure
    rewrites that folder and changes nothing else.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = (F.col(JOB_COLUMN) == job) & (F.col(BATCH_COLUMN) == batch_id)
        others = read_store(batch.sparkSession, store, schema).filter(~own)
        fresh = unseen_unique(first_per_key(batch, key, order), others, key)
        if transform is not None:
            fresh = transform(fresh)
        folder = f"{store}/{JOB_COLUMN}={job}/{BATCH_COLUMN}={batch_id}"
        fresh.write.mode("overwrite").parquet(folder)

    return write


def ingest(
    posts: DataFrame,
    store: str,
    schema: str,
    checkpoint: str,
    key: str = KEY,
    time: str | None = None,
    lateness: str = "1 hour",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    order: list[str] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Start the job: drop repeats within the watermark, then append unseen keys.

    The watermark bounds the state of the first step; the store comparison
    covers repeats that arrive later than that. The job is named after its
    checkpoint, which numbers the batches.
    """
    if time is not None:
        posts = posts.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    job = hashlib.md5(checkpoint.encode()).hexdigest()
    sink = store_batch(store, schema, job, key, transform, order)
    writer = posts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=lateness)
    return writer.start()
