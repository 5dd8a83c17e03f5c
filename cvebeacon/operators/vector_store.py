"""Vectors of texts, stored once per encoder and text and read back by hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.functions.text import null_to_empty
from cvebeacon.operators.skew import lookup_join
from cvebeacon.operators.vectors import get_encoder, text_key
from cvebeacon.session import materialize
from cvebeacon.sources.files import read_or_empty

_SCHEMA = "text_hash STRING, vector ARRAY<DOUBLE>, model STRING, bucket STRING"


@dataclass(frozen=True)
class VectorStore:
    """A Parquet table of (model, bucket, text_hash, vector) at ``path``.

    A bucket is the first hex digit of the hash, so buckets are even, and rows
    are sorted by hash inside their files. A read names the encoder and the
    buckets of the hashes it asks for; other folders are never opened.
    """

    path: str
    model: str

    def _stored(self, asked: DataFrame) -> DataFrame:
        """Rows of the store in the buckets of the asked hashes, each hash once."""
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # 16 at most
        rows = read_or_empty(asked.sparkSession, self.path, _SCHEMA, "parquet")
        mine = rows.filter((F.col("model") == self.model) & F.col("bucket").isin(buckets))
        known = mine.join(asked.select("bucket", "text_hash"), ["bucket", "text_hash"], "left_semi")
        # Two writers may have stored a text at the same time.
        return known.groupBy("text_hash").agg(F.first("vector").alias("vector"))

    def asked(self, texts: DataFrame, text: str) -> DataFrame:
        """(bucket, text_hash, text, rows) of the distinct texts; equal texts combine before the shuffle."""
        keyed = texts.select(null_to_empty(F.col(text)).alias("text"))
        return (
            keyed.groupBy(text_key(F.col("text")).alias("text_hash"))
            .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))
            .withColumn("bucket", F.substring("text_hash", 1, 1))
        )

    def fill(self, asked: DataFrame) -> int:
        """Encode and store the asked texts the store lacks; the number encoded."""
        stored = self._stored(asked).select("text_hash")
        misses = asked.join(stored, "text_hash", "left_anti").select("bucket", "text_hash", "text")
        # Stored first: a slow encoder that loses an executor does not ask the store again.
        misses = materialize(misses, "misses")
        number = misses.count()
        if number == 0:
            return 0
        encoded = get_encoder(self.model)(misses, "text", "__vector")
        fresh = encoded.select(
            "text_hash", vector_to_array("__vector").alias("vector"), F.lit(self.model).alias("model"), "bucket"
        )
        # Split by hash too: a bucket of a large load is not one task.
        placed = fresh.repartition("bucket", F.substring("text_hash", 2, 1))
        placed.sortWithinPartitions("bucket", "text_hash").write.mode("append").partitionBy(
            "model", "bucket"
        ).parquet(self.path)
        return number

    def attach(self, df: DataFrame, text: str, out: str, where: Column | None = None) -> DataFrame:
        """Add the vector of ``text``; NULL where ``where`` does not hold, nothing is encoded there.

        The distinct texts, their rows and vectors are stored first; a text that
        many rows share meets them as a broadcast row.
        """
        wanted = df if where is None else df.filter(where)
        asked = materialize(self.asked(wanted, text), "asked")
        self.fill(asked)
        found = asked.select("bucket", "text_hash", "rows")
        vectors = found.join(self._stored(found), "text_hash").select(
            F.col("text_hash").alias("__hash"), F.col("vector").alias(out), "rows"
        )
        # Rows that ask for nothing have no hash, and no row of this side has none.
        hashed = text_key(F.col(text)) if where is None else F.when(where, text_key(F.col(text)))
        joined = lookup_join(
            df.withColumn("__hash", hashed), materialize(vectors, "vectors"), ["__hash"], "left", weight="rows"
        )
        vector = F.when(F.col(out).isNotNull(), array_to_vector(out))
        return joined.withColumn(out, vector).drop("__hash")
