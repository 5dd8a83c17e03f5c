"""Token windows, encoders, pooling and the feature vector."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvebeacon.functions.text import SPACE, null_to_empty
from cvebeacon.operators.skew import lookup_join
from cvebeacon.sources.files import read_or_empty

# ---- tokens ---------------------------------------------------------------


def whitespace_tokens(text: Column) -> Column:
    """Default tokenizer; a missing or blank text has no tokens."""
    return F.filter(F.split(null_to_empty(text), f"(?U){SPACE}+"), lambda t: t != "")


def token_windows(tokens: Column, window: int, stride: int) -> Column:
    """Slices of ``window`` tokens every ``stride``, short tails kept.

    A text without tokens has one empty slice.
    """
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(stride))
    slices = F.transform(starts, lambda i: F.slice(tokens, i + 1, window))
    return F.when(F.size(tokens) > 0, slices).otherwise(F.array(F.slice(tokens, 1, window)))


def overlapping_windows(tokens: Column, max_length: int) -> Column:
    """Half-overlapping windows that leave room for a start and an end token."""
    window = max_length - 2
    return token_windows(tokens, window, max(1, window // 2))


def wrap_window(window: Column, start: str = "<s>", end: str = "</s>") -> Column:
    return F.concat(F.array(F.lit(start)), window, F.array(F.lit(end)))


def token_chunks(tokens: Column, max_length: int) -> Column:
    """Adjacent chunks; a text without tokens has none."""
    chunks = token_windows(tokens, max_length, max_length)
    return F.when(F.size(tokens) > 0, chunks).otherwise(F.slice(chunks, 1, 0))


def token_route(tokens: Column, limit: int) -> Column:
    return F.when(F.size(tokens) <= limit, "short").otherwise("long")


# ---- vectors --------------------------------------------------------------


def as_vector(c: Column | str) -> Column:
    return array_to_vector(c)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Mean vector per key; partial sums combine before the shuffle."""
    return df.groupBy(*keys).agg(Summarizer.mean(F.col(vector)).alias(out))


def masked_mean(
    df: DataFrame, keys: list[str], vector: str, mask: str, out: str = "vector"
) -> DataFrame:
    """Mean over unmasked rows; a fully masked group gives the zero vector.

    The mask is the summariser's weight. It drops zero-weight rows, so groups
    without any unmasked row are added back.
    """
    means = (
        df.filter(F.col(mask) > 0)
        .groupBy(*keys)
        .agg(Summarizer.mean(F.col(vector), F.col(mask).cast("double")).alias(out))
    )
    groups = df.groupBy(*keys).agg(F.first(vector).alias("__shape"))
    joined = groups.join(means, keys, "left")
    zeros = as_vector(F.transform(vector_to_array("__shape"), lambda x: x * 0.0))
    return joined.select(*keys, F.coalesce(out, zeros).alias(out))


def document_vectors(
    documents: DataFrame, key: str, chunks: DataFrame, vector: str, size: int, out: str = "vector"
) -> DataFrame:
    """Mean of a document's chunk vectors; a document without chunks gets zeros."""
    means = mean_vectors(chunks, [key], vector, out)
    joined = documents.join(means, key, "left")
    return joined.withColumn(out, F.coalesce(out, zero_vector(size)))


def zero_vector(size: int) -> Column:
    """The zero vector as a constant."""
    return as_vector(F.array_repeat(F.lit(0.0), size))


def l2_normalize(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Unit length; the zero vector stays zero."""
    return Normalizer(p=2.0, inputCol=vector, outputCol=out).transform(df)


def flatten_vector(df: DataFrame, vector: str, size: int, prefix: str = "text_emb_") -> DataFrame:
    values = df.withColumn("__values", vector_to_array(vector))
    flat = [F.col("__values")[i].alias(f"{prefix}{i}") for i in range(size)]
    return values.select(*[c for c in df.columns if c != vector], *flat)


# ---- encoders -------------------------------------------------------------

# An encoder takes (frame, text column, output column) and adds a vector column.
Encoder = Callable[[DataFrame, str, str], DataFrame]
_ENCODERS: dict[str, Encoder] = {}


def register_encoder(name: str, encoder: Encoder) -> None:
    _ENCODERS[name] = encoder


def get_encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        raise ValueError(f"unsupported embedding model {name!r}; known: {sorted(_ENCODERS)}")
    return _ENCODERS[name]


def hashing_encoder(size: int = 768) -> Encoder:
    """Unit-length term-frequency vectors by token hash; needs no fitting."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        tokens = df.withColumn("__tokens", whitespace_tokens(F.lower(F.col(text))))
        counted = HashingTF(numFeatures=size, inputCol="__tokens", outputCol="__tf").transform(tokens)
        return l2_normalize(counted, "__tf", out).drop("__tokens", "__tf")

    return encode


def digest_encoder(size: int) -> Encoder:
    """Unit-length token counts by the first byte of the token's MD5; any engine can repeat it."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        def place(token: Column) -> Column:
            return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int") % size

        places = F.transform(whitespace_tokens(F.lower(F.col(text))), place)
        numbers = F.sequence(F.lit(0), F.lit(size - 1))
        placed = df.withColumn("__places", places)
        counts = F.transform(numbers, lambda k: F.size(F.filter("__places", lambda p: p == k)).cast("double"))
        counted = placed.withColumn("__counts", as_vector(counts))
        return l2_normalize(counted, "__counts", out).drop("__places", "__counts")

    return encode


def hybrid_encoder(short: Encoder, long: Encoder, limit: int) -> Encoder:
    """Short texts through one encoder, long texts through another, by token count."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        routed = df.withColumn("__route", token_route(whitespace_tokens(F.col(text)), limit))
        parts = [
            encoder(routed.filter(F.col("__route") == route), text, out)
            for route, encoder in (("short", short), ("long", long))
        ]
        return parts[0].unionByName(parts[1]).drop("__route")

    return encode


def batch_encoder(make_predict: Callable, size: int, batch_size: int = 32) -> Encoder:
    """A user model: ``make_predict`` loads it once per Python worker."""
    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, as_vector(udf(null_to_empty(F.col(text)))))

    return encode


# A model takes the token lists of a batch and gives one vector per list.
Model = Callable[[list[list[str]]], list[list[float]]]


def hybrid_batch_encoder(
    make_short: Callable[[], Model], make_long: Callable[[], Model], limit: int
) -> Encoder:
    """Two models in one pass: the rows of a batch with at most ``limit`` tokens go to the first.

    Both models are loaded once per Python worker; each sees its rows of a batch
    at once, and the vectors come back in the order of the rows.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = make_short(), make_long()
        for batch in batches:
            tokens = [list(t) for t in batch]
            found: list = [None] * len(tokens)
            for model, long in zip(models, (False, True), strict=True):
                at = [i for i, t in enumerate(tokens) if (len(t) > limit) is long]
                if at:
                    for i, vector in zip(at, model([tokens[i] for i in at]), strict=True):
                        found[i] = vector
            yield pd.Series(found)

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        tokens = whitespace_tokens(F.lower(F.col(text)))
        return df.withColumn(out, as_vector(encode_batches(tokens)))

    return encode


def digest_model(size: int) -> Model:
    """The digest encoder as a model on token lists."""

    def predict(lists: list[list[str]]) -> list[list[float]]:
        found = []
        for tokens in lists:
            counts = np.zeros(size)
            for token, n in Counter(tokens).items():
                counts[hashlib.md5(token.encode()).digest()[0] % size] += n
            norm = np.sqrt((counts * counts).sum())
            found.append((counts / norm if norm else counts).tolist())
        return found

    return predict


def chunk_mean_model(model: Model, chunk: int) -> Model:
    """The mean of a model's vectors of adjacent chunks; for texts longer than one chunk."""

    def predict(lists: list[list[str]]) -> list[list[float]]:
        cut = [[tokens[i : i + chunk] for i in range(0, max(len(tokens), 1), chunk)] for tokens in lists]
        vectors = iter(model([part for parts in cut for part in parts]))
        return [np.mean([next(vectors) for _ in parts], axis=0).tolist() for parts in cut]

    return predict


def chunked_encoder(encoder: Encoder, max_length: int, size: int, key: str) -> Encoder:
    """Encode half-overlapping windows and average them per row ``key``."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        windows = overlapping_windows(whitespace_tokens(F.col(text)), max_length)
        chunks = df.select(key, F.explode(windows).alias("__window")).select(
            key, F.concat_ws(" ", "__window").alias("__chunk")
        )
        encoded = encoder(chunks, "__chunk", "__vector").select(key, "__vector")
        return document_vectors(df, key, encoded, "__vector", size, out)

    return encode


register_encoder("hashing", hashing_encoder())
register_encoder("digest", digest_encoder(8))
register_encoder(
    "hybrid-digest",
    hybrid_batch_encoder(lambda: digest_model(8), lambda: chunk_mean_model(digest_model(8), 382), 382),
)
register_encoder("hybrid", hybrid_encoder(hashing_encoder(), hashing_encoder(), 382))


# ---- embedding cache ------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.sha2(null_to_empty(text), 256)


def cache_misses(texts: DataFrame, text: str, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts without a stored vector: (model, text_hash, text)."""
    wanted = (
        texts.select(text_key(F.col(text)).alias("text_hash"), null_to_empty(F.col(text)).alias("text"))
        .groupBy("text_hash")
        .agg(F.first("text").alias("text"))
    )
    have = cache.filter(F.col("model") == model).select("text_hash")
    return wanted.join(have, "text_hash", "left_anti").select(
        F.lit(model).alias("model"), "text_hash", "text"
    )


def load_or_compute(
    texts: DataFrame, text: str, model: str, cache_path: str, out: str = "vector"
) -> DataFrame:
    """Add a vector column, computing and storing only what the cache lacks.

    The cache is a Parquet table keyed by (model, text hash); an edited text has
    another hash, so stale vectors cannot be returned.
    """
    schema = "model STRING, text_hash STRING, vector ARRAY<DOUBLE>"
    spark = texts.sparkSession
    encoder = get_encoder(model)
    misses = cache_misses(texts, text, read_or_empty(spark, cache_path, schema, "parquet"), model)
    fresh = encoder(misses, "text", "__vector").select(
        "model", "text_hash", vector_to_array("__vector").alias("vector")
    )
    fresh.write.mode("append").parquet(cache_path)
    stored = (
        spark.read.schema(schema).parquet(cache_path)
        .filter(F.col("model") == model)
        .groupBy("text_hash").agg(F.first("vector").alias(out))
    )
    keyed = texts.withColumn("text_hash", text_key(F.col(text)))
    found = lookup_join(keyed, stored, ["text_hash"], "inner")
    return found.withColumn(out, as_vector(out)).drop("text_hash")
