"""Model features: severity score, one-hot blocks, per-source text vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.functions.cve import mention_count
from cvebeacon.functions.text import null_to_empty
from cvebeacon.functions.time import iso_date
from cvebeacon.operators.enrich import one_score_per_day
from cvebeacon.operators.ordering import running_totals_by
from cvebeacon.operators.skew import lookup_join
from cvebeacon.operators.vector_store import VectorStore
from cvebeacon.operators.vectors import get_encoder, zero_vector
from cvebeacon.schemas import CVSS_CATEGORICALS
from cvebeacon.session import materialize

# Sources a model can switch on, in block order.
SOURCES = ("mastodon", "reddit", "exploitdb", "bleepingcomputer", "telegram", "hackernews")

# Column prefix of each one-hot block.
ONE_HOT_PREFIX = {
    "attack_vector": "av",
    "attack_complexity": "ac",
    "privileges_required": "pr",
    "user_interaction": "ui",
    "scope": "scope",
    "confidentiality_impact": "ci",
    "integrity_impact": "ii",
    "availability_impact": "ai",
}
MAX_CATEGORIES = 1000
#: Most values of a column whose list is broadcast.
BROADCAST_VALUES = 100_000


@dataclass(frozen=True)
class FeatureConfig:
    """Which sources and feature blocks a model sees."""

    sources: tuple[str, ...] = SOURCES
    text: bool = True
    description: bool = True
    cvss_score: bool = True
    cvss_categorical: bool = True
    encoder: str = "hashing"
    vector_size: int = 768
    all_sources: tuple[str, ...] = field(default=SOURCES)
    # Folder of a vector store; without it every call encodes its rows.
    store: str | None = None

    @property
    def per_source_blocks(self) -> bool:
        """Some but not all sources are on."""
        return 0 < len(self.sources) < len(self.all_sources)


def score_feature(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) / 10


def mentions_source(source: Column, name: str) -> Column:
    """Case-insensitive substring test: a file stem and a plain name both match."""
    return F.coalesce(F.contains(F.lower(source), F.lit(name.lower())), F.lit(False))


def source_one_hot(df: DataFrame, names: tuple[str, ...] = SOURCES) -> DataFrame:
    return df.withColumns(
        {f"source_{n}": mentions_source(F.col("source"), n).cast("double") for n in names}
    )


def observed_categories(
    df: DataFrame, columns: list[str] = CVSS_CATEGORICALS, limit: int = MAX_CATEGORIES
) -> dict[str, list[str]]:
    """Sorted values per column, missing as ``NONE``, from one distributed pass.

    For named 0/1 columns, of which there can only be so many: the distinct pairs
    are counted against ``limit`` before they reach the driver. ``category_table``
    has no limit.
    """
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("NONE")).alias("value"))
        for c in columns
    ]
    seen = df.select(F.inline(F.array(*pairs))).distinct().limit(limit + 1).collect()
    if len(seen) > limit:
        raise ValueError(f"more than {limit} categories; not categorical columns")
    return {c: sorted(r["value"] for r in seen if r["column"] == c) for c in columns}


def cvss_one_hot(
    df: DataFrame, categories: dict[str, list[str]] | None = None
) -> tuple[DataFrame, list[str]]:
    """0/1 columns ``av_NETWORK`` .. per observed category, in sorted order.

    Pass ``categories`` to keep the same columns on another split or experiment.
    """
    categories = categories or observed_categories(df)
    columns = {
        f"{ONE_HOT_PREFIX[c]}_{v}": (F.coalesce(F.col(c), F.lit("NONE")) == v).cast("double")
        for c, values in categories.items()
        for v in values
    }
    return df.withColumns(columns), list(columns)


def category_table(df: DataFrame, columns: list[str] = CVSS_CATEGORICALS) -> DataFrame:
    """(column, value, position): the sorted values of each column numbered from 0, missing as ``NONE``.

    Any number of values: pairs combine where they are read, are numbered in
    ranges and stored. The places of ``columns`` in the list is their order.
    """
    pairs = [
        F.struct(F.lit(i).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("NONE")).alias("value"))
        for i, c in enumerate(columns)
    ]
    distinct = df.select(F.inline(F.array(*pairs))).distinct().withColumn("one", F.lit(1).cast("long"))
    numbered = running_totals_by(distinct, "column", "value", ["one"])
    names = F.array(*map(F.lit, columns))[F.col("column")]
    return materialize(
        numbered.select(
            names.alias("column"), "value", (F.col("running_one") - 1).alias("position"), F.col("total_one").alias("size")
        ),
        "categories",
    )


def categories_one_hot(
    df: DataFrame, table: DataFrame, columns: list[str] = CVSS_CATEGORICALS
) -> tuple[DataFrame, list[str]]:
    """A sparse 0/1 vector column per category column, as wide as the table has values of it.

    A value that the table lacks is an error when its row is computed. Lists up
    to ``BROADCAST_VALUES`` are broadcast, longer ones joined like any lookup.
    """
    sizes = {r["column"]: r for r in table.groupBy("column").agg(F.max("size").alias("n")).collect()}
    if not sizes:
        return df, []  # no rows, no values
    for c in columns:
        part = table.filter(F.col("column") == c).select(
            F.col("value").alias(f"__{c}"), F.col("position").cast("double").alias(f"__{c}_index")
        )
        named = df.withColumn(f"__{c}", F.coalesce(F.col(c).cast("string"), F.lit("NONE")))
        if sizes[c]["n"] <= BROADCAST_VALUES:
            df = named.join(F.broadcast(part), f"__{c}", "left").drop(f"__{c}")
        else:
            df = lookup_join(named, part, [f"__{c}"]).drop(f"__{c}")
    for c in columns:
        df = df.withColumn(f"__{c}_vector", one_hot(sizes[c]["n"])(F.col(f"__{c}_index")))
    return df.drop(*[f"__{c}_index" for c in columns]), [f"__{c}_vector" for c in columns]


# ---- vectors ----------------------------------------------------------------

# Spark ML names every position of a vector in the driver, so its encoder and
# assembler end where a vector is as wide as a table is long. These name none.


def _vectors(sparse: np.ndarray, sizes: np.ndarray, counts: np.ndarray, at: np.ndarray, values: np.ndarray) -> pa.Array:
    """Vectors of ``counts`` values each; the dense ones' positions are left out."""
    listed = np.repeat(sparse, counts)
    ends = [np.concatenate([[0], np.cumsum(n)]).astype(np.int32) for n in (np.where(sparse, counts, 0), counts)]
    return pa.StructArray.from_arrays(
        [
            pa.array(np.where(sparse, 0, 1).astype(np.int8)),
            pa.array(sizes.astype(np.int32), mask=~sparse),
            pa.ListArray.from_arrays(ends[0], pa.array(at[listed].astype(np.int32)), mask=pa.array(~sparse)),
            pa.ListArray.from_arrays(ends[1], pa.array(values)),
        ],
        names=["type", "size", "indices", "values"],
    )


def one_hot(width: int) -> Callable[[Column], Column]:
    """A sparse vector of ``width`` with a 1 at the given position; no position or one outside is an error."""

    @F.arrow_udf(VectorUDT())
    def encode(position: pa.Array) -> pa.Array:
        if position.null_count:
            raise ValueError("a value that the category table lacks")
        at = position.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(at) and not 0 <= at.min() <= at.max() < width:
            raise ValueError(f"a position outside of {width} values")
        ones = np.ones(len(at), np.int64)
        return _vectors(ones > 0, ones * width, ones, at, ones.astype(float))

    return encode


def _numbers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column of numbers, as ``_entries`` has it; missing ones become NaN, as the assembler's "keep" has it."""
    n = len(cells)
    values = cells.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    return np.zeros(n, bool), np.ones(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64), values


def _entries(
    kind: pa.Array, size: pa.Array, indices: pa.Array, lists: pa.Array
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse or not, width and number of listed values of each vector; places and values of all."""
    if kind.null_count:
        raise ValueError("a vector is missing")
    sparse = kind.to_numpy(zero_copy_only=False) == 0
    counts = np.asarray(lists.value_lengths(), np.int64)
    sizes = np.where(sparse, np.asarray(size, np.int64), counts)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    at[np.repeat(sparse, counts)] = indices.flatten().to_numpy(zero_copy_only=False)
    return sparse, sizes, counts, at, values


def joined_vectors(df: DataFrame, inputs: list[str], out: str) -> DataFrame:
    """Add one vector of the numbers and vectors of ``inputs``, left to right, in the smaller of both forms.

    Stays sparse if all inputs are sparse vectors. Vectors go to Python field by
    field: as structs with missing indices their size is taken anew for each row.
    """
    fields: list[Column] = []
    starts = []
    for c in inputs:
        starts.append((len(fields), isinstance(df.schema[c].dataType, VectorUDT)))
        if starts[-1][1]:
            v = F.unwrap_udt(c)
            fields += [
                v["type"], F.coalesce(v["size"], F.lit(0)),
                F.coalesce(v["indices"], F.array().cast("array<int>")), v["values"],
            ]
        else:
            fields.append(F.col(c).cast("double"))

    @F.arrow_udf(VectorUDT())
    def join(*cells: pa.Array) -> pa.Array:
        parts = [_entries(*cells[a : a + 4]) if vector else _numbers(cells[a]) for a, vector in starts]
        n = len(cells[0])
        width = np.zeros(n, np.int64)
        row, at, values = [], [], []
        for _, sizes, counts, own, listed in parts:
            row.append(np.repeat(np.arange(n), counts))
            at.append(own + np.repeat(width, counts))
            values.append(listed)
            width += sizes
        if n and width.max() >= 2**31:
            raise ValueError(f"{width.max()} positions are too many for a vector")
        row, at, values = map(np.concatenate, (row, at, values))
        order = np.argsort(row, kind="stable")
        row, at, values = row[order], at[order], values[order]
        all_sparse = np.logical_and.reduce([p[0] for p in parts])
        full = (values != 0) | all_sparse[row]
        counts = np.bincount(row[full], minlength=n)
        sparse = all_sparse | (1.5 * (counts + 1) < width)
        # Dense rows are written out; sparse ones keep what is listed.
        filled = np.where(sparse, counts, width)
        first = np.cumsum(filled) - filled
        places, numbers = np.zeros((2, filled.sum()))
        listed = full & sparse[row]
        inside = np.arange(listed.sum()) - np.repeat(
            np.cumsum(np.where(sparse, counts, 0)) - np.where(sparse, counts, 0), np.where(sparse, counts, 0)
        )
        target = first[row[listed]] + inside
        places[target], numbers[target] = at[listed], values[listed]
        dense = ~sparse[row]
        numbers[first[row[dense]] + at[dense]] = values[dense]
        return _vectors(sparse, width, filled, places, numbers)

    return df.withColumn(out, join(*fields))


def _encoded(df: DataFrame, column: str, wanted: Column, config: FeatureConfig) -> DataFrame:
    """Add ``__vector`` for the wanted rows; the others get zeros and meet no encoder."""
    zeros = zero_vector(config.vector_size)
    if config.store is not None:
        store = VectorStore(config.store, config.encoder)
        found = store.attach(df, column, "__vector", wanted)
        return found.withColumn("__vector", F.coalesce("__vector", zeros))
    filled = df.withColumn("__text", null_to_empty(F.col(column)))
    encoded = get_encoder(config.encoder)(filled.filter(wanted), "__text", "__vector")
    rest = filled.filter(~wanted).withColumn("__vector", zeros)
    return encoded.unionByName(rest).drop("__text") if config.per_source_blocks else encoded.drop("__text")


def text_blocks(df: DataFrame, column: str, prefix: str, config: FeatureConfig) -> tuple[DataFrame, list[str]]:
    """One vector for everything, or one block per enabled source.

    Rows outside an enabled source keep zeros in its block; no row is removed.
    """
    if not config.per_source_blocks:
        encoded = _encoded(df, column, F.lit(True), config)
        return encoded.withColumnRenamed("__vector", f"{prefix}_all"), [f"{prefix}_all"]
    zeros = zero_vector(config.vector_size)
    of_source = {n: mentions_source(F.col("source"), n) for n in config.sources}
    encoded = _encoded(df, column, reduce(lambda a, b: a | b, of_source.values()), config)
    blocks = {f"{prefix}_{n}": F.when(c, F.col("__vector")).otherwise(zeros) for n, c in of_source.items()}
    return encoded.withColumns(blocks).drop("__vector"), list(blocks)


def assemble_features(
    df: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    categories: DataFrame | dict[str, list[str]] | None = None,
    out: str = "features",
) -> DataFrame:
    """Blocks left to right: text, description, score, categories, sources.

    ``categories`` keeps the columns of another call: a table of
    ``category_table``, or a short list of values per column.
    """
    inputs: list[str] = []
    result = df
    for enabled, column in ((config.text, "text"), (config.description, "description")):
        if enabled:
            result, blocks = text_blocks(result, column, f"__{column}", config)
            inputs += blocks
    if config.cvss_score:
        result = result.withColumn("__score", score_feature(F.col("cvss_score")))
        inputs.append("__score")
    if config.cvss_categorical:
        if isinstance(categories, dict):
            result, names = cvss_one_hot(result, categories)
        else:
            table = category_table(df) if categories is None else categories
            result, names = categories_one_hot(result, table)
        inputs += names
    if config.sources:
        result = source_one_hot(result, config.sources)
        inputs += [f"source_{n}" for n in config.sources]
    if not inputs:
        raise ValueError("no features selected")
    return joined_vectors(result, inputs, out).select(*df.columns, out)


def feature_rows(entries: DataFrame, history: DataFrame) -> DataFrame:
    """One row per (entry, id) whose exact-day score exists.

    ``entries`` carries ``cves``, ``cve_counts``, ``source`` and ``timestamp``.
    """
    rest = [c for c in entries.columns if c not in ("cves", "cve_counts", "timestamp", "source")]
    rows = entries.select(
        F.explode("cves").alias("cve"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        iso_date(F.col("timestamp"), strict=True).alias("timestamp"),
        "cve_counts",
        *rest,
    )
    rows = rows.withColumn("cve_count", mention_count(F.col("cve_counts"), F.col("cve")))
    rows = rows.withColumn("entry_date", F.col("timestamp")).drop("cve_counts")
    scores = one_score_per_day(history).select(
        "cve",
        F.date_format("date", "yyyy-MM-dd").alias("entry_date"),
        F.col("epss").alias("epss_score"),
    )
    return lookup_join(rows, scores, ["cve", "entry_date"], "inner")
