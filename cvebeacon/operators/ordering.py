"""Global order without a single-task window.

Rows are cut into ordered buckets, a small per-bucket table carries the totals
of the buckets before it, and the window runs inside each bucket only.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.session import materialize

# 16**4 buckets: the per-bucket table has at most 65 536 rows and is broadcast.
HASH_DIGITS = 4
RANGE_BUCKETS = 1000


def _exclusive_totals(
    sums: DataFrame, order: str, names: list[str], keep: list[str] | None = None
) -> DataFrame:
    """Totals of the earlier buckets and of all buckets; ``sums`` is one row per bucket."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return sums.select(
        F.col(order),
        *(keep or []),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in names],
        *[F.sum(n).over(everything).alias(f"total_{n}") for n in names],
    )


def shuffle_hash(keys: list[str], seed: int) -> Column:
    """Pseudo-random but repeatable sort value of a row key."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def shuffled_index(
    df: DataFrame,
    keys: list[str],
    seed: int,
    by: list[str] | None = None,
    index: str = "row_index",
    total: str = "row_total",
) -> DataFrame:
    """0-based position of every row in a repeatable random order.

    ``keys`` identify a row. With ``by`` the order restarts in every group of a
    low-cardinality column. The leading hex digits of the hash are evenly
    spread, so buckets stay even for any key distribution.
    """
    by = by or []
    hashed = df.withColumn("__hash", shuffle_hash(keys, seed)).withColumn(
        "__bucket", F.substring("__hash", 1, HASH_DIGITS)
    )
    sums = hashed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(group).alias(total),
    )
    if by:
        # NULL-safe on the group columns, which may be missing.
        renamed = offsets.withColumnsRenamed({c: f"__{c}" for c in by})
        same = hashed["__bucket"] == renamed["__bucket"]
        for c in by:
            same = same & hashed[c].eqNullSafe(renamed[f"__{c}"])
        placed = hashed.join(F.broadcast(renamed), same).drop(
            renamed["__bucket"], *[f"__{c}" for c in by]
        )
    else:
        placed = hashed.join(F.broadcast(offsets), "__bucket")
    inside = Window.partitionBy(*by, "__bucket").orderBy("__hash", *keys)
    return placed.withColumn(
        index, F.col("__before") + F.row_number().over(inside) - 1
    ).drop("__hash", "__bucket", "__before")


def first_fraction(
    df: DataFrame, keys: list[str], seed: int, fraction: float, among: Column | None = None
) -> Column:
    """Condition for the first ceil(fraction * n) rows in the random order of ``keys``.

    ``among`` restricts the n rows that count. Only the hash at the cut is
    looked up, from counts per hash prefix and a ranking inside one prefix, so
    the rows themselves are flagged where they are, without a shuffle.
    """
    hashed = (df if among is None else df.filter(among)).select(
        shuffle_hash(keys, seed).alias("__hash")
    ).withColumn("__bucket", F.substring("__hash", 1, HASH_DIGITS))
    sums = hashed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.ceil(F.col("total_n").cast("double") * F.lit(float(fraction)))
    holder = (
        _exclusive_totals(sums, "__bucket", ["n"], keep=["n"])
        .withColumn("__wanted", wanted - F.col("__before_n"))
        .filter((F.col("__wanted") > 0) & (F.col("__wanted") <= F.col("n")))
        .select("__bucket", "__wanted")
    )
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash"))
    last = (
        hashed.join(F.broadcast(holder), "__bucket")
        .withColumn("__place", place)
        .filter(F.col("__place") == F.col("__wanted"))
        .agg(F.max("__hash").alias("h"))
    )
    inside = F.coalesce(shuffle_hash(keys, seed) <= last.scalar(), F.lit(False))
    return inside if among is None else among & inside


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    descending: bool = False,
    buckets: int = RANGE_BUCKETS,
) -> DataFrame:
    """Add ``running_<c>`` (inclusive) and ``total_<c>`` for each column in ``sums``.

    ``order`` is numeric with one row per value: group equal values first.
    Bucket limits are approximate quantiles of the values, so no bucket holds
    much more than 1/buckets of them; the totals themselves are exact. The
    values are read three times and so go to the shared folder first.
    """
    df = materialize(df.select(order, *sums), "ordered")
    probabilities = [i / buckets for i in range(1, buckets)]
    limits = df.approxQuantile(order, probabilities, 1 / (2 * buckets))
    # A column without finite values still needs one limit.
    finite = sorted({x for x in limits if abs(x) != float("inf")}) or [0.0]
    splits = [-float("inf"), *finite, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="__value", outputCol="__bucket").transform(
        df.withColumn("__value", F.col(order).cast("double"))
    )
    if descending:
        bucketed = bucketed.withColumn("__bucket", -F.col("__bucket"))
    per_bucket = bucketed.groupBy("__bucket").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = F.broadcast(_exclusive_totals(per_bucket, "__bucket", sums))
    direction = F.desc(order) if descending else F.asc(order)
    inside = (
        Window.partitionBy("__bucket")
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = bucketed.join(offsets, "__bucket")
    for c in sums:
        placed = placed.withColumn(
            f"running_{c}", F.col(f"__before_{c}") + F.sum(c).over(inside)
        )
    return placed.drop("__bucket", "__value", *[f"__before_{c}" for c in sums])


def running_totals_by(
    df: DataFrame, group: str, order: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """``running_<c>`` and ``total_<c>`` within each group, groups of any size.

    One row per (group, order) value. Ranges of (group, order) are the pieces of
    a group; each piece is summed in order and starts from the totals of the
    pieces before it.
    """
    direction = F.desc(order) if descending else F.asc(order)
    ranged = df.select(group, order, *sums).repartitionByRange(F.col(group), direction)
    pieces = materialize(ranged.withColumn("__piece", F.spark_partition_id()), "pieces")
    per_piece = pieces.groupBy(group, "__piece").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.partitionBy(group)
    before = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        group,
        "__piece",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy(group, "__piece").orderBy(direction).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = pieces.join(offsets, [group, "__piece"])
    for c in sums:
        placed = placed.withColumn(f"running_{c}", F.col(f"__before_{c}") + F.sum(c).over(inside))
    return placed.drop("__piece", *[f"__before_{c}" for c in sums])
