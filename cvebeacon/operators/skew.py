"""Lookup joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000
#: Keys the sketch of heavy keys tracks; its counts are off by at most about 2/this of the rows.
SKETCH_KEYS = 20_000
#: Most pieces of one key.
MOST_PIECES = 1024


def key_counts(facts: DataFrame, on: list[str]) -> DataFrame:
    """Rows per key, combined on the map side before the shuffle."""
    return facts.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))


def heavy_keys(counts: DataFrame, on: list[str], limit: int = HEAVY_KEYS) -> DataFrame:
    """The ``limit`` keys with the most rows.

    Any key left out holds at most 1/(limit + 1) of all rows, so the remainder
    shuffles evenly, and the result is small enough to broadcast whatever the
    table size.
    """
    return counts.orderBy(F.desc("__rows"), *on).limit(limit).select(*on)


def _pieces(rows: Column, total: Column, partitions: int) -> Column:
    """Pieces of a key: two for each fair share of a partition it holds, one below half a share."""
    wanted = F.ceil(rows * (2.0 * partitions) / F.greatest(total, F.lit(1)))
    return F.greatest(F.least(wanted, F.lit(MOST_PIECES)), F.lit(1)).cast("int")


def _sketched(facts: DataFrame, key: Column, limit: int, partitions: int) -> DataFrame:
    """(__lj_key, __lj_pieces) of keys that need more than one piece, from a sketch over the key columns alone."""
    top = facts.select(key.alias("__lj_key")).agg(
        F.expr(f"approx_top_k(__lj_key, {limit}, {max(SKETCH_KEYS, limit)})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    each = top.select("total", F.inline("top")).select(
        F.col("item").alias("__lj_key"), _pieces(F.col("count"), F.col("total"), partitions).alias("__lj_pieces")
    )
    return each.filter("__lj_pieces > 1")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int = HEAVY_KEYS,
    weight: str | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dim``, which has one row per key, in one pass over ``facts``.

    The rows of a heavy key are dealt over several pieces of it, and its one row
    of ``dim`` is repeated for each piece, so no task gets much more than its
    share. A sketch over the key columns names the heavy keys (``limit`` at most);
    a key it overlooks is joined like the others. Fewer keys than twice the
    partitions can be heavy, so their list is broadcast.

    A row's piece follows from its values and its input partition: a task that
    runs again deals its rows the same way, and equal rows are dealt apart.

    ``weight`` names a column of ``dim`` that already holds the rows per key; it
    then covers every key of ``facts``, NULLs included, and saves the sketch; give
    it a stored ``dim``, which is summed when the function is called.
    Without it NULL keys match nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported lookup join: {how}")
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in dim.columns if c not in (*on, weight)]

    def key(df: DataFrame) -> Column:
        # The literal keeps a NULL key apart from an empty list of columns.
        return F.xxhash64(F.lit(7), *[df[c].cast(dim.schema[c].dataType) for c in on])

    if weight is None:
        heavy = F.broadcast(_sketched(facts, key(facts), limit, partitions))
        spread = dim.select(*on, *values, key(dim).alias("__lj_key")).join(heavy, "__lj_key", "left")
    else:
        # One number of a stored table, so the plan of the join has no single-task stage.
        total = F.lit(dim.agg(F.sum(weight)).first()[0] or 0)
        spread = dim.select(
            *on, *values, key(dim).alias("__lj_key"), _pieces(F.col(weight), total, partitions).alias("__lj_pieces")
        )
        heavy = F.broadcast(spread.filter("__lj_pieces > 1").select("__lj_key", "__lj_pieces"))
    numbers = F.sequence(F.lit(0), F.coalesce("__lj_pieces", F.lit(1)) - 1)
    # Fresh names: ``dim`` may be made of ``facts``.
    spread = spread.select(
        *[F.col(c).alias(f"__lj_key_{i}") for i, c in enumerate(on)],
        *[F.col(c).alias(f"__lj_value_{i}") for i, c in enumerate(values)],
        F.explode(numbers).alias("__lj_of"),
    )
    plain = [c for c, kind in facts.dtypes if "map<" not in kind]
    dealt = F.pmod(F.xxhash64(*plain) + F.hash(F.spark_partition_id()), F.col("__lj_pieces")).cast("int")
    marked = facts.withColumn("__lj_key", key(facts)).join(heavy, "__lj_key", "left")
    marked = marked.withColumn("__lj_piece", F.when(F.col("__lj_pieces") > 1, dealt).otherwise(0))
    same = [
        F.col(c).eqNullSafe(F.col(f"__lj_key_{i}")) if weight is not None else F.col(c) == F.col(f"__lj_key_{i}")
        for i, c in enumerate(on)
    ]
    matches = reduce(lambda a, b: a & b, same) & (F.col("__lj_piece") == F.col("__lj_of"))
    found = [F.col(f"__lj_value_{i}").alias(c) for i, c in enumerate(values)]
    return marked.join(spread, matches, how).select(*facts.columns, *found)
