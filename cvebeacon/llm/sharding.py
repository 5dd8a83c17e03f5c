"""Shards of near equal bytes: sampled splitters over range-partitioned keys.

Method: rows are ordered by a hash of their text, so equal texts lie together. A
sample that takes each key with a chance proportional to its bytes gives the
quantile boundaries of the ranges. A range needs splitting only where one text's
copies outweigh a part of a shard: such a text is subdivided by a hash of the
document id. Positions in bytes follow from range totals and a running sum inside
each range, and the position decides the shard. Only DataFrame functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.llm.common import scratch


@dataclass(frozen=True)
class Sharding:
    """``whole``: copies of one text stay together up to this part of a shard."""

    shards: int = 24
    whole: float = 0.05
    ranges: int = 240
    range_rows: int = 2_000_000
    samples_per_range: int = 200


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _range_of(key: str, bounds: list[int]) -> Column:
    """The number of boundaries at or below the key, by halving."""

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < F.lit(bounds[middle]), halve(low, middle)).otherwise(
            halve(middle + 1, high)
        )

    # Two levels keep each generated expression small.
    step = 16
    coarse = bounds[step - 1 :: step]
    branch = F
    for i, bound in enumerate(coarse):
        branch = branch.when(F.col(key) < F.lit(bound), halve(i * step, (i + 1) * step - 1))
    last = halve(len(coarse) * step, len(bounds))
    return branch.otherwise(last) if coarse else last


def shard_documents(
    docs: DataFrame, how: Sharding = Sharding(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shard sizes differ by at most the larger of ``whole``
    of a shard and the longest document. Null and empty texts are one group of
    copies; rows without id or with repeated ids are placed like any other. Extra
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    with scratch(spark, "shards") as work:
        rows = work.table(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                text_size(text_col).alias("size"),
                F.crc32(text.cast("binary")).alias("text_crc32"),
                F.xxhash64(text).alias("key"),
            ),
            "rows",
        )
        groups = work.table(
            rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups"
        )
        total, keys = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
        target = max(total / how.shards, 1)
        ranges = max(how.ranges, -(-keys // how.range_rows))
        chance = F.col("bytes") * F.lit(float(ranges * how.samples_per_range) / max(total, 1))
        drawn = F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
        quantiles = [i / ranges for i in range(1, ranges)]
        found = groups.where(drawn < chance).agg(F.percentile_approx("key", quantiles)).first()[0]
        bounds = sorted(set(found or []))
        heavy = F.col("bytes") > F.lit(how.whole * target)
        part = F.lit(max(target * how.whole, 1.0))
        placed = work.table(
            groups.select(
                "key",
                "bytes",
                _range_of("key", bounds).cast("long").alias("range"),
                F.when(heavy, F.ceil(F.col("bytes") / part)).otherwise(0).alias("pieces"),
            ),
            "placed",
        )
        # No more than shards / whole texts are heavy, whatever the input.
        split = placed.where("pieces > 0").select("key", "pieces", F.col("range").alias("heavy_range"))
        pieces = rows.join(F.broadcast(split), "key").select(
            "doc_id",
            "size",
            "text_crc32",
            "key",
            F.col("heavy_range").alias("range"),
            (F.pmod(F.xxhash64("doc_id"), F.col("pieces")) + 1).alias("piece"),
        )
        pieces = work.table(pieces, "pieces")
        light = placed.where("pieces = 0").select("key", "bytes", "range")
        in_range = Window.partitionBy("range").orderBy("key")
        units = light.withColumn("before", F.sum("bytes").over(in_range) - F.col("bytes"))
        in_piece = Window.partitionBy("key", "piece").orderBy("doc_id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        fragments = pieces.withColumn("before", F.sum("size").over(in_piece) - F.col("size"))
        # Ranges first, each followed by the pieces of its heavy texts: a small table.
        totals = (
            light.groupBy("range")
            .agg(F.sum("bytes").alias("bytes"))
            .select("range", F.lit(0).cast("long").alias("owner"), F.lit(0).cast("long").alias("piece"), "bytes")
            .unionByName(
                pieces.groupBy("range", F.col("key").alias("owner"), "piece").agg(F.sum("size").alias("bytes"))
            )
        )
        order = Window.orderBy("range", (F.col("piece") > 0), "owner", "piece")
        totals = work.table(
            totals.select(
                "*",
                (F.sum("bytes").over(order) - F.col("bytes")).alias("start"),
                F.row_number().over(order).alias("box"),
            ).drop("bytes"),
            "totals",
        )
        calm = totals.where("piece = 0").select("range", "start", "box")
        hot = totals.where("piece > 0").select(F.col("owner").alias("key"), "piece", "start", "box")

        def shard(weight: str) -> Column:
            middle = F.col("start") + F.col("before") + F.col(weight) / 2
            return F.least(F.floor(middle / F.lit(target)), F.lit(how.shards - 1)).cast("int").alias("shard")

        units = work.table(
            units.join(F.broadcast(calm), "range").select("key", "box", shard("bytes")), "units"
        )
        whole = rows.join(F.broadcast(split.select("key")), "key", "left_anti").join(units, "key")
        cut = fragments.join(F.broadcast(hot), ["key", "piece"]).select("*", shard("size"))
        columns = ["doc_id", "size", "text_crc32", "key", "box", "shard"]
        both = work.table(whole.select(columns).unionByName(cut.select(columns)), "both")
        counts = both.groupBy("box", "shard").agg(F.count("*").alias("n"))
        by_shard = Window.partitionBy("shard").orderBy("box")
        counts = counts.select("box", "shard", (F.sum("n").over(by_shard) - F.col("n")).alias("first"))
        inside = Window.partitionBy("box", "shard").orderBy("key", "doc_id")
        result = both.withColumn("at", F.row_number().over(inside) - 1).join(counts, ["box", "shard"])
        result = result.select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
        return work.table(result, "result", keep=True)
