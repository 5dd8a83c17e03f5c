"""Temperature mixing of sources: tempered shares, realised by block permutations.

Method: a source's weight is its token share to the power alpha, normalised. The
exponent is bisected: the largest that reaches the target entropy (a part of that
of equal shares), but no smaller than the repetition limit allows. The budget is
the least with which no source is cut below one pass, so no document is lost;
the others repeat. Each pass over a source visits its blocks in an order of its
own; the last pass ends where the source's budget does. Only DataFrame functions run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.llm.common import Scratch, scratch


@dataclass(frozen=True)
class Mixing:
    """``entropy`` is a part of the largest possible one, ``repeats`` the most passes."""

    entropy: float = 0.95
    repeats: float = 2.0
    block_rows: int = 2_000
    seed: int = 5


def token_count(text: str = "text") -> Column:
    """Runs of anything but white space; null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def _exponent(sources: DataFrame, how: Mixing) -> float:
    """The exponent by bisection of [0, 1], 32 values at a time, on the source table.

    Entropy falls and repetition falls as the exponent grows: the answer is the
    largest exponent that reaches the entropy, raised to the least one within
    the repetition limit.
    """
    live = sources.where("tokens > 0")
    most, k = live.agg(F.max("tokens"), F.count("*")).first()
    if not k:
        return 1.0

    def probe(low: float, high: float) -> list[tuple]:
        steps = [low + (high - low) * i / 32 for i in range(33)]
        tried = live.withColumn("a", F.explode(F.array(*map(F.lit, steps))))
        tried = tried.withColumn("v", F.pow(F.col("tokens") / F.lit(most), F.col("a")))
        report = tried.groupBy("a").agg(
            (F.log(F.sum("v")) - F.sum(F.col("v") * F.log("v")) / F.sum("v")).alias("h"),
            F.max(F.col("v") * F.lit(most) / F.col("tokens")).alias("r"),
        )
        return sorted((r["a"], r["h"], r["r"]) for r in report.collect())

    found = []
    for rule in (
        lambda h, r: h < how.entropy * math.log(k) - 1e-12,
        lambda h, r: r <= how.repeats,
    ):
        low, high = 0.0, 1.0
        for _ in range(4):
            rows = probe(low, high)
            stop = next((a for a, h, r in rows if rule(h, r)), None)
            if stop is None:
                low = high = rows[-1][0]
                break
            at = [a for a, *_ in rows].index(stop)
            low, high = rows[max(at - 1, 0)][0], stop
            if at == 0:
                break
        found.append(low if not found else high)
    return max(found)


def _plan(work: Scratch, rows: DataFrame, how: Mixing) -> DataFrame:
    """One row per source: src, tokens, n, weight, passes (at least 1)."""
    sources = work.table(
        rows.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources"
    )
    alpha = _exponent(sources, how)
    most = sources.agg(F.max("tokens")).first()[0] or 1
    tempered = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(most), F.lit(alpha)))
    tempered = sources.withColumn("v", tempered.otherwise(0.0))
    norm = tempered.agg(F.sum("v")).first()[0] or 1.0
    passes = F.greatest(F.col("v") * F.lit(most) / F.col("tokens"), F.lit(1.0))
    return work.table(
        tempered.select(
            "src",
            "tokens",
            "n",
            (F.col("v") / F.lit(norm)).alias("weight"),
            F.when(F.col("tokens") > 0, passes).otherwise(1.0).alias("passes"),
        ),
        "plan",
    )


def mix_sources(
    docs: DataFrame,
    how: Mixing = Mixing(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    texts: bool = False,
) -> DataFrame:
    """One row per document and pass: doc_id, source, n_tokens, weight, epoch, position.

    ``position`` is the token offset in the source's stream. Every document is in
    pass 0; a null source is a source of its own; texts without tokens are in
    pass 0 only; repeated rows are drawn one by one, rows without id too. With
    ``texts`` the columns of ``docs`` come back instead, rows repeated as drawn.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(how.seed))
    with scratch(spark, "mixing") as work:
        src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
        rows = work.table(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                src.alias("src"),
                token_count(text_col).alias("tokens"),
                F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
                key.alias("key"),
            ),
            "rows",
        )
        plan = _plan(work, rows, how)
        blocks_of = F.greatest(F.ceil(F.col("n") / how.block_rows), F.lit(1))
        blocked = rows.join(plan.drop("tokens"), "src").withColumn("block", F.pmod("key", blocks_of))
        inside = Window.partitionBy("src", "block").orderBy(F.xxhash64("key"), "doc_id", "tie")
        blocked = work.table(
            blocked.withColumn(
                "before",
                F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"),
            ),
            "blocked",
        )
        blocks = blocked.groupBy("src", "block").agg(F.sum("tokens").alias("size"))
        # A different permutation of the blocks for each pass, of sizes only.
        visits = blocks.join(plan.select("src", "passes", F.col("tokens").alias("whole")), "src").select(
            "*", F.explode(F.sequence(F.lit(0), (F.ceil("passes") - 1).cast("int"))).alias("epoch")
        )
        order = Window.partitionBy("src", "epoch").orderBy(
            F.xxhash64("src", "epoch", "block", F.lit(how.seed)), "block"
        )
        visits = visits.select(
            "src",
            "block",
            "epoch",
            (F.col("epoch") * F.col("whole") + F.sum("size").over(order) - F.col("size")).alias("start"),
            (F.col("passes") * F.col("whole")).alias("limit"),
        )
        drawn = blocked.join(visits, ["src", "block"]).withColumn(
            "position", F.col("start") + F.col("before")
        )
        drawn = drawn.where(
            (F.col("epoch") == 0)
            | ((F.col("tokens") > 0) & (F.col("position") + F.col("tokens") / 2 < F.col("limit")))
        )
        if not texts:
            result = drawn.select(
                "doc_id",
                F.when(F.col("src") != "", F.expr("substr(src, 2)")).alias("source"),
                F.col("tokens").alias("n_tokens"),
                "weight",
                F.col("epoch").cast("int").alias("epoch"),
                F.col("position").cast("long").alias("position"),
            )
            return work.table(result, "result", keep=True)
        again = drawn.where("epoch > 0").groupBy("doc_id", "tie", "src").agg(F.count("*").alias("__drawn"))
        seen = blocked.groupBy("doc_id", "tie", "src").agg(F.count("*").alias("__rows"))
        again = work.table(
            again.join(seen, ["doc_id", "tie", "src"]).select(
                F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("src").alias("__src"),
                F.col("__drawn"), F.col("__rows"),
            ),
            "again",
            keep=True,
        )
        tie = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
        extra = (
            docs.join(
                again,
                docs[id_col].cast("long").eqNullSafe(F.col("__id"))
                & (tie == F.col("__tie"))
                & (src == F.col("__src")),
                "left",
            )
            # Repeated rows share what was drawn of them.
            .withColumn("__times", 1 + F.coalesce(F.floor(F.col("__drawn") / F.col("__rows")), F.lit(0)).cast("int"))
        )
        return extra.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), "__times")).alias("__i")).drop("__i")
