"""Comment threads of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.functions.text import trim_space
from cvebeacon.operators.skew import lookup_join

MAX_LEVEL = 2


def _step(comments: DataFrame) -> Column:
    """A struct that sorts siblings: higher score first, missing scores last, then smaller id.

    Whole numbers are turned round bit by bit, which no value overflows.
    """
    score = F.col("score")
    whole = comments.schema["score"].dataType.typeName() in ("byte", "short", "integer", "long")
    down = F.bitwise_not(score) if whole else -score
    return F.struct(score.isNull().alias("unscored"), down.alias("down"), F.col("comment"))


def top_thread(comments: DataFrame, max_level: int = MAX_LEVEL) -> DataFrame:
    """The best-ranked top-level comment of every post and its replies.

    ``comments`` has one row per (post, comment) with ``parent`` (NULL for a
    top-level comment), ids of any type that sorts, a numeric ``score``, ``author``
    and ``text``. ``path`` is an array with a step per level; ordering a post's
    rows by it gives the depth-first order.
    """
    ranked = comments.select("post", "parent", "comment", _step(comments).alias("step"))
    first = ranked.filter(F.col("parent").isNull()).groupBy("post").agg(F.min("step").alias("step"))
    # Only (post, comment, path) climbs the levels; texts join once at the end.
    level = first.select("post", "step.comment", F.lit(0).alias("level"), F.array("step").alias("path"))
    replies = ranked.filter(F.col("parent").isNotNull())
    found = level
    for depth in range(1, max_level + 1):
        parents = level.select("post", F.col("comment").alias("parent"), "path")
        level = lookup_join(replies, parents, ["post", "parent"], "inner").select(
            "post",
            "comment",
            F.lit(depth).alias("level"),
            F.array_append("path", F.col("step")).alias("path"),
        )
        found = found.unionByName(level)
    return comments.join(found, ["post", "comment"]).select(
        "post", "comment", "level", "path", "score", "author", trim_space(F.col("text")).alias("text")
    )
