"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cvebeacon.llm import lines, minhash, mixing, packing, quality
from cvebeacon.llm.common import scratch
from cvebeacon.llm.queries import tokenizer_path
from cvebeacon.llm.registry import table
from cvebeacon.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one."""
    ship_package(spark)
    return lines.without_later_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again up to the target weights."""
    ship_package(spark)
    return mixing.mix_sources(docs, texts=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, sources in proportion in every window."""
    ship_package(spark)
    return packing.pack(docs, packing.Packing(tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained classifier is no SQL: tests hold the rows against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark, "pipeline") as work:
        for name, stage in STAGES:
            done = work.table(stage(spark, docs, sf_dir), name, keep=name == STAGES[-1][0])
            docs = done
        return docs
