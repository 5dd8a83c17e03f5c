"""Readers and writers for the file formats the sources come in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvebeacon.sources.checked import read_json_checked

# Source names looked for in a file name, in this order.
KNOWN_SOURCES = ("reddit", "telegram", "mastodon")


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str, multi_line: bool = True
) -> DataFrame:
    """Headed CSV with quoted line breaks and doubled quotes.

    ``multi_line`` files are not split: keep many files rather than one large
    one, or pass False when no field holds a line break.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_json_array(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    lines: bool = False,
    quarantine: str | None = None,
) -> DataFrame:
    """Files that hold one object or an array of objects, one row per object.

    ``lines`` reads files of one object per line instead, as ``write_json``
    leaves them; those are split among tasks. With ``quarantine`` bad records are
    appended to that table and left out; without it their bad fields are NULL.
    """
    if quarantine is not None:
        return read_json_checked(spark, path, schema, quarantine, lines).rows.drop("__file")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_json_folder(
    spark: SparkSession, folder: str, schema: str, lines: bool = False, quarantine: str | None = None
) -> DataFrame:
    """Every ``*.json`` of a folder, tagged with the source its file name tells."""
    if quarantine is not None:
        posts = read_json_checked(spark, folder, schema, quarantine, lines, "*.json").rows
        return posts.withColumn("source", source_from_name(F.col("__file"))).drop("__file")
    posts = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("pathGlobFilter", "*.json")
        .json(folder)
    )
    return posts.withColumn("source", source_from_name(F.col("_metadata.file_name")))


def source_from_name(file_name: Column) -> Column:
    """First known source named in the file name, else ``unknown``."""
    base = F.lower(F.regexp_extract(file_name, r"([^/\\]*)$", 1))
    chain = F.when(F.contains(base, F.lit(KNOWN_SOURCES[0])), KNOWN_SOURCES[0])
    for name in KNOWN_SOURCES[1:]:
        chain = chain.when(F.contains(base, F.lit(name)), name)
    return chain.otherwise("unknown")


def source_from_stem(file_name: Column) -> Column:
    """File name without folder and last extension."""
    base = F.regexp_extract(file_name, r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def with_file_stem(df: DataFrame, out: str = "source") -> DataFrame:
    """Tag rows of a file scan with their file's stem."""
    return df.withColumn(out, source_from_stem(F.col("_metadata.file_name")))


def read_or_empty(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", lines: bool = False
) -> DataFrame:
    """An existing store, or an empty table when it is absent or corrupt.

    ``lines`` reads a JSON store that ``write_json`` wrote. Of a JSON store bad
    records are left out and good ones beside them stay; a file that does not
    parse counts as empty, with a warning.
    """
    if fmt == "json":
        return read_json_checked(spark, path, schema, lines=lines).rows.drop("__file")
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, text unescaped, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_table(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None
) -> None:
    """Parquet, the default between stages."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_predictions(
    df: DataFrame, path: str, actual: str = "actual", predicted: str = "predicted",
    mode: str = "errorifexists",
) -> None:
    write_csv(df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")),
              path, mode)
