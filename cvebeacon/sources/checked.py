"""JSON stores read record by record: good ones stay, bad ones go to quarantine."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from cvebeacon.session import materialize

_BAD = "_corrupt_record"
QUARANTINE = "file STRING, reason STRING, record STRING"


@dataclass(frozen=True)
class CheckedRead:
    """Good rows, and the rows (file, reason, record) of what could not be read.

    The reason is ``record`` for one bad object, whose text is kept, and ``file``
    for a file that does not parse at all, which stays where it is.
    """

    rows: DataFrame
    bad: DataFrame
    bad_records: int
    bad_files: int


def _elements(text: Column) -> Column:
    """The objects of an array as texts, one object as itself; NULL if the text does not parse."""
    array = F.from_json(text, "array<string>")
    whole = F.when(F.from_json(text, "map<string,string>").isNotNull(), F.array(text))
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), array).otherwise(whole)


def _options(reader: DataFrameReader, glob: str | None) -> DataFrameReader:
    return reader if glob is None else reader.option("pathGlobFilter", glob)


def _parsed(text: str, schema: str) -> Column:
    # Options given, the optimiser leaves the schema whole: every field is judged.
    return F.from_json(text, f"{schema}, {_BAD} STRING", {"columnNameOfCorruptRecord": _BAD})


def read_json_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    quarantine: str | None = None,
    lines: bool = False,
    glob: str | None = None,
) -> CheckedRead:
    """Read files of one object, an array of objects or (``lines``) an object per line.

    All files are parsed once, to Parquet in the shared folder: a reader that
    needs few columns would otherwise not see faults in the others. Files with a
    fault are then split into their objects, and each object is judged by
    itself: one with a field of the wrong type, and a value that is no object,
    is a bad record. JSON nulls in an array are skipped. ``quarantine`` names a
    Parquet table the bad rows are appended to. A file that does not parse gives
    no row and a warning; an empty file gives neither. An absent path gives no rows.
    """
    nothing = CheckedRead(
        spark.createDataFrame([], f"{schema}, __file STRING"), spark.createDataFrame([], QUARANTINE), 0, 0
    )
    reader = _options(spark.read.schema(f"{schema}, {_BAD} STRING"), glob).option("multiLine", not lines)
    try:
        scanned = reader.option("columnNameOfCorruptRecord", _BAD).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return nothing
    columns = [c for c in scanned.columns if c != _BAD]
    file = F.col("_metadata.file_path").alias("__file")
    stored = materialize(scanned.select(*columns, file, F.col(_BAD).isNotNull().alias("__bad")), "json")
    good = stored.filter(~F.col("__bad")).select(*columns, "__file")
    # Paths of faulty files; the driver has listed all paths of the store before.
    faulty = [r["__file"] for r in stored.filter("__bad").select("__file").distinct().collect()]
    if not faulty:
        return CheckedRead(good, nothing.bad, 0, 0)
    texts = _options(spark.read, glob).text(path, wholetext=not lines)
    texts = texts.select(file, F.col("value").alias("text")).filter(F.col("__file").isin(faulty))
    if lines:
        # A line is its own document, and equal lines are different records.
        texts = texts.filter(F.trim("text") != "").filter(_parsed("text", schema)[_BAD].isNotNull())
    split = texts.select("__file", "text", _elements(F.col("text")).alias("parts"))
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
        F.filter("parts", lambda x: x.isNotNull())
    )
    # A NULL record stands for a text that does not parse; of a line the text is kept.
    text = F.when(F.lit(lines), F.col("text"))
    objects = split.select("__file", text.alias("text"), F.explode(parts).alias("record"))
    judged = materialize(objects.withColumn("r", _parsed("record", schema)), "judged")
    fine = F.col("record").isNotNull() & F.col(f"r.{_BAD}").isNull()
    saved = judged.filter(fine).select(*[F.col(f"r.`{c}`").alias(c) for c in columns], "__file")
    whole = F.col("record").isNull() & (not lines)
    bad = judged.filter(~fine).select(
        F.col("__file").alias("file"),
        F.when(whole, "file").otherwise("record").alias("reason"),
        F.coalesce("record", "text").alias("record"),
    )
    counts = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
    if quarantine is not None and counts:
        bad.write.mode("append").parquet(quarantine)
    if "file" in counts:
        warnings.warn(f"{counts['file']} file(s) under {path} hold no valid JSON and were left out", stacklevel=2)
    return CheckedRead(good.unionByName(saved), bad, counts.get("record", 0), counts.get("file", 0))
