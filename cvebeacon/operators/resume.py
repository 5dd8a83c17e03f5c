"""Jobs in slices that can be stopped at any time and go on where they were."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvebeacon.operators.enrich import MAX_DAYS, enrich
from cvebeacon.sources.files import read_or_empty

_MANIFEST = "slice INT, attempt STRING, rows LONG"


@dataclass(frozen=True)
class SlicedJob:
    """A folder with staged inputs, one result folder per attempt at a slice, and a manifest.

    The manifest gets a slice's entry after its result is complete, and results
    are read through the manifest only. So an attempt that was killed, or runs on
    in a lost process, leaves files that nobody reads, and a slice may be tried
    any number of times.
    """

    folder: str
    slices: int = 16

    def _entry(self, name: str) -> str:
        return f"{self.folder}/manifest/{name}"

    def _entries(self, spark: SparkSession, name: str) -> list:
        return read_or_empty(spark, self._entry(name), _MANIFEST, "parquet").collect()

    def finished(self, spark: SparkSession) -> dict[int, tuple[str, int]]:
        """Attempt and rows of every finished slice."""
        return {r["slice"]: (r["attempt"], r["rows"]) for i in range(self.slices) for r in self._entries(spark, str(i))}

    def _finish(self, spark: SparkSession, name: str, number: int, attempt: str, rows: int) -> None:
        entry = spark.createDataFrame([(number, attempt, rows)], _MANIFEST)
        entry.coalesce(1).write.mode("overwrite").parquet(self._entry(name))

    def stage(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """The frame cut by ``key``, written once; later runs read the stored cut, not ``df``."""
        spark = df.sparkSession
        done = self._entries(spark, name)
        attempt = done[0]["attempt"] if done else uuid.uuid4().hex
        path = f"{self.folder}/input/{name}/{attempt}"
        part = F.pmod(F.xxhash64(F.col(key)), F.lit(self.slices)).cast("int")
        if not done:
            df.withColumn("__slice", part).write.partitionBy("__slice").parquet(path)
        stored = spark.read.schema(f"{_ddl(df)}, __slice INT").parquet(path)
        if not done:
            self._finish(spark, name, -1, attempt, stored.count())
        return stored

    def run(
        self,
        spark: SparkSession,
        work: Callable[[int], DataFrame],
        written: Callable[[int], None] = lambda _: None,
    ) -> int:
        """Do the slices the manifest lacks, one after the other; the number done.

        ``written`` is told of a slice whose result is complete, before the
        manifest is.
        """
        done = self.finished(spark)
        for number in (i for i in range(self.slices) if i not in done):
            attempt = uuid.uuid4().hex
            path = f"{self.folder}/result/{number}/{attempt}"
            result = work(number)
            result.write.parquet(path)
            rows = spark.read.schema(result.schema).parquet(path).count()
            written(number)
            self._finish(spark, str(number), number, attempt, rows)
        return self.slices - len(done)

    def result(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of all finished slices."""
        paths = [f"{self.folder}/result/{i}/{a}" for i, (a, _) in sorted(self.finished(spark).items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def enrich_in_slices(
    obs: DataFrame,
    history: DataFrame,
    nvd: DataFrame,
    job: SlicedJob,
    max_days: int = MAX_DAYS,
    zero_is_missing: bool = True,
    written: Callable[[int], None] = lambda _: None,
) -> DataFrame:
    """As ``enrich``, in slices by id: posts, scores and records of an id are in one slice.

    A run that is stopped is called again with the same job and does only the
    slices that are missing, on the inputs as they were staged first. At the end
    there are as many rows as posts, or it is an error.
    """
    spark = obs.sparkSession
    posts = job.stage(obs, "posts", "cve")
    scores = job.stage(history, "history", "cve")
    records = job.stage(nvd.select("cve", F.col("cve.id").alias("__id")), "records", "__id").drop("__id")

    def work(number: int) -> DataFrame:
        mine = F.col("__slice") == number
        parts = [df.filter(mine).drop("__slice") for df in (posts, scores, records)]
        return enrich(*parts, max_days, zero_is_missing)

    job.run(spark, work, written)
    done = job.finished(spark)
    rows, wanted = sum(n for _, n in done.values()), posts.count()
    if rows != wanted:
        raise ValueError(f"{rows} enriched rows for {wanted} posts in {job.folder}")
    return job.result(spark, _ddl(work(0)))
