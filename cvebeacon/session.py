"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "cvebeacon", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Executors on any host must reach it, so the cluster's setting decides. Only
    a local master without the setting (tests) gets a temporary folder; a real
    cluster without it is an error, never a machine-local path.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cvebeacon-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame that several jobs read to the shared folder and read it back.

    Later jobs scan columns of a table instead of repeating the work, and a lost
    executor costs no recomputation of what came before.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for stateful streams.

    A stream keeps its number of state partitions for life. More of them than
    the application has cores only multiplies the state files of every batch.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", str(min(wanted, cores)))
    return session


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The same as ``--py-files``: the driver serves the archive to every executor,
    so the package need not be installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder, name = os.path.split(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name)
    context.addPyFile(shutil.make_archive(archive, "zip", folder, name))
    _SHIPPED.add(context.applicationId)
