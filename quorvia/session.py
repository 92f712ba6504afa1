"""Session with the settings the engine expects, and the table loader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; give ``master`` on one machine only, a cluster's submitter sets its own."""
    builder = SparkSession.builder.appName("quorvia")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir``; only where that is unset, as in
    tests on one machine, a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not sc.getConf().get("spark.master", "local[1]").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    found = f"{tempfile.gettempdir()}/quorvia-{uuid.uuid4().hex}"
    sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame as a reliable checkpoint in the shared folder: lineage ends there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
