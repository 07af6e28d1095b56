"""A Spark session with the settings that the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tesserine", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one; keyword arguments are settings with underscores for dots."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path that driver and executors share, below ``spark.checkpoint.dir``; of a local session without it, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return f"{tempfile.mkdtemp(prefix='tesserine-')}/scratch"
    return f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read from there: computed once however often it is used, and not again if an executor is lost."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
