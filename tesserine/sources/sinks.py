"""Writers. Spark's commit protocol makes a table appear whole; small reports are written by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write rows as JSON lines and say how many, counted while they are written."""
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text to one file: to a name of its own first, then moved into place."""
    fs, target = _fs(spark, path)
    _, staged = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    # One step that takes the place of an old file, so that readers find either.
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    full = lambda p: fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(full(staged), full(target), how)


def write_stats(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    write_text(row.sparkSession, row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})).first()[0], path)


def replace_table(df: DataFrame, path: str, **partitioning) -> None:
    """Write a table beside the old one and swap, so that ``df`` may read the old one; that is deleted once the new one stands."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    staged_path = f"{path}.{uuid.uuid4().hex}"
    _, staged = _fs(spark, staged_path)
    writer = df.write.mode("overwrite")
    if partitioning.get("partition_by"):
        writer = writer.partitionBy(*partitioning["partition_by"])
    writer.parquet(staged_path)
    _, old = _fs(spark, f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move {staged} to {target}")
    if had:
        fs.delete(old, True)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a table or file; False if there is none."""
    fs, target = _fs(spark, path)
    return bool(exists(spark, path) and fs.delete(target, True))
