"""Readers: JSON lines with line numbers, nested JSON, mappings, caches, configuration, the index."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns in composed form (NFC), over one scan. Of texts without combining marks, Python sees a null."""

    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    fixed = F.pandas_udf(nfc, "string")
    return df.withColumns({c: F.coalesce(fixed(F.when(F.col(c).rlike(r"\p{M}"), F.col(c))), F.col(c)) for c in columns})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_index, raw: the lines of a text that aren't blank, numbered from 1 by their place in it; files go by name.

    Numbers are counts of the lines in the splits before, plus the place in the split, so nothing is sorted. Both
    come from scans of one plan; a split that one of them cut otherwise is an error.
    """
    found = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.spark_partition_id().alias("task"), F.col("value").alias("raw"))
    splits = found.groupBy("file", "start", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = found.join(splits.select("file", "start", "task", "first", "n", before.alias("before")), ["file", "start", "task"], "left")
    place = F.col("at") - F.col("first")
    number = F.when(place < F.col("n"), F.col("before") + place + 1).otherwise(F.raise_error(F.lit(f"{path} was split anew while it was read")).cast("long"))
    return lines.select(number.alias("row_index"), "raw").where(F.trim("raw") != "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, strict: bool = True) -> DataFrame:
    """Rows of a JSON lines file, columns as in ``schema``; ``strict`` fails at a bad line, else it is in _corrupt."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_json("value", f"{known}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("j")).select("j.*")


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str, *, strict: bool = True, compose: bool = False) -> DataFrame:
    """As ``read_jsonl``, with row_index, the number of the line; a strict reader names the first bad line. compose: texts come in composed form (``composed``)."""
    lines = read_lines(spark, path)
    parsed = (composed(lines, "raw") if compose else lines).withColumn("_j", F.from_json("raw", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    if strict:
        bad = parsed.where(F.col("_j._corrupt").isNotNull()).orderBy("row_index").select("row_index").first()
        if bad:
            raise ValueError(f"bad JSON at line {bad[0]} of {path}")
    return parsed.select("row_index", "_j.*").drop(*(["_corrupt"] if strict else []))


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that is one JSON value: an object is a row, an array its elements' rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or no rows where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_json_or_missing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with input_missing; its columns are null where the file is missing."""
    if exists(spark, path):
        return read_json_document(spark, path, schema).limit(1).withColumn("input_missing", F.lit(False))
    return spark.createDataFrame([()], T.StructType([])).select(F.from_json(F.lit("{}"), schema).alias("j")).select("j.*", F.lit(True).alias("input_missing"))


def nested(df: DataFrame, path: str, default: Column) -> Column:
    """The value at a dotted path; the default where a step of it is missing, isn't a struct, or is null."""
    found: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(found, T.StructType) or name not in found.names:
            return default
        found = found[name].dataType
    return F.coalesce(F.col(".".join(f"`{x}`" for x in path.split("."))), default)


def unwrapped(df: DataFrame, wrapper: str = "summary") -> DataFrame:
    """Rows of statistics, taken out of the ``wrapper`` struct that some files have around them."""
    wrapped = wrapper in df.columns and isinstance(df.schema[wrapper].dataType, T.StructType)
    return df.select(f"`{wrapper}`.*", *(c for c in ("input_missing",) if c in df.columns)) if wrapped else df


def read_yaml(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """A configuration file, of any file system if a session reads it; needs a YAML parser to be installed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()
        found = yaml.safe_load(text[0] if text else "") or {}
    else:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def mapping_table(spark: SparkSession, mapping: dict[str, Any], *, section: str = "keyword_normalization") -> DataFrame:
    """row_index, raw, normalized from a mapping, nested under ``section`` or not."""
    pairs = mapping.get(section, mapping)
    if not isinstance(pairs, dict):
        raise ValueError("the keyword mapping must be a dictionary")
    return spark.createDataFrame([(i, str(k), str(v)) for i, (k, v) in enumerate(pairs.items())], "row_index long, raw string, normalized string")


def secret(name: str, default: str | None = None) -> str | None:
    """A value from the driver's environment; never part of a plan."""
    return os.environ.get(name, default)


def first_rows(df: DataFrame, n: int | None, *, order: str = "row_index") -> DataFrame:
    """The first n rows in the given order; all if n is None."""
    return df if n is None else df.orderBy(order).limit(n)


def open_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored index, or an empty one."""
    return read_or_empty(spark, path, schema)


def peek(index: DataFrame, n: int = 5) -> DataFrame:
    return index.limit(n)
