"""Keyed tables in versions: buckets of rows, a log of changes over them, merged as they are read.

``path``/log has a small JSON file for each version, which names the folders that make it up: for
each bucket the folder of its rows, and after it the folders of changes, oldest first. A write puts new
folders under ``path``/data and then one new file into the log, in one step; until then readers
see the version before, after it the new one, and never none. Folders are never written
again, so a bucket that a write doesn't touch keeps its files. Compaction merges the
changes of the buckets that have any; ``vacuum`` deletes what no kept version names.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks

BUCKETS = 64
#: Columns of stored rows beside the table's own.
_GONE, _BUCKET = "_gone", "_bucket"


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


def _log(spark: SparkSession, path: str) -> list[int]:
    fs, folder = sinks._fs(spark, f"{path}/log")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))


def state(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What makes up a version, the last one by default; None where there is no table yet."""
    known = _log(spark, path)
    if not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    text = spark.read.text(f"{path}/log/{known[-1] if version is None else version:012d}.json", wholetext=True)
    return json.loads(text.first()[0])


def _commit(spark: SparkSession, path: str, new: dict) -> int:
    """Write a version to a name of its own and give it its number, unless another writer has."""
    target = f"{path}/log/{new['version']:012d}.json"
    fs, staged = sinks._fs(spark, f"{path}/log/.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    _, final = sinks._fs(spark, target)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(final), none)  # fails where the target is there
    except Py4JJavaError as e:
        fs.delete(staged, False)
        if fs.exists(final):
            raise Conflict(f"{path} got version {new['version']} meanwhile") from e
        raise
    return new["version"]


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _put(df: DataFrame, path: str) -> tuple[str, list[int]]:
    """Store rows by bucket in a new folder; its name, and the buckets that it has."""
    name = uuid.uuid4().hex
    df.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{path}/data/{name}")
    fs, folder = sinks._fs(df.sparkSession, f"{path}/data/{name}")
    found = (re.fullmatch(rf"{_BUCKET}=(\d+)", s.getPath().getName()) for s in fs.listStatus(folder))
    return name, sorted(int(m[1]) for m in found if m)


def _last(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of each key: the last by ``order``, and of those that tie always the same one."""
    first = [F.desc(order)] if order else []
    rest = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]).desc()]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*first, *rest))).where("_n = 1").drop("_n")


def _schema(df: DataFrame) -> str:
    clash = {_GONE, _BUCKET} & set(df.columns)
    if clash:
        raise ValueError(f"{sorted(clash)} are names of this table's own columns")
    return df.schema.json()


def create(df: DataFrame, path: str, *, key: str, buckets: int = BUCKETS, order: str | None = None) -> int:
    """Make the rows the whole table, as a new version of it; the number of the version. ``df`` may read the one before."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spark, before, schema = df.sparkSession, state(df.sparkSession, path), _schema(df)
    name, found = _put(_bucketed(_last(df, key, order), key, buckets).withColumn(_GONE, F.lit(False)), path)
    new = {"version": before["version"] + 1 if before else 1, "key": key, "buckets": buckets, "schema": schema, "rows": {str(b): name for b in found}, "changes": []}
    return _commit(spark, path, new)


def _change(df: DataFrame, path: str, before: dict, schema: str) -> int:
    name, found = _put(df, path)
    if not found:
        return before["version"]
    return _commit(df.sparkSession, path, before | {"version": before["version"] + 1, "schema": schema, "changes": [*before["changes"], {"folder": name, "buckets": found}]})


def upsert(df: DataFrame, path: str, *, order: str | None = None) -> int:
    """Rows in place of those of the same key; only they are written. Columns that the table lacks are added, those that ``df`` lacks are null.

    Of new rows that share a key the last by ``order`` counts, or the same one always if there is none.
    """
    before = _there(df.sparkSession, path)
    old = T.StructType.fromJson(json.loads(before["schema"]))
    merged = T.StructType([*old.fields, *(f for f in df.schema.fields if f.name not in old.names)])
    _schema(df)
    full = _last(df, before["key"], order).select(*(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in merged.fields))
    return _change(_bucketed(full, before["key"], before["buckets"]).withColumn(_GONE, F.lit(False)), path, before, merged.json())


def delete(keys: DataFrame, path: str) -> int:
    """Rows of these keys go; only the keys are written."""
    before = _there(keys.sparkSession, path)
    kind = T.StructType.fromJson(json.loads(before["schema"]))[before["key"]].dataType
    gone = keys.select(F.col(before["key"]).cast(kind).alias(before["key"])).distinct()
    return _change(_bucketed(gone, before["key"], before["buckets"]).withColumn(_GONE, F.lit(True)), path, before, before["schema"])


def _there(spark: SparkSession, path: str) -> dict:
    found = state(spark, path)
    if found is None:
        raise ValueError(f"there is no table at {path}")
    return found


def _read(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/data/{f}" for f in folders))


def _merged(spark: SparkSession, path: str, at: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version. Buckets without changes are read as they are; of the others, changed keys give way to their last change."""
    own = T.StructType.fromJson(json.loads(at["schema"]))
    full, key = T.StructType([*own.fields, T.StructField(_GONE, T.BooleanType())]), at["key"]
    wanted = lambda b: buckets is None or b in buckets
    rows = {int(b): f for b, f in at["rows"].items() if wanted(int(b))}
    changes = [(n, b, f"{c['folder']}/{_BUCKET}={b}") for n, c in enumerate(at["changes"]) for b in c["buckets"] if wanted(b)]
    changed = {b for _, b, _ in changes}
    leaf = lambda b: f"{rows[b]}/{_BUCKET}={b}"
    parts = []
    if still := [leaf(b) for b in sorted(rows) if b not in changed]:
        parts.append(_read(spark, path, own, still))
    if changed:
        by_change: dict[int, list[str]] = {}
        for n, _, f in changes:
            by_change.setdefault(n, []).append(f)
        each = [_read(spark, path, full, found).withColumn("_change", F.lit(n)) for n, found in sorted(by_change.items())]
        log = each[0]
        for more in each[1:]:
            log = log.unionByName(more)
        newest = W.partitionBy(key).orderBy(F.desc("_change"))
        last = log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_change")
        if under := [leaf(b) for b in sorted(changed) if b in rows]:
            over = log.select(F.col(key).alias("_key"))
            parts.append(_read(spark, path, own, under).join(over, F.col(key).eqNullSafe(F.col("_key")), "left_anti"))
        parts.append(last.where(~F.col(_GONE)).select(*own.names))
    if not parts:
        return spark.createDataFrame([], own)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read(spark: SparkSession, path: str, *, version: int | None = None, schema: str | None = None) -> DataFrame:
    """The rows of a version, the last one by default; no rows of ``schema`` where there is no table yet."""
    at = state(spark, path, version)
    if at is None:
        if schema is None:
            raise ValueError(f"there is no table at {path}")
        return spark.createDataFrame([], schema)
    return _merged(spark, path, at)


def compact(spark: SparkSession, path: str, *, least: int = 1) -> int:
    """Merge the changes of buckets that have ``least`` of them or more into new rows; other buckets keep their files and changes."""
    at = _there(spark, path)
    number: dict[int, int] = {}
    for c in at["changes"]:
        for b in c["buckets"]:
            number[b] = number.get(b, 0) + 1
    crowded = sorted(b for b, n in number.items() if n >= least)
    if not crowded:
        return at["version"]
    name, found = _put(_bucketed(_merged(spark, path, at, crowded), at["key"], at["buckets"]).withColumn(_GONE, F.lit(False)), path)
    rows = {b: f for b, f in at["rows"].items() if int(b) not in crowded} | {str(b): name for b in found}
    left = [c | {"buckets": [b for b in c["buckets"] if b not in crowded]} for c in at["changes"]]
    return _commit(spark, path, at | {"version": at["version"] + 1, "rows": rows, "changes": [c for c in left if c["buckets"]]})


def vacuum(spark: SparkSession, path: str, *, keep: int = 1) -> int:
    """Keep the last ``keep`` versions; the number of folders deleted. For when no job reads or writes older ones."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    known = _log(spark, path)
    stay = [state(spark, path, v) for v in known[-keep:]]
    named = {f for s in stay for f in s["rows"].values()} | {c["folder"] for s in stay for c in s["changes"]}
    fs, data = sinks._fs(spark, f"{path}/data")
    for v in known[:-keep]:
        sinks.delete(spark, f"{path}/log/{v:012d}.json")
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
