"""Joins by time: rows of one table with what another has within an interval after them, or had last before them.

Both cut time into buckets, so that a key with half of all rows is as many groups as
its time has buckets, and no task needs all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(interval: str) -> float:
    """The length of an interval of days or less, as "90 minutes" or "1 hour 30 seconds"."""
    units = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    words = interval.split()
    if not words or len(words) % 2:
        raise ValueError(f"{interval!r} is not an interval")
    try:
        total = sum(float(n) * units[unit.lower().rstrip("s")] for n, unit in zip(words[::2], words[1::2], strict=True))
    except KeyError as e:
        raise ValueError(f"{interval!r} is not an interval of fixed length") from e
    if total <= 0:
        raise ValueError("an interval must be positive")
    return total


def _bucket(ts: Column, width: float) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(round(width * 1e6))).cast("long")


def interval_join(first: DataFrame, then: DataFrame, *, key: str, ts: str = "ts", within: str = "1 hour", how: str = "inner", watermark: str | None = None, prefix: str = "next_") -> DataFrame:
    """Rows of ``first`` with those of ``then`` of the same key from their time on, less than ``within`` later.

    how: inner, or left for rows of ``first`` without any, too. Columns of ``then`` but the key get ``prefix``. Null
    keys and times meet nothing. Rows are joined by key and bucket of time; a row of ``then`` goes to two buckets, one of
    ``first`` to one, so that no pair comes twice. watermark: for streams, how late rows may come; state is
    kept on both sides until nothing on the other can meet it, and rows without any come out then.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    width, after = seconds(within), f"{prefix}{ts}"
    clash = {"_bucket", f"{prefix}{key}"} & set(first.columns) or set(first.columns) & {f"{prefix}{c}" for c in then.columns}
    if clash:
        raise ValueError(f"{sorted(clash)} are in both tables")
    other = then.select(F.col(key).alias(f"{prefix}{key}"), *(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in then.columns if c != key))
    if watermark:
        first, other = first.withWatermark(ts, watermark), other.withWatermark(after, watermark)
    left = first.withColumn("_bucket", _bucket(F.col(ts), width))
    right = other.withColumn("_at", F.explode(F.array(_bucket(F.col(after), width), _bucket(F.col(after), width) - 1)))
    near = (F.col(key) == F.col(f"{prefix}{key}")) & (F.col("_bucket") == F.col("_at")) & (F.col(after) >= F.col(ts)) & (F.col(after) < F.col(ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "left_outer" if how == "left" else "inner").drop("_bucket", "_at", f"{prefix}{key}")


def as_of_join(left: DataFrame, right: DataFrame, *, key: str, ts: str = "ts", order: str | None = None, tolerance: str | None = None, bucket: str = "1 day", prefix: str = "last_") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key at its time or before, if there is one.

    Of rows of ``right`` at the same time, the largest in ``order`` is the last. tolerance: how long before it may
    be. Columns of ``right`` but the key get ``prefix`` and are null where there is no such row; null keys and times have
    none. Rows are dealt by key and bucket of time; the last row of each bucket is carried
    to the next ones of its key over a table of a row for each, and nothing else crosses buckets.
    """
    width = seconds(bucket)
    values = [c for c in right.columns if c != key]
    clash = {f"{prefix}{c}" for c in values} & set(left.columns)
    if clash:
        raise ValueError(f"{sorted(clash)} are in both tables")
    row, known = F.struct(*(F.col(f"`{c}`") for c in left.columns)), F.struct(*(F.col(f"`{c}`") for c in values))
    rank = F.col(f"`{order}`") if order else F.lit(0)
    no = lambda df, c: F.lit(None).cast(df.select(c.alias("c")).schema["c"].dataType)
    place = F.col(key).alias("_k"), F.col(ts).alias("_t"), _bucket(F.col(ts), width).alias("_b")
    asked = left.select(*place, F.lit(1).alias("_kind"), no(right, rank).alias("_o"), row.alias("_l"), no(right, known).alias("_r"))
    told = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(*place, F.lit(0).alias("_kind"), rank.alias("_o"), no(left, row).alias("_l"), known.alias("_r"))
    carried = told.groupBy("_k", "_b").agg(F.max_by("_r", F.struct("_t", "_o")).alias("_last"), F.max("_t").alias("_last_t"))
    needed = asked.select("_k", "_b").where("_k is not null and _b is not null").distinct().unionByName(carried.select("_k", "_b")).distinct()
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    brought = needed.join(carried, ["_k", "_b"], "left").select("_k", "_b", F.last("_last", True).over(before).alias("_before"), F.last("_last_t", True).over(before).alias("_before_t"))
    sure = asked.where("_k is not null and _t is not null").unionByName(told)
    upto = W.partitionBy("_k", "_b").orderBy("_t", "_kind", F.col("_o").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    here = sure.select("*", F.last("_r", True).over(upto).alias("_in"), F.last(F.when(F.col("_kind") == 0, F.col("_t")), True).over(upto).alias("_in_t")).where("_kind = 1")
    both = here.join(brought, ["_k", "_b"], "left").select("_l", "_t", F.coalesce("_in", "_before").alias("_f"), F.coalesce("_in_t", "_before_t").alias("_ft"))
    both = both.unionByName(asked.where("_k is null or _t is null").select("_l", "_t", F.col("_r").alias("_f"), F.col("_t").alias("_ft")))
    found = F.col("_f") if tolerance is None else F.when(F.col("_ft") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}"), F.col("_f"))
    return both.select("_l", found.alias("_f")).select("_l.*", *(F.col(f"_f.`{c}`").alias(f"{prefix}{c}") for c in values))
