"""Joins by time against plain loops, over batches and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserine.operators import temporal
from tesserine.streaming import answers, events

START = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def made(spark, n, seed, hot=True):
    """(user_id, event_id, ts): half of the rows are of one user, some times tie, some are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if hot and rng.random() < 0.5 else rng.choice([None, 1, 2, 3, 4])
        ts = None if rng.random() < 0.03 else START + timedelta(seconds=rng.randrange(0, 4 * 86400, 600))
        rows.append((user, seed * 10000 + i, ts))
    return rows, spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")


def test_interval_join_against_loops(spark):
    (a, first), (b, then) = made(spark, 300, 1), made(spark, 300, 2)
    pairs = [(x[1], y[1]) for x in a for y in b if None not in (x[0], x[2], y[0], y[2]) and x[0] == y[0] and x[2] <= y[2] < x[2] + timedelta(hours=1)]
    got = temporal.interval_join(first, then, key="user_id", within="1 hour")
    assert got.columns == ["user_id", "event_id", "ts", "next_event_id", "next_ts"]
    assert sorted((r["event_id"], r["next_event_id"]) for r in got.collect()) == sorted(pairs)
    alone = {x[1] for x in a} - {i for i, _ in pairs}
    left = temporal.interval_join(first, then, key="user_id", within="60 minutes", how="left").collect()
    assert sorted((r["event_id"], r["next_event_id"] or -1) for r in left) == sorted(pairs + [(i, -1) for i in alone])
    assert temporal.interval_join(first.limit(0), then, key="user_id").count() == 0
    for bad in ({"how": "full"}, {"within": "1 month"}, {"within": "soon"}, {"prefix": ""}):
        with pytest.raises(ValueError):
            temporal.interval_join(first, then, key="user_id", **bad)


@pytest.mark.parametrize("bucket", ["1 hour", "1 day", "52 weeks"])
def test_as_of_join_against_loops(spark, bucket):
    (a, left), (b, right) = made(spark, 300, 3), made(spark, 200, 4)
    b.append((1, 49999, b[5][2]))
    right = spark.createDataFrame(b, right.schema)

    def last(x, hours=None):
        if x[0] is None or x[2] is None:
            return None
        before = [y for y in b if y[0] == x[0] and y[2] is not None and y[2] <= x[2] and (hours is None or y[2] >= x[2] - timedelta(hours=hours))]
        return max(before, key=lambda y: (y[2], y[1]))[1] if before else None

    got = temporal.as_of_join(left, right, key="user_id", order="event_id", bucket=bucket)
    assert got.columns == ["user_id", "event_id", "ts", "last_event_id", "last_ts"]
    rows = got.collect()
    assert len(rows) == len(a) and {r["event_id"]: r["last_event_id"] for r in rows} == {x[1]: last(x) for x in a}
    near = temporal.as_of_join(left, right, key="user_id", order="event_id", bucket=bucket, tolerance="3 hours").collect()
    assert {r["event_id"]: r["last_event_id"] for r in near} == {x[1]: last(x, 3) for x in a}
    assert temporal.as_of_join(left, right.limit(0), key="user_id").where("last_ts is not null").count() == 0 and temporal.as_of_join(left.limit(0), right, key="user_id").count() == 0


def test_hot_key_is_many_groups(spark):
    rows, left = made(spark, 500, 5)
    plan = temporal.as_of_join(left, left, key="user_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k#" in plan and ", _b#" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def run(df, name, checkpoint=None, mode="append"):
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination(180)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_stream_join_equals_batch(spark, tmp_path, how):
    (_, first), (_, then) = made(spark, 200, 6), made(spark, 200, 7)
    first, then = first.where("ts is not null"), then.where("ts is not null")
    end = spark.createDataFrame([(-1, -1, START + timedelta(days=30))], first.schema)
    streams = []
    for name, df in (("first", first), ("then", then)):
        df.unionByName(end).coalesce(2).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    got = run(events.followed(*streams, how=how), f"followed_{how}").where("user_id >= 0 or user_id is null")
    want = events.followed(first, then, how=how)
    key = lambda df: sorted((r["event_id"], r["next_event_id"] or -1, str(r["next_ts"])) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) > (200 if how == "left" else 20)


def test_late_rows_meet_nothing_that_is_gone(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    at = lambda minutes: START + timedelta(minutes=minutes)
    files = {"first": [[(1, 10, at(0)), (1, 11, at(300))], [(1, 13, at(310))], [(1, 14, at(600))], [(-1, -1, at(9000))]], "then": [[(1, 20, at(30)), (1, 21, at(301))], [(1, 23, at(330))], [(1, 22, at(40))], [(-1, -1, at(9000))]]}
    streams = []
    for name, parts in files.items():
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = run(events.followed(*streams, how="left"), "late").where("user_id > 0").collect()
    # 22 comes when the watermark has passed what it would have followed.
    assert sorted((r["event_id"], r["next_event_id"]) for r in got) == [(10, 20), (11, 21), (11, 23), (13, 23), (14, None)]


def test_once_over_a_stream(spark, tmp_path):
    rows, df = made(spark, 60, 8)
    df = df.where("ts is not null")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(events.once(stream, "event_id", watermark="30 days"), "once")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in df.collect())


def test_a_request_that_stops_midway_is_flushed_once(spark, tmp_path):
    import time

    schema = "request_id string, seq long, token string, is_last boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("stops", 0, "One. ", False), ("stops", 1, "Two", False), ("ends", 0, "All.", True)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def start():
        stream = answers.stream_sentences(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), timeout=4, keep=3600)
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def rows():
        return sorted(map(tuple, spark.read.schema(answers.SENTENCES).parquet(str(tmp_path / "out")).collect()))

    def until(n, most=90):
        end = time.time() + most
        while time.time() < end and len(rows()) < n:
            time.sleep(0.5)
        return rows()

    q = start()
    try:
        until(2)
    finally:
        q.stop()  # maybe before the timer, maybe after
    q = start()
    try:
        put([("other", 0, "Hm.", True)])  # after a restart, timers are looked at with the next tokens
        flushed = until(4)
        assert flushed == [("ends", 0, "All."), ("other", 0, "Hm."), ("stops", 0, "One. "), ("stops", 1, "Two")]
        put([("idle", 0, "Cut", False)])  # and while it runs, without any
        flushed = until(5)
        assert ("idle", 0, "Cut") in flushed and len(flushed) == 5
        time.sleep(6)
        assert rows() == flushed  # once
        put([("stops", 2, "more.", True)])  # what comes after all goes on from there
        assert until(6)[-1] == ("stops", 2, "more.")
    finally:
        q.stop()
    with pytest.raises(ValueError):
        answers.stream_sentences(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), timeout=4, keep=1)
