"""Tables in versions against a dictionary; files that stay, versions that stand, writers that meet."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tesserine.sources import sinks, versions

SCHEMA = "id long, name string, at int"


def as_dict(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (r["name"], r["at"]) for r in rows}


def test_random_changes_against_a_dictionary(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "t")
    table = {i: (f"n{i}", 0) for i in range(60)} | {None: ("no key", 0)}
    make = lambda rows: spark.createDataFrame([(i, *v) for i, v in rows], SCHEMA)
    assert versions.create(make(table.items()), path, key="id", buckets=5) == 1
    past = {1: dict(table)}
    for step in range(2, 9):
        if step == 5:
            n = versions.compact(spark, path)
        elif step % 3:
            new = [(rng.choice([None, *range(80)]), (f"s{step}", rng.randrange(9))) for _ in range(12)]
            n = versions.upsert(make(new), path, order="at")
            best = {}
            for i, v in new:
                best[i] = max(best.get(i, ("", -1)), v, key=lambda v: v[1])
            table |= {i: v for i, v in best.items()}
        else:
            keys = [rng.choice([None, *range(80)]) for _ in range(6)]
            n = versions.delete(spark.createDataFrame([(k,) for k in keys], "id int"), path)
            table = {i: v for i, v in table.items() if i not in keys}
        assert n == step
        past[step] = dict(table)
        assert {i: v[1] for i, v in as_dict(versions.read(spark, path)).items()} == {i: v[1] for i, v in table.items()}
    for n, want in past.items():
        assert as_dict(versions.read(spark, path, version=n)).keys() == want.keys()
    versions.compact(spark, path)
    before = as_dict(versions.read(spark, path))
    assert versions.vacuum(spark, path, keep=1) > 0
    assert as_dict(versions.read(spark, path)) == before and len(glob.glob(f"{path}/log/*.json")) == 1
    assert versions.compact(spark, path) == 9  # nothing to merge, no new version
    with pytest.raises(ValueError):
        versions.read(spark, path, version=1)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.range(1000).select("id", F.lit("a").alias("name"), F.lit(0).alias("at")), path, key="id", buckets=16)
    files = set(glob.glob(f"{path}/data/*/*/*.parquet"))
    buckets = lambda fs: {f.split("_bucket=")[1].split("/")[0] for f in fs}
    versions.upsert(spark.createDataFrame([(3, "b", 1), (3000, "c", 1)], SCHEMA), path)
    changed = set(glob.glob(f"{path}/data/*/*/*.parquet")) - files
    assert files < files | changed and len(buckets(changed)) <= 2
    plan = versions.read(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") >= 3  # rows as they are, changes, and rows of changed buckets
    at = versions.state(spark, path)
    versions.compact(spark, path)
    now = versions.state(spark, path)
    same = {b for b in at["rows"] if at["rows"][b] == now["rows"][b]}
    assert len(same) >= 14 and not now["changes"]
    versions.vacuum(spark, path)
    left = set(glob.glob(f"{path}/data/*/*/*.parquet"))
    assert buckets(left & files) >= same and versions.read(spark, path).count() == 1001


def test_readers_see_one_version_or_the_other(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, schema=SCHEMA).count() == 0
    with pytest.raises(ValueError):
        versions.read(spark, path)
    versions.create(spark.createDataFrame([(1, "a", 0)], SCHEMA), path, key="id", buckets=2)
    old = versions.read(spark, path)
    versions.create(versions.read(spark, path).withColumn("at", F.lit(5)), path, key="id", buckets=2)
    assert [r["at"] for r in old.collect()] == [0] and [r["at"] for r in versions.read(spark, path).collect()] == [5]
    assert versions.upsert(spark.createDataFrame([], SCHEMA), path) == 2  # no rows, no new version
    wider = spark.createDataFrame([(2, 7.5)], "id int, more double")
    versions.upsert(wider, path)
    assert sorted(tuple(r) for r in versions.read(spark, path).collect()) == [(1, "a", 5, None), (2, None, None, 7.5)]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    versions.create(one, path, key="id", buckets=2)
    put = versions._put

    def slow(df, to):
        monkeypatch.setattr(versions, "_put", put)
        versions.upsert(one.withColumn("name", F.lit("first")), path)  # another writer, in between
        return put(df, to)

    monkeypatch.setattr(versions, "_put", slow)
    with pytest.raises(versions.Conflict):
        versions.upsert(one.withColumn("name", F.lit("second")), path)
    assert as_dict(versions.read(spark, path)) == {1: ("first", 0)} and len(glob.glob(f"{path}/log/*")) == 2


def test_hot_and_odd_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        versions.create(spark.range(1).withColumn("_gone", F.lit(1)), path, key="id")
    versions.create(spark.createDataFrame([], SCHEMA), path, key="id")
    assert versions.read(spark, path).count() == 0
    same_key = spark.range(2000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("id"), F.lit("x").alias("name"), F.col("id").cast("int").alias("at"))
    versions.upsert(same_key, path, order="at")
    assert as_dict(versions.read(spark, path))[1] == ("x", 899) and versions.read(spark, path).count() == 1101
    assert sinks.exists(spark, path)
