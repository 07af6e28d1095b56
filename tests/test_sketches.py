"""Merged sketches against exact counts; a batch that comes again."""

import pytest
from pyspark.sql import functions as F

from tesserine.operators import sketches

COLUMNS = ["word", "size"]


def rows(spark, start, n):
    i = F.col("id")
    return spark.range(start, start + n).select(F.when(i % 3 == 0, F.concat(F.lit("hot"), (i % 5).cast("string"))).when(i % 50 != 1, F.concat(F.lit("w"), (i % 4001).cast("string"))).alias("word"), F.when(i % 7 == 0, None).when(i % 7 == 1, float("nan")).otherwise((i * 37) % 1000 + 0.5).alias("size"))


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_merged_batches_come_near_the_whole(spark, tmp_path):
    path = str(tmp_path / "stats")
    for b in range(4):
        sketches.record(rows(spark, 5000 * b, 5000), path, f"b{b}", COLUMNS)
    sketches.record(rows(spark, 0, 4000), path, "b0", COLUMNS)  # comes again, with fewer rows
    whole = rows(spark, 5000, 15000).unionByName(rows(spark, 0, 4000))
    got, want = by_column(sketches.statistics(spark, path)), by_column(sketches.exact(whole, COLUMNS))
    assert got.keys() == want.keys() == set(COLUMNS)
    for c in COLUMNS:
        assert [got[c][x] for x in ("rows", "filled", "low", "high")] == [want[c][x] for x in ("rows", "filled", "low", "high")]
        assert abs(got[c]["distinct"] - want[c]["distinct"]) <= 0.05 * want[c]["distinct"]
    assert abs(got["size"]["mean"] - want["size"]["mean"]) < 1e-9 and got["word"]["mean"] is None and got["word"]["quantiles"] is None
    assert all(abs(a - b) <= 40 for a, b in zip(got["size"]["quantiles"], want["size"]["quantiles"], strict=True))
    top = {x["value"]: x["n"] for x in got["word"]["frequent"]}
    for x in want["word"]["frequent"][:5]:
        assert x["value"].startswith("hot") and abs(top[x["value"]] - x["n"]) <= 0.05 * x["n"]


def test_one_scan_and_edges(spark):
    df = rows(spark, 0, 100)
    plan = sketches.summarize(df, "b", COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 or plan.split("== Initial Plan ==")[0].count("Range (") <= 2
    none = by_column(sketches.merged(sketches.summarize(df.limit(0), "b", COLUMNS)))
    assert none["word"]["rows"] == 0 and none["size"]["distinct"] == 0 and none["size"]["mean"] is None and list(none["word"]["frequent"]) == []
    blank = by_column(sketches.merged(sketches.summarize(df.select(F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("size")), "b", COLUMNS)))
    assert blank["size"]["filled"] == 0 and blank["size"]["low"] is None
    with pytest.raises(ValueError):
        sketches.summarize(df, "b", [])
