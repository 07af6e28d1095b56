"""Limits that hold over tasks, models asked once, samples from counts of hashes."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import evalset
from tesserine.plans import jobs
from tesserine.plugins import BatchRewriter, CallGenerator, EchoGenerator, HashEmbedder


def _recorder(path, each=0.0):
    """Writes when it is asked, from what task, and when it is done."""

    def connect():
        import os

        def ask(what):
            began = time.time()
            time.sleep(each)
            with open(path, "a") as f:
                f.write(f"{began} {time.time()} {os.getpid()}\n")
            return {x["index"]: x["question"].upper() for x in what} if isinstance(what, list) else what.upper()

        return ask

    return connect


def test_a_rate_holds_over_four_tasks(spark, tmp_path):
    log = tmp_path / "log"
    rows = spark.createDataFrame([(i, "k", "seen", f"q{i}") for i in range(24)], "row_index long, keyword string, vision_caption string, question string")
    got = BatchRewriter(_recorder(str(log)), size=2, pause=0.25, tasks=4).rewrite(rows).collect()
    assert {r[0]: r[1] for r in got} == {i: f"Q{i}" for i in range(24)}
    asked = sorted((float(t), pid) for t, _, pid in (line.split() for line in log.read_text().splitlines()))
    gaps = [b[0] - a[0] for a, b in zip(asked, asked[1:], strict=False)]
    assert len({pid for _, pid in asked}) == 4 and min(gaps) > 0.2 and asked[-1][0] - asked[0][0] >= 0.25 * (len(asked) - 1) - 0.1


def test_generators_take_turns(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "query_id long, prompt string")
    for turns in (False, True):
        log = tmp_path / f"log{turns}"
        generator = CallGenerator(_recorder(str(log), 0.05), tasks=3)
        got = (generator.in_turn() if turns else generator).generate(prompts)
        assert {r["query_id"]: r["answer"] for r in got.collect()} == {i: f"P{i}" for i in range(12)}
        times = sorted(tuple(map(float, line.split()[:2])) for line in log.read_text().splitlines())
        if turns:
            assert all(a[1] <= b[0] + 1e-3 for a, b in zip(times, times[1:], strict=False))
    assert generator.generate(prompts).rdd.getNumPartitions() == 3  # the prompts stay dealt to all tasks
    with pytest.raises(ValueError):
        CallGenerator(_recorder(""), tasks=0)


class CountingEmbedder(HashEmbedder):
    """Counts the vectors that it makes of requests."""

    def __init__(self, seen):
        super().__init__(64)
        self.seen = seen

    def embed(self, df, text, into="embedding"):
        seen, vector = self.seen, HashEmbedder(64).vector
        if text != "query":
            return HashEmbedder(64).embed(df, text, into)

        def run(batch: pd.Series) -> pd.Series:
            seen.add(len(batch))
            return batch.map(vector)

        return df.withColumn(into, F.pandas_udf(run, "array<float>")(F.col(text)))


def test_each_question_is_embedded_once(spark):
    docs = spark.createDataFrame([(i, f"dish {i} is good. More.", f"k{i}", "c", "s") for i in range(30)], "doc_id long, content string, keyword string, category string, subcategory string")
    asked = spark.createDataFrame([(i, f"dish {i}", "", "c", f"k{i}") for i in range(25)], "query_id long, question string, normalized_question string, category string, keyword string")
    seen = spark.sparkContext.accumulator(0)
    embedder = CountingEmbedder(seen)
    index = embedder.embed(docs, "content")
    got = jobs.answer(asked, index, embedder, EchoGenerator(), jobs.Settings(threshold=0.0))
    assert got.count() == 25 and got.where("answer like 'Dish%'").count() == 25 and seen.value == 25
    jobs.answer_with_timing(asked, index, embedder, EchoGenerator(), jobs.Settings(threshold=0.0)).collect()
    assert seen.value == 50


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice([None, "a", "b", "c", "d"] + ["hot"] * 5), i) for i in range(1500)]
    return spark.createDataFrame(rows + [("r7", "a", 9001), (None, "b", 9002)], "id string, cat string, n int").repartition(3).persist()


def ids(df):
    return sorted((r["id"] or "", r["cat"] or "") for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 700, 1501, 1502, 9000])
def test_random_cap_by_counts_is_that_by_order(table, n):
    assert ids(evalset.random_cap(table, n, seed=5, ranked=-1)) == ids(evalset.random_cap(table, n, seed=5)) and evalset.random_cap(table, n, seed=5, ranked=-1).count() == min(n, 1502)


def test_large_samples_are_filters(spark, table):
    plan = evalset.random_cap(table, 700, seed=5, ranked=-1)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Sort", "TakeOrdered", "SinglePartition", "Window", "Limit"))
    big = spark.range(40_000).select(F.col("id").cast("string").alias("id"))
    got = evalset.random_cap(big, 20_000, seed=1)
    assert got.count() == 20_000 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 5, 300, 2000])
def test_groups_by_counts_are_those_by_rank(table, n):
    assert ids(evalset.cap_per_group(table, "cat", n, seed=5, ranked=0)) == ids(evalset.cap_per_group(table, "cat", n, seed=5))
    assert ids(evalset.balanced_sample(table, "cat", n, seed=5, ranked=0)) == ids(evalset.balanced_sample(table, "cat", n, seed=5))
    assert evalset.balanced_sample(table.limit(0), "cat", n, seed=5, ranked=0).count() == 0 == evalset.cap_per_group(table.limit(0), "cat", n, seed=5, ranked=0).count()
