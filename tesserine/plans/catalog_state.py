"""Queries over stored indexes and tables in versions, and over streams with state, with their SQL; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, sketches, temporal
from ..operators.vector_index import VectorIndex, recall
from ..session import kept, scratch_dir
from ..sources import versions
from ..streaming import events
from .catalog import _KNN, _vectors, query, table

# ---- a vector index by cells ----


@query(f"WITH {_KNN.format(where='true', k=5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h")
def vector_index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector from the index by cells, all of them probed and all candidates compared: the exact result."""
    queries, rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows, scratch_dir(spark))
    return index.search(queries, k=5, probe=None, refine=None).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_KNN.format(where='q.label = d.label', k=5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h")
def vector_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within each vector's label."""
    queries, rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows, scratch_dir(spark))
    return index.search(queries, k=5, probe=None, refine=None, by=("label",)).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query("SELECT count(*) AS hits, true AS enough FROM (SELECT 1 FROM embeddings q, (SELECT vec_id FROM embeddings LIMIT 5))")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and probing of as few cells as hold 0.95 of the exact hits, against the exact search: hits found, and whether 0.9 of the exact ones are among them."""
    queries, rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows, scratch_dir(spark))
    exact = kept(retrieval.search(queries, rows, k=5))  # told from once for the number of cells and once for the recall
    found = kept(index.search(queries, k=5, probe=index.probe_for(queries, 0.95, exact=exact)))
    return found.agg(F.count("*").alias("hits")).withColumn("enough", F.lit(recall(found, exact) >= 0.9))


_CHANGED_KNN = _KNN.replace("FROM embeddings", "FROM (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings)")


@query(f"WITH {_CHANGED_KNN.format(where='true', k=5)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM h")
def vector_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the index's vectors turned round by an upsert, then the nearest of every vector."""
    _, rows = _vectors(spark, sf_dir)
    turned = rows.where("doc_id % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = VectorIndex.build(rows, scratch_dir(spark))
    index.upsert(turned)
    queries = rows.where("doc_id % 5 <> 0").unionByName(turned).withColumnRenamed("doc_id", "query_id")
    return index.search(queries, k=5, probe=None, refine=None).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


# ---- tables in versions ----


_AFTER = """WITH o AS (SELECT o_orderkey, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'twice' WHEN o_orderkey % 2 = 0 THEN 'once' ELSE status END AS status, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE price END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'second' END AS note
FROM o WHERE o_orderkey % 7 <> 0 OR o_orderkey % 3 = 0"""


def _changes(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Orders as a table, then an upsert of every second, a delete of every seventh and an upsert of every third with a new column."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    versions.create(orders, path, key="o_orderkey", buckets=8)
    versions.upsert(orders.where("o_orderkey % 2 = 0").withColumn("status", F.lit("once")), path)
    versions.delete(orders.where("o_orderkey % 7 = 0"), path)
    versions.upsert(orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("twice").alias("status"), F.lit(-1.0).alias("price"), F.lit("second").alias("note")), path)


@query(_AFTER)
def versioned_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    _changes(spark, sf_dir, path)
    return versions.read(spark, path)


@query(_AFTER)
def versioned_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after compaction, when older versions are deleted."""
    path = scratch_dir(spark)
    _changes(spark, sf_dir, path)
    versions.compact(spark, path)
    versions.vacuum(spark, path)
    return versions.read(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'once' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0")
def versioned_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier version, read after later ones."""
    path = scratch_dir(spark)
    _changes(spark, sf_dir, path)
    return versions.read(spark, path, version=3).select("o_orderkey", "status")


# ---- joins by time ----


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


_PAIRS = "SELECT c.event_id AS click, p.event_id AS purchase FROM events c {how} JOIN events p ON p.event_type = 'purchase' AND c.user_id = p.user_id AND p.ts >= c.ts AND p.ts < c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click'"


def _streamed(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Clicks and purchases as two streams, joined while they come. Far events of no user at the end of each let all others out."""
    folder = scratch_dir(spark)
    sides = []
    for kind in ("click", "purchase"):
        df = _events(spark, sf_dir, kind)
        end = df.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(0.0).alias("value"))
        df.unionByName(end).write.parquet(f"{folder}/{kind}")
        sides.append(spark.readStream.schema(df.schema).parquet(f"{folder}/{kind}"))
    joined = events.followed(*sides, how=how).select(F.col("event_id").alias("click"), F.col("next_event_id").alias("purchase"))
    joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(joined.schema).parquet(f"{folder}/out").where("click >= 0")  # a filter on the stream would go below its watermark


@query(_PAIRS.format(how=""))
def stream_followed_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "inner")


@query(_PAIRS.format(how="LEFT"))
def stream_followed_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "left")


@query(_PAIRS.format(how="LEFT"))
def batch_followed_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over whole tables."""
    return events.followed(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase"), how="left").select(F.col("event_id").alias("click"), F.col("next_event_id").alias("purchase"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice in a stream, once."""
    folder = scratch_dir(spark)
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for _ in range(2):
        df.write.mode("append").parquet(f"{folder}/in")
    stream = events.once(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), "event_id", watermark="60 days").select("event_id", "user_id", "event_type")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_LAST = "SELECT c.event_id AS purchase, (SELECT max_by(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.event_type = 'click' AND e.user_id = c.user_id AND e.ts <= c.ts{more}) AS click FROM events c WHERE c.event_type = 'purchase'"


@query(_LAST.format(more=""))
def as_of_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it."""
    found = temporal.as_of_join(_events(spark, sf_dir, "purchase"), _events(spark, sf_dir, "click"), key="user_id", order="event_id")
    return found.select(F.col("event_id").alias("purchase"), F.col("last_event_id").alias("click"))


@query(_LAST.format(more=" AND e.ts >= c.ts - INTERVAL 2 HOURS").replace("e.user_id = c.user_id", "(e.user_id % 2) = (c.user_id % 2)").replace("c.event_id AS purchase", "c.event_id AS purchase, c.user_id % 2 AS side"))
def as_of_last_click_of_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two keys, each with half of all rows, and two hours at most."""
    half = lambda kind: _events(spark, sf_dir, kind).withColumn("side", F.col("user_id") % 2)
    found = temporal.as_of_join(half("purchase"), half("click").drop("user_id"), key="side", order="event_id", tolerance="2 hours", bucket="6 hours")
    return found.select(F.col("event_id").alias("purchase"), "side", F.col("last_event_id").alias("click"))


# ---- statistics that grow ----


@query("""SELECT 'c_mktsegment' AS "column", count(*) AS rows, NULL::DOUBLE AS low, NULL::DOUBLE AS high, count(DISTINCT c_mktsegment) AS known, (SELECT list(c_mktsegment || ':' || n ORDER BY n DESC, c_mktsegment) FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) AS frequent, true AS near FROM customer
UNION ALL SELECT 'c_acctbal', count(*), min(c_acctbal)::DOUBLE, max(c_acctbal)::DOUBLE, NULL, NULL, true FROM customer""")
def sketched_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as three batches, one of them recorded twice; figures from what is stored of each. near: distinct counts and quantiles within 5% of exact ones."""
    path, columns = scratch_dir(spark), ["c_mktsegment", "c_acctbal"]
    customers = table(spark, sf_dir, "customer")
    for batch in (0, 1, 2, 0):
        sketches.record(customers.where(F.col("c_custkey") % 3 == batch), path, str(batch), columns)
    told, exact = sketches.statistics(spark, path), sketches.exact(customers, columns).select("column", F.col("distinct").alias("d"), F.col("quantiles").alias("q"))
    span = F.col("high") - F.col("low")
    near = (F.abs(F.col("distinct") - F.col("d")) <= 0.05 * F.col("d")) & F.coalesce(F.forall(F.arrays_zip("quantiles", "q"), lambda x: F.abs(x["quantiles"] - x["q"]) <= 0.05 * span), F.lit(True))
    few = F.col("column") == "c_mktsegment"
    listed = F.transform(F.array_sort(F.transform("frequent", lambda x: F.struct((-x["n"]).alias("less"), x["value"].alias("value")))), lambda x: F.concat(x["value"], F.lit(":"), (-x["less"]).cast("string")))
    return told.join(exact, "column").select("column", "rows", "low", "high", F.when(few, F.col("distinct")).alias("known"), F.when(few, listed).alias("frequent"), near.alias("near"))
