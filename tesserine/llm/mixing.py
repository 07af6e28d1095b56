"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The table of sources gets its targets by filling water: each source has its
weight's share of all words up to ``max_repeat`` times its own size, and what it
can't take is reshared by weight. All text is blocks of ``block_tokens`` words, of
one size for all sources and inputs, and few words, so that the smallest source still comes near its target.

The number of blocks is fixed first: as many as the targets make together. They go to
the sources with the highest quotients votes / (k + 1/2), k = 0, 1, ..., where a source's
votes are its target in blocks. Sources are dealt into shards of about
``shard_tokens`` words, so that a source with a third of all rows is many tasks', and a
source's blocks go to its shards in the same way, by the words they hold.

No quotient is ranked that can't matter: a divisor that gives out too few blocks for
certain and one that gives out too many leave about two quotients for each unit
between them, and only those compete: sources, then groups of a source's shards, then the shards of a group, so that no
window holds more than ``GROUP`` units twice over.

Whole passes over a shard come first. The blocks of the last, partial pass are those from a
seeded one on, in the seeded order of the shard's documents and round its end: mostly whole documents, with two cut ones at most.
That choice has a closed form, and no block is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, keyed, stored

SEED, BLOCK, SHARD, REPEAT = "mix-1", 4, 1 << 20, 3
#: Shards that compete in one window.
GROUP = 4096


def _digits(*parts: Column) -> Column:
    """A seeded number below 2 to the 60 that DuckDB gives as well."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, *, max_repeat: int = REPEAT, weights: int = 3) -> DataFrame:
    """From rows (source, source_size): source, source_size, weight, target.

    Sources by code point, null last, weigh 1, 2, ..., ``weights``, repeating. One
    row per source goes through one ordered window; that is as many rows as there
    are sources, not documents.
    """
    ranked = sizes.withColumn("weight", 1 + F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(weights)).cast("long"))
    by = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    level = (
        ranked.withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * max_repeat).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full_before")) / F.col("weight_left"))
    )
    # The level rises with each source that is filled up and falls after the last one.
    return level.withColumn("top", F.max("level").over(every)).select(
        "source", "source_size", "weight", F.least(F.col("source_size") * F.lit(float(max_repeat)), F.col("top") * F.col("weight")).alias("target")
    )


def apportion(units: DataFrame, *, by: list[str], tie: str) -> DataFrame:
    """``units`` with a column quota: each group's ``seats``, one for each of its highest quotients votes / (k + 1/2).

    units: rows with votes (double, not negative) and seats (long, the same for all of
    a group), ``tie`` telling the units of a group apart; of equal quotients the
    first by it wins. A group without votes gets none.
    """
    group = W.partitionBy(*by)
    votes, half = F.col("votes"), F.col("_n") / 2 + 1
    counted = units.withColumns({"_total": F.sum("votes").over(group), "_n": F.count(F.lit(1)).over(group)})
    bound = lambda seats: F.when(F.col("_total") > 0, F.floor(votes * F.greatest(seats, F.lit(0.0)) / F.col("_total") + 0.5)).otherwise(0).cast("long")
    sure = counted.withColumns({"_sure": bound(F.col("seats") - half), "_most": bound(F.col("seats") + half)})
    sure = sure.withColumn("_open", F.col("seats") - F.sum("_sure").over(group))
    each = F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))
    competing = sure.withColumn("_k", F.explode_outer(each)).withColumn("_quotient", votes / (F.col("_k") + 0.5))
    place = F.row_number().over(group.orderBy(F.col("_quotient").desc_nulls_last(), tie, "_k"))
    won = competing.withColumn("_won", (F.col("_k").isNotNull() & (place <= F.col("_open"))).cast("long"))
    return won.groupBy(*units.columns).agg((F.max("_sure") + F.sum("_won")).alias("quota"))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, block_tokens: int = BLOCK, shard_tokens: int = SHARD, max_repeat: int = REPEAT, key_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, passes, quota and, if asked for, key, head, skip and run.

    taken: the words that the mix takes of it, repeats counted, never over
    ``max_repeat`` times its size; it comes from ``passes`` whole copies and the
    words of chosen blocks: its first ``head`` ones, and ``run`` from the word ``skip`` on. quota: the blocks of its shard. Null text has size 0. An empty table
    gives no rows; if every text is empty, all targets are 0. Documents of a shard stand in the order of a seeded
    hash of id and text; repeated rows are documents of their own, alike but for their places.
    Of equal quotients the first source, or shard, wins. Very long texts are counted whole. Other columns, whatever their names, have no effect.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = _digits(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    key = (F.col(key_col) if key_col else F.lit(0)).alias("key")
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), turn.alias("turn"), key), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeat=max_repeat)
    targets = (
        targets.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))
        .withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("votes", F.col("target") / block_tokens)
        .withColumn("seats", F.floor(F.sum("votes").over(W.partitionBy()) + 0.5).cast("long"))
    )
    columns = ["number", "source_size", "target", "shards"]
    sources = stored(apportion(targets.select(F.col("source").alias("source_t"), *columns, "votes", "seats"), by=[], tie="number").select("source_t", *columns, "quota"), "sources")
    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["source_t"])).withColumn("shard", F.pmod(F.col("turn"), F.col("shards")))
    held = dealt.groupBy("number", "shard").agg(F.sum("size").alias("held"), F.max("quota").alias("seats")).withColumn("set", F.expr(f"shard div {GROUP}"))
    sets = apportion(held.groupBy("number", "set").agg(F.max("seats").alias("seats"), F.sum("held").cast("double").alias("votes")), by=["number"], tie="set").select("number", "set", F.col("quota").alias("seats"))
    units = held.drop("seats").join(sets, ["number", "set"]).withColumn("votes", F.col("held").cast("double"))
    shards = apportion(units, by=["number", "set"], tie="shard").select("number", "shard", "held", "quota")
    at = W.partitionBy("number", "shard").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    seeded = _digits(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.lit(":"), F.col("shard").cast("string"))
    chosen = (
        dealt.drop("quota").join(shards, ["number", "shard"])
        .withColumn("stop", F.sum("size").over(at)).withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("give", F.least(F.col("quota") * block_tokens, F.col("held") * max_repeat))
        .withColumn("passes", F.expr("give div greatest(held, 1)"))
        .withColumn("left", F.expr("give - passes * held"))
        .withColumn("first", F.pmod(seeded, F.expr(f"greatest(held div {block_tokens}, 1)")) * block_tokens)
        .withColumn("head", F.expr("greatest(least(first + left - held, stop) - start, 0)"))
        .withColumn("skip", F.expr("greatest(first - start, 0)"))
        .withColumn("run", F.expr("greatest(least(first + left, stop) - start - skip, 0)"))
    )
    return chosen.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("head") + F.col("run")).alias("taken"), "passes", "quota", *(["key", "head", "skip", "run"] if key_col else []))


def mixed_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", seed: str = SEED, **options) -> DataFrame:
    """``docs`` as the mix takes them: all columns, whatever their names, without documents of which nothing is taken.

    A text is its whole copies, one to a line, and on a line of its own the words that chosen blocks hold of it, as a whole
    copy if they hold all. ``chars_col``, where there is such a column, is the text's new length.
    Each row takes what the plan gives to that very row, whatever other rows share its id. Null and empty texts
    take nothing and go, repeated rows take their own shares, and an empty table stays empty. Very long texts are cut like any other.
    """
    held = keyed(docs, "mixed_rows")
    of = lambda c: F.col(f"row.`{c}`")
    ids = held.select("key", of(id_col).alias("doc_id"), of(text_col).alias("text"), of(source_col).alias("source"))
    plan = plan_mix(ids, seed=seed, key_col="key", **options).where("taken > 0").select("key", "size", "passes", "head", "skip", "run")
    words = F.regexp_extract_all(of(text_col), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.concat(F.slice(words, 1, F.col("head").cast("int")), F.slice(words, (F.col("skip") + 1).cast("int"), F.col("run").cast("int"))), " ")
    extra = F.when(F.col("head") + F.col("run") == F.col("size"), of(text_col)).when(F.col("head") + F.col("run") > 0, cut)
    text = F.concat_ws("\n", F.when(F.col("passes") > 0, F.concat_ws("\n", F.array_repeat(of(text_col), F.col("passes").cast("int")))), extra)
    new = {text_col: F.col("mixed"), chars_col: F.char_length("mixed")}
    found = held.join(plan, "key").select("row", text.alias("mixed"))
    return found.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else of(c)).alias(c) for c in docs.columns])


def oracle_sql(docs: str = "documents") -> str:
    """The plan in SQL, for sources of up to ``GROUP`` shards: there all quotients up to each unit's bound are ranked."""
    digits = lambda x: f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"
    return f"""
WITH n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  {digits(f"'{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))")} AS turn FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY source ASC NULLS LAST) AS BIGINT) AS number FROM s),
w AS (SELECT *, 1 + (number - 1) % 3 AS weight FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {REPEAT}) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, number, source_size, least(source_size * {float(REPEAT)}, CAST(max(level) OVER () AS DOUBLE) * weight) AS target,
  CAST(greatest(1, ceil(source_size / {SHARD})) AS BIGINT) AS shards FROM l),
v AS (SELECT *, target / {BLOCK} AS votes, CAST(floor(sum(target / {BLOCK}) OVER () + 0.5) AS BIGINT) AS seats, sum(target / {BLOCK}) OVER () AS total, count(*) OVER () AS units FROM t),
a AS (SELECT number, seats, votes / (k + 0.5) AS quotient, k FROM v, unnest(range(0, least(seats, CAST(floor(votes * (seats + units / 2 + 1) / greatest(total, 1e-9) + 1.5) AS BIGINT)))) AS u(k) WHERE votes > 0),
b AS (SELECT number, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, number, k) AS place FROM a) WHERE place <= seats GROUP BY number),
d AS (SELECT n.*, v.number, v.source_size, v.target, n.turn % v.shards AS shard, coalesce(b.quota, 0) AS seats FROM n JOIN v ON n.source IS NOT DISTINCT FROM v.source LEFT JOIN b USING (number)),
h AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS held, max(seats) AS seats FROM d GROUP BY number, shard),
g AS (SELECT *, count(*) OVER (PARTITION BY number) AS units, sum(held) OVER (PARTITION BY number) AS total FROM h),
e AS (SELECT number, shard, seats, held / (k + 0.5) AS quotient, k FROM g, unnest(range(0, least(seats, CAST(floor(held * (seats + units / 2 + 1) / greatest(total, 1) + 1.5) AS BIGINT)))) AS u(k) WHERE held > 0),
f AS (SELECT number, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY quotient DESC, shard, k) AS place FROM e) WHERE place <= seats GROUP BY number, shard),
p AS (SELECT d.*, h.held, coalesce(f.quota, 0) AS quota, CAST(sum(size) OVER (PARTITION BY d.number, d.shard ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM d JOIN h USING (number, shard) LEFT JOIN f USING (number, shard)),
q AS (SELECT *, stop - size AS start, least(quota * {BLOCK}, held * {REPEAT}) AS give, {digits(f"'{SEED}:' || coalesce(source, '') || ':' || shard")} % greatest(held // {BLOCK}, 1) * {BLOCK} AS first FROM p),
c AS (SELECT *, give // greatest(held, 1) AS passes, give - give // greatest(held, 1) * held AS left_over FROM q)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(first + left_over - held, stop) - start, 0) + greatest(least(first + left_over, stop) - greatest(first, start), 0) AS BIGINT) AS taken FROM c
"""
