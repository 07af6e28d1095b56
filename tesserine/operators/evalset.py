"""Evaluation sets: records from raw rows, coverage, first-wins de-duplication, seeded samples, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import kept
from .contexts import first_wins
from .validation import beside, counter


def seeded(seed: int | str, c: Column) -> Column:
    """A shuffling order that depends on the seed and the id only; a null id counts as the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))


def build_records(rows: DataFrame, split: str) -> DataFrame:
    """Eval records; rows without a question, keyword or category give none."""
    image, question_id = T.text_or_empty("image_id"), T.text_or_empty("question_id")
    made = rows.select(
        "row_index", F.when((image != "") & (question_id != ""), F.concat_ws("_", image, question_id)).otherwise(image).alias("id"),
        T.text_or_empty("question").alias("question"), T.first_text("standalone_question", "question").alias("normalized_question"),
        T.text_or_empty("keyword").alias("expected_keyword"), T.text_or_empty("category").alias("expected_category"), T.text_or_empty("subcategory").alias("expected_subcategory"),
        F.lit(split).alias("source_split"),
    )
    return made.where("question <> '' AND normalized_question <> '' AND expected_keyword <> '' AND expected_category <> ''")


def covered(records: DataFrame, documents: DataFrame, *, keyword: str = "keyword") -> DataFrame:
    """Records whose expected keyword some document has, in loose form; an error if no document has any."""
    known = documents.select(T.loose_key(keyword).alias("_kw")).where("_kw <> ''").distinct()
    if not known.take(1):
        raise ValueError("no document has a keyword")
    return records.join(known, T.loose_key("expected_keyword") == F.col("_kw"), "left_semi")


#: Samples of so many rows are found by ranks, larger ones by counts of hashes; levels of counts for groups.
RANKED, LEVELS = 10_000, 2


def deduplicate(records: DataFrame) -> DataFrame:
    """The first of records with the same question, keyword and category in loose form."""
    return first_wins(records, [T.loose_key(c) for c in ("normalized_question", "expected_keyword", "expected_category")], ["row_index"])


def cap_per_group(df: DataFrame, by: str, most: int, *, seed: int | str, id_col: str = "id", ranked: int = RANKED) -> DataFrame:
    """At most so many rows of each group, in seeded order. Up to ``ranked`` are found by ranks, of which each task sends no more; more by counts."""
    if most > ranked:
        quotas = df.groupBy(F.col(by).alias("_by")).agg(F.lit(most).cast("long").alias("_left"))
        return first_of_groups(df, by, quotas, seed=seed, id_col=id_col, ranked=ranked)
    rank = W.partitionBy(by).orderBy(seeded(seed, F.col(id_col)), id_col)
    return df.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= most).drop("_n")


def first_of_groups(df: DataFrame, by: str, quotas: DataFrame, *, seed: int | str, id_col: str = "id", levels: int = LEVELS, ranked: int = RANKED) -> DataFrame:
    """Of each group the first rows in seeded order, as many as ``quotas`` (_by, _left) says.

    The order is that of a hash. Rows are counted by its first digits: whole counts that a group's quota covers are in, what lies
    beyond it is out, and only the one that the quota cuts goes on to the next digits, a 4,096th of a group each time. Ranks
    are given to what is left of that, and no group is sorted.
    """
    rest, out = df.withColumns({"_key": seeded(seed, F.col(id_col)), "_by": F.col(by)}), None
    for level in range(levels):
        dealt = rest.withColumn("_head", F.substring("_key", 1 + 3 * level, 3))
        counts = dealt.groupBy("_by", "_head").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(W.partitionBy("_by").orderBy("_head").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
        cut = counts.withColumn("_before", before).join(quotas.withColumnRenamed("_by", "_g"), F.col("_by").eqNullSafe(F.col("_g"))).where("_before < _left")
        cut = kept(cut.select("_g", F.col("_head").alias("_h"), (F.col("_before") + F.col("_n") <= F.col("_left")).alias("_whole"), (F.col("_left") - F.col("_before")).alias("_left")))
        met = dealt.join(cut, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_head") == F.col("_h")))
        whole = met.where("_whole").select(*df.columns)
        out = whole if out is None else out.unionByName(whole)
        rest, quotas = met.where("NOT _whole").select(*df.columns, "_key", "_by"), cut.where("NOT _whole").select(F.col("_g").alias("_by"), "_left")
    near = rest.withColumn("_n", F.row_number().over(W.partitionBy("_by").orderBy("_key", id_col)))
    near = near.join(quotas.withColumnRenamed("_by", "_g"), F.col("_by").eqNullSafe(F.col("_g"))).where("_n <= _left").select(*df.columns)
    return near if out is None else out.unionByName(near)


def balanced_sample(df: DataFrame, by: str, n: int, *, seed: int | str, id_col: str = "id", ranked: int = RANKED) -> DataFrame:
    """n rows, one of each group in turn, groups in order. Beyond ``ranked`` rows, each group's share is worked out from its size."""
    if n <= ranked:
        rank = W.partitionBy(by).orderBy(seeded(seed, F.col(id_col)), id_col)
        return df.withColumn("_n", F.row_number().over(rank)).orderBy("_n", by).limit(n).drop("_n")
    # A row for each group: with groups by size, the sum of what they give if all give as many as this one, or all they have.
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_c"))
    upto = W.orderBy("_c", "_by").rowsBetween(W.unboundedPreceding, 0)
    turns = sizes.select("_by", "_c", F.sum("_c").over(upto).alias("_sum"), F.row_number().over(W.orderBy("_c", "_by")).alias("_i"), F.count("*").over(W.partitionBy()).alias("_m"))
    turns = turns.withColumn("_all", F.col("_sum") + (F.col("_m") - F.col("_i")) * F.col("_c"))
    full = turns.agg(F.max(F.when(F.col("_all") <= n, F.struct("_all", "_i", "_c"))).alias("f"), F.max("_m").alias("m")).first()
    spent, i, each = (full["f"]["_all"], full["f"]["_i"], full["f"]["_c"]) if full["f"] else (0, 0, 0)
    more, over = divmod(n - spent, full["m"] - i) if full["m"] and full["m"] > i else (0, 0)
    turn = each + more
    late = turns.where(F.col("_c") > turn).withColumn("_at", F.row_number().over(W.orderBy("_by"))).select(F.col("_by").alias("_g"), "_at")
    quotas = sizes.join(late, F.col("_by").eqNullSafe(F.col("_g")), "left").select("_by", (F.least("_c", F.lit(turn)) + F.when(F.col("_at") <= over, 1).otherwise(0)).cast("long").alias("_left"))
    return first_of_groups(df, by, kept(quotas.where("_left > 0")), seed=seed, id_col=id_col, ranked=ranked)


def random_cap(df: DataFrame, n: int, *, seed: int | str, id_col: str = "id", ranked: int = RANKED) -> DataFrame:
    """n rows, first in seeded order.

    Up to ``ranked`` come as each task's first n. For more, the hash of the last one is found from counts by
    its digits, a 4,096th of the rows each time, and rows up to it are filtered; nothing is sorted or brought to one task.
    """
    key = seeded(seed, F.col(id_col))
    if n <= ranked:
        return df.orderBy(key, id_col).limit(n)
    prefix, left = "", n
    while True:
        at = len(prefix)
        near = df.select(key.alias("k")).where(F.col("k").startswith(prefix))
        counts = near.groupBy(F.substring("k", at + 1, 3).alias("h")).count().orderBy("h").collect()  # 4,096 at most
        for r in counts:
            if r["count"] >= left:
                break
            left -= r["count"]
        else:
            return df  # there are no more than n
        prefix += r["h"]
        if r["count"] == left:
            return df.where(F.substring(key, 1, len(prefix)) <= prefix)
        if len(prefix) >= 30:  # rows of one id: any of them
            return df.where(F.substring(key, 1, len(prefix)) < prefix).unionByName(df.where(F.substring(key, 1, len(prefix)) == prefix).limit(left))


def sample(records: DataFrame, *, max_per_split: int | None = None, max_per_category: int | None = None, seed: int = 42) -> DataFrame:
    """Records under both caps: first per category, then overall, in turn over categories if the first cap is set."""
    out = records
    if max_per_category is not None:
        out = cap_per_group(out, "expected_category", max_per_category, seed=seed)
    if max_per_split is not None:
        out = random_cap(out, max_per_split, seed=seed) if max_per_category is None else balanced_sample(out, "expected_category", max_per_split, seed=seed)
    return out


def split_stats(stages: dict[str, DataFrame], *, category: str = "expected_category") -> DataFrame:
    """One row: <stage>_count of each stage, the share of valid records that are covered, and categories of the last as a map."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = reduce(DataFrame.unionByName, counts).agg(*(F.coalesce(F.max(F.when(F.col("stage") == name, F.col("n"))), F.lit(0)).alias(f"{name}_count") for name in stages))
    rate = F.when(F.col("valid_count") == 0, 0.0).otherwise(F.col("covered_count") / F.col("valid_count"))
    out = out.withColumn("keyword_coverage_rate", rate)
    return beside(out, counter(list(stages.values())[-1], category, into="categories"))


def train_test_val(df: DataFrame, by: str, id_col: str, *, seed: int | str = 42) -> DataFrame:
    """Rows with ``split``: per group in seeded order the first 80% train, the next 10% test, the rest val.

    The order is that of a hash, so rows dealt by its first digits are ranked apart from each other and the ranks
    of a group are put together from counts: a group with a third of all rows is 4,096 tasks' at most.
    """
    key = seeded(seed, F.col(id_col))
    dealt = df.withColumns({"_key": key, "_head": F.substring(key, 1, 3)})
    heads = dealt.groupBy(F.col(by).alias("_by"), F.col("_head").alias("_h")).agg(F.count("*").alias("_n"))
    group = W.partitionBy("_by")
    counts = heads.select("_by", "_h", (F.sum("_n").over(group.orderBy("_h").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("_of"))
    near = dealt.withColumn("_at", F.row_number().over(W.partitionBy(by, "_head").orderBy("_key", id_col)))
    found = near.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_head") == F.col("_h")))
    at = F.col("_before") + F.col("_at")
    split = F.when(at <= F.floor(F.col("_of") * 0.8), "train").when(at <= F.floor(F.col("_of") * 0.9), "test").otherwise("val")
    return found.withColumn("split", split).drop("_key", "_head", "_by", "_h", "_before", "_of", "_at")
