"""Exact de-duplication by a tree merge of sorted digest runs, in DataFrame functions only.

Each row becomes a digest entry: SHA-256 of the normalised text, with its length
and a second, independent hash that verify the digest, so that two different
texts can't be merged by a collision of one of them. The entries of a partition, sorted by
digest, are a run. In every round ``fan_in`` neighbouring runs are exchanged and merged into
one: the entries are sorted by digest, and one pass over them in that order verifies
equal ones and leaves one entry with the retained id and the sum of their counts. After
the last round one run is left. A run isn't one task's: it is dealt by (run, digest), so
no round has a task that grows with the corpus, and a text with a third of all rows is one
entry for each run after the first merge, which comes before anything is shuffled.

The retained id travels in a struct. Spark can't update a struct within a hash
table, so it plans each merge as a sort and an aggregate over the sorted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keyed, stored

RUNS, FAN_IN = 64, 4


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, check (length and second hash), run; null text counts as empty."""
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.spark_partition_id().alias("at")).select(
        "doc_id",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("size"),
        F.xxhash64("norm").alias("check"),
        F.col("at"),
    )


def merge_runs(entries: DataFrame, *, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One entry per distinct text: digest, size, check, keep_id, group_size.

    entries: as ``digests`` returns them. keep: "min" retains the smallest id of a
    group of copies, "max" the largest; null ids lose to any other.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be at least 1 and fan_in at least 2")
    best, null_last = (F.min, F.col("doc_id").isNull()) if keep == "min" else (F.max, F.col("doc_id").isNotNull())
    key = ["run", "digest", "size", "check"]
    held = F.struct(null_last.alias("rank"), F.col("doc_id").alias("id"))
    run = entries.select(F.pmod(F.col("at"), F.lit(runs)).alias("run"), "digest", "size", "check", held.alias("held"), F.lit(1).cast("long").alias("group_size"))
    left = runs
    while True:
        run = run.groupBy(*key).agg(best("held").alias("held"), F.sum("group_size").alias("group_size"))
        if left == 1:
            return run.select("digest", "size", "check", F.col("held.id").alias("keep_id"), "group_size")
        left = -(-left // fan_in)
        run = run.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. An empty table gives no
    rows. A repeated row is a copy of itself: both have the same id, both count
    in group_size and both are kept if their id is. Null ids lose to any other id;
    a group of null ids only has keep_id null and its rows are kept. Very long texts are
    hashed whole. Other columns, whatever their names, have no effect.
    """
    entries = stored(digests(docs, id_col=id_col, text_col=text_col), "digests")
    merged = merge_runs(entries, keep=keep, runs=runs, fan_in=fan_in)
    return entries.join(merged, ["digest", "size", "check"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows whose normalised text another row has; all columns stay, whatever their names.

    Exactly one row of each text stays: that of the largest (or smallest) id, null ids
    losing to any other, and of several such rows any one. Null and empty texts
    are one text. An empty table stays empty.
    """
    held = keyed(docs, "exact_rows")
    # Rows are told apart by a key of their own, which orders rows of one id; null ids come last either way.
    parts = [F.col(f"row.`{id_col}`").alias("id"), F.col("key")]
    if keep == "min":
        parts.insert(0, parts[0].isNull().alias("none"))
    entries = stored(digests(held.select(F.struct(*parts).alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))), "digests")
    stay = merge_runs(entries, keep=keep).where("group_size > 1").select("digest", "size", "check", F.col("keep_id.key").alias("stays"))
    gone = stored(entries.join(stay, ["digest", "size", "check"]).where("doc_id.key <> stays").select("doc_id.key"), "gone")
    return held.join(gone, "key", "left_anti").select("row.*")


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
