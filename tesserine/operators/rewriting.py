"""Standalone questions: rules, subject test, earlier results, cache, model, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plugins import Rewriter


def apply_rules(records: DataFrame) -> DataFrame:
    """Records with standalone_question, rewrite_method (template, already_standalone, unchanged), rewrite_source."""
    keyword, question = T.text_or_empty("keyword"), T.text_or_empty("question")
    known = records.withColumn("_new", T.rewrite_question(keyword, question)).withColumn("_named", T.names_subject(keyword, question))
    method = F.when(F.col("_new").isNotNull(), "template").when(F.col("_named"), "already_standalone").otherwise("unchanged")
    source = F.when(F.col("_new").isNotNull(), "template_rule").when(F.col("_named"), "keyword_subject_detected")
    return known.withColumns({"standalone_question": F.coalesce("_new", question), "rewrite_method": method, "rewrite_source": source}).drop("_new", "_named")


def rules_only(records: DataFrame) -> DataFrame:
    """The older path: rules, without the subject test."""
    new = T.rewrite_question(T.text_or_empty("keyword"), T.text_or_empty("question"))
    return records.withColumn("_new", new).withColumns({"standalone_question": F.coalesce("_new", T.text_or_empty("question")), "rewrite_method": F.when(F.col("_new").isNotNull(), "template").otherwise("unchanged")}).drop("_new")


def pending(records: DataFrame) -> DataFrame:
    """Records that only a model can rewrite: unchanged, with a question and a caption."""
    return records.where((F.col("rewrite_method") == "unchanged") & (T.text_or_empty("question") != "") & (T.text_or_empty("vision_caption") != ""))


def restore_existing(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records with a model's results of an earlier output, where image and question are the same; the last one wins."""
    usable = existing.where((T.text_or_empty("image_id") != "") & (F.col("rewrite_method") == "llm") & (T.text_or_empty("standalone_question") != ""))
    last = usable.withColumn("_n", F.row_number().over(W.partitionBy(T.text_or_empty("image_id")).orderBy(F.desc("row_index")))).where("_n = 1")
    source = F.col("rewrite_source") if "rewrite_source" in existing.columns else F.lit(None).cast("string")
    old = last.select(T.text_or_empty("image_id").alias("_image"), T.text_or_empty("question").alias("_question"), F.col("standalone_question").alias("_text"), F.coalesce(source, F.lit("existing_output")).alias("_source"))
    joined = records.join(old, (T.text_or_empty("image_id") == F.col("_image")) & (T.text_or_empty("question") == F.col("_question")), "left")
    return _taken(joined)


def apply_cache(records: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with cached rewrites of pending ones, pending records that remain); cache: cache_key, standalone_question."""
    hits = cache.where(F.coalesce(F.col("standalone_question"), F.lit("")) != "").groupBy(F.col("cache_key").alias("_cache_key")).agg(F.max("standalone_question").alias("_text"))
    keyed = records.withColumn("_cache_key", T.rewrite_key("vision_caption", "question"))
    open_ = (F.col("rewrite_method") == "unchanged") & (T.text_or_empty("question") != "") & (T.text_or_empty("vision_caption") != "")
    done = _taken(keyed.join(hits, "_cache_key", "left").withColumn("_text", F.when(open_, F.col("_text"))).withColumn("_source", F.lit("cache"))).drop("_cache_key")
    remaining = pending(keyed).join(hits, "_cache_key", "left_anti").drop("_cache_key")
    return done, remaining


def _taken(joined: DataFrame) -> DataFrame:
    got = F.col("_text").isNotNull()
    return joined.withColumns({
        "standalone_question": F.coalesce("_text", "standalone_question"),
        "rewrite_method": F.when(got, "llm").otherwise(F.col("rewrite_method")),
        "rewrite_source": F.when(got, F.col("_source")).otherwise(F.col("rewrite_source")),
    }).drop("_text", "_source", "_image", "_question")


def apply_model(records: DataFrame, remaining: DataFrame, rewriter: Rewriter) -> DataFrame:
    """Records with the model's rewrites of what remains; those it gives nothing for have failed.

    The model only sees the remaining rows, as they are joined out before it runs.
    """
    asked = remaining.select("row_index", "keyword", "question", "vision_caption")
    got = rewriter.rewrite(asked).select("row_index", F.nullif(T.text_or_empty("standalone_question"), F.lit("")).alias("_text"), F.lit(True).alias("_asked"))
    joined = records.join(got, "row_index", "left")
    was, has = F.coalesce("_asked", F.lit(False)), F.col("_text").isNotNull()
    return joined.withColumns({
        "standalone_question": F.coalesce("_text", "standalone_question"),
        "rewrite_source": F.when(was & has, "model").when(was, "missing_from_batch_output").otherwise(F.col("rewrite_source")),
        "rewrite_method": F.when(was & has, "llm").when(was, "failed").otherwise(F.col("rewrite_method")),
    }).drop("_text", "_asked")


def parse_rewrites(answers: DataFrame, column: str = "answer") -> DataFrame:
    """The rows of ``answers`` for each rewrite in a model's JSON list (maybe fenced): index, standalone_question; bad items and bad lists give none."""
    items = F.from_json(T.strip_code_fence(column), "array<struct<index: int, standalone_question: string>>")
    good = F.filter(items, lambda x: x["index"].isNotNull() & (T.text_or_empty(x["standalone_question"]) != ""))
    return answers.select("*", F.explode(good).alias("_x")).select(*answers.columns, F.col("_x.index").alias("index"), T.strip(F.col("_x.standalone_question")).alias("standalone_question"))


def cache_rows(records: DataFrame, model: str) -> DataFrame:
    """Rewrites of a model as rows of the cache."""
    return records.where(F.col("rewrite_method") == "llm").select(T.rewrite_key("vision_caption", "question").alias("cache_key"), "standalone_question", "vision_caption", "question", F.lit(model).alias("model"))


METHODS = ("template", "already_standalone", "llm", "unchanged", "failed")


def rewrite_stats(records: DataFrame) -> DataFrame:
    """One row: counts and rates of the methods, caption coverage, mean lengths before and after. No rows give zeros."""
    n = F.count("*")
    rate = lambda c: F.when(n == 0, 0.0).otherwise(F.round(c / n, 4))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    counts = {m: F.count_if(F.col("rewrite_method") == m) for m in METHODS}
    captions = F.count_if(T.text_or_empty("vision_caption") != "")
    return records.agg(
        n.alias("total_questions"),
        *(c.alias(f"{m}_count") for m, c in counts.items()),
        *(rate(c).alias(f"{m}_rate") for m, c in counts.items()),
        captions.alias("with_caption"), (n - captions).alias("missing_caption"), rate(captions).alias("caption_coverage"),
        mean(T.char_count("question")).alias("avg_question_chars"), mean(T.char_count("standalone_question")).alias("avg_standalone_chars"),
        mean(T.word_count("question")).alias("avg_question_words"), mean(T.word_count("standalone_question")).alias("avg_standalone_words"),
    )


def examples(records: DataFrame, n: int = 10) -> DataFrame:
    """The first n records, before and after."""
    return records.orderBy("row_index").limit(n).select(*(c for c in ("row_index", "image_id", "keyword", "question", "standalone_question", "rewrite_method", "rewrite_source") if c in records.columns))
