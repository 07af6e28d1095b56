"""From search hits to prompts: first-wins de-duplication, re-ranking, context blocks, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

MAX_CHARS = 3500


def first_wins(df: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_subjects(hits: DataFrame) -> DataFrame:
    """Of each query's hits with one subject, the best ranked; a hit without a keyword is its own subject."""
    subject = F.coalesce(F.nullif(T.matching_key(F.col("keyword")), F.lit("")), F.concat(F.lit("\x00"), F.col("doc_id").cast("string")))
    return first_wins(hits.withColumn("_subject", subject), ["query_id", "_subject"], ["rank"]).drop("_subject")


def bonus(query: Column, keyword: Column, category: Column) -> Column:
    """What a hit gains or loses for a broad question about the new year."""
    key = T.matching_key(keyword)
    gain = F.when(key == fixed.BROAD_KEYWORD, fixed.BROAD_KEYWORD_BONUS).when(category == fixed.BROAD_CATEGORY, fixed.BROAD_CATEGORY_BONUS).otherwise(0.0)
    loss = F.when(key.isin(fixed.NARROW_KEYWORDS), fixed.NARROW_PENALTY).otherwise(0.0)
    return F.when(T.is_broad_new_year_question(query), gain - loss).otherwise(0.0)


def rerank(hits: DataFrame) -> DataFrame:
    """Hits with ``position`` by score and bonus, then score, then rank."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    total = score + bonus(F.col("query"), F.col("keyword"), F.col("category"))
    by = W.partitionBy("query_id").orderBy(F.desc(total), F.desc(score), F.asc("rank"))
    return hits.withColumn("position", F.row_number().over(by))


def formatted(position: Column, *, metadata: bool = True, title: str = "Cultural Context", subcategory: bool = True) -> Column:
    """One context as text."""
    head = F.concat(F.lit(f"[{title} "), position.cast("string"), F.lit("]\n"))
    if not metadata:
        return F.concat(head, F.col("content"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [F.lit("doc_id: "), blank("doc_id"), F.lit("\nkeyword: "), blank("keyword"), F.lit("\ncategory: "), blank("category")]
    if subcategory:
        lines += [F.lit("\nsubcategory: "), blank("subcategory")]
    return F.concat(head, *lines, F.lit("\ncontent:\n"), blank("content"))


def cut(block: Column, most: int | None, *, zero_cuts: bool = False) -> Column:
    """A block of at most so many characters, without white space at a cut end."""
    if most is None or (not most and not zero_cuts):
        return block
    return F.when(F.char_length(block) > most, F.regexp_replace(F.substring(block, 1, most), r"(?U)\s+$", "")).otherwise(block)


def context_blocks(hits: DataFrame, *, position: str = "position", max_chars: int | None = MAX_CHARS, metadata: bool = True) -> DataFrame:
    """query_id, context_block: each query's contexts in order, as one text."""
    each = hits.select("query_id", F.struct(F.col(position).alias("at"), formatted(F.col(position), metadata=metadata).alias("text")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n\n")
    return each.groupBy("query_id").agg(cut(T.strip(joined), max_chars).alias("context_block"))


def plain_blocks(hits: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """query_id, context_block: hits in search order, under plain titles and without subcategory."""
    each = hits.select("query_id", F.struct(F.col("rank").alias("at"), formatted(F.col("rank"), title="Context", subcategory=False).alias("text")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n\n")
    return each.groupBy("query_id").agg(cut(joined, max_chars, zero_cuts=True).alias("context_block"))


def build_context(queries: DataFrame, hits: DataFrame, *, max_chars: int | None = MAX_CHARS, metadata: bool = True) -> DataFrame:
    """query_id, query, context_block for each query, blank where it has no hits."""
    asked = queries.select("query_id", "query")
    best = rerank(distinct_subjects(hits.join(asked, "query_id")))
    return asked.join(context_blocks(best, max_chars=max_chars, metadata=metadata), "query_id", "left").fillna("", ["context_block"])


def context_list(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, contexts: each query's contexts as ``build_context`` orders them, with their metadata, distance and score; empty without hits."""
    asked = queries.select("query_id", "query")
    best = rerank(distinct_subjects(hits.join(asked, "query_id")))
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id", "content", "keyword", "category", "subcategory", "distance", "score"))).alias("contexts"))
    return asked.select("query_id").join(listed, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast(listed.schema["contexts"].dataType)))


def prompt(question: Column, context: Column) -> Column:
    """The prompt for a question; an error if it is blank."""
    q, c = T.text_or_empty(question), T.text_or_empty(context)
    text = F.when(c == "", F.concat(F.lit(fixed.PROMPT_WITHOUT), q)).otherwise(F.concat(F.lit(fixed.PROMPT_WITH), q, F.lit(fixed.PROMPT_MIDDLE), c))
    return F.when(q == "", F.raise_error(F.lit("question cannot be empty."))).otherwise(text)


def prepare_prompts(requests: DataFrame, hits: DataFrame, *, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """query_id, query, context_block, prompt: the normalized question, or the question, with its contexts."""
    queries = requests.select("query_id", T.first_text("normalized_question", "question").alias("query"))
    return build_context(queries, hits, max_chars=max_chars).withColumn("prompt", prompt(F.col("query"), F.col("context_block")))


def top_context_column(records: DataFrame, hits: DataFrame, *, key: str = "query_id") -> DataFrame:
    """Records with ``retrieve_context``, the content of their best hit, or blank."""
    best = hits.where("rank = 1").select(key, F.col("content").alias("retrieve_context"))
    return records.drop("retrieve_context").join(best, key, "left").fillna("", ["retrieve_context"])
