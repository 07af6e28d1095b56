"""Keyword cleaning: dictionary look-up, record and document normalization, change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def key_table(mapping: DataFrame) -> DataFrame:
    """key, normalized from rows (raw, normalized, row_index): both key forms of each, later rows winning."""
    rows = mapping.select(T.normalize_spaces("raw").alias("raw"), T.normalize_spaces("normalized").alias("normalized"), "row_index").where("raw <> '' AND normalized <> ''")
    both = rows.select(F.explode(F.array(F.struct(F.lower("raw").alias("key"), F.lit(0).alias("form")), F.struct(T.lookup_key("raw").alias("key"), F.lit(1).alias("form")))).alias("k"), "normalized", "row_index").select("k.*", "normalized", "row_index")
    return both.groupBy("key").agg(F.max_by("normalized", F.struct("row_index", "form")).alias("normalized"))


def look_up(df: DataFrame, keys: DataFrame, raw: str, *, into: str = "normalized_keyword") -> DataFrame:
    """``df`` with the normalized keyword: by its lower-case form, else by its key, else itself; and ``changed``.

    The dictionary's side is broadcast if Spark finds it small enough.
    """
    spaced = T.normalize_spaces(raw)
    direct = keys.select(F.col("key").alias("_k1"), F.col("normalized").alias("_n1"))
    loose = keys.select(F.col("key").alias("_k2"), F.col("normalized").alias("_n2"))
    found = df.withColumn("_raw", spaced).withColumn("_key", T.lookup_key(raw)).join(direct, F.lower("_raw") == F.col("_k1"), "left").join(loose, F.col("_key") == F.col("_k2"), "left")
    value = F.when(F.col("_raw") == "", F.lit("")).otherwise(F.coalesce("_n1", "_n2", "_raw"))
    return found.withColumn(into, value).withColumn("changed", F.col(into) != F.col("_raw")).drop("_raw", "_key", "_k1", "_n1", "_k2", "_n2")


def clean_records(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records with keyword_raw, keyword, keyword_slug, standalone_question (and before), changed."""
    raw = T.first_text("keyword_raw", "keyword") if "keyword_raw" in records.columns else T.text_or_empty("keyword")
    found = look_up(records.withColumn("keyword_raw", raw), keys, "keyword_raw")
    before = F.coalesce(F.col("standalone_question"), F.lit(""))
    return found.withColumns({
        "standalone_before": before,
        "standalone_question": T.replace_keyword(before, F.col("keyword_raw"), F.col("normalized_keyword")),
        "keyword": F.col("normalized_keyword"),
        "keyword_slug": T.slug("normalized_keyword"),
    }).drop("normalized_keyword")


def clean_documents(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents (doc_id, content, keyword, category, subcategory) with normalized keyword, header and id."""
    found = look_up(docs.withColumn("keyword_raw", T.text_or_empty("keyword")), keys, "keyword_raw")
    category, name = T.text_or_empty("category"), T.slug("normalized_keyword")
    content = F.coalesce(F.col("content"), F.lit(""))
    marked = F.locate(fixed.CONTEXT_MARKER, content)
    rest = F.when(marked > 0, T.strip(F.substr(content, marked + len(fixed.CONTEXT_MARKER)))).otherwise(content)
    parts = F.split(T.text_or_empty("doc_id"), r"\|")
    return found.withColumns({
        "keyword": F.col("normalized_keyword"),
        "keyword_slug": name,
        "subcategory": T.first_text("subcategory", name),
        "content": T.strip(F.format_string(fixed.DOCUMENT_FORMAT, F.col("normalized_keyword"), category, rest)),
        "doc_id_before": T.text_or_empty("doc_id"),
        "doc_id": F.when((F.size(parts) >= 3) & (category != ""), F.concat_ws("|", category, name, F.element_at(parts, -1))).otherwise(T.text_or_empty("doc_id")),
        "schema_version": F.coalesce(F.nullif(F.col("schema_version"), F.lit("")), F.lit("1.0")) if "schema_version" in docs.columns else F.lit("1.0"),
    }).drop("normalized_keyword")


def unmapped(cleaned: DataFrame) -> DataFrame:
    """keyword_raw, n: plain keywords that no rule changed, most frequent first seen first."""
    left = cleaned.where((F.col("keyword_raw") != "") & ~T.has_vietnamese_accent("keyword_raw") & ~F.col("changed"))
    return left.groupBy("keyword_raw").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row")).orderBy(F.desc("n"), "first_row", "keyword_raw")


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """One row: records, changed, standalone_changed, unique_raw, unmapped."""
    standalone = F.col("standalone_before") != F.col("standalone_question") if "standalone_before" in cleaned.columns else F.lit(False)
    plain = (F.col("keyword_raw") != "") & ~T.has_vietnamese_accent("keyword_raw") & ~F.col("changed")
    return cleaned.agg(F.count("*").alias("records"), F.count_if("changed").alias("changed"), F.count_if(standalone).alias("standalone_changed"), F.count_distinct("keyword_raw").alias("unique_raw"), F.count_if(plain).alias("unmapped"))


def most_common(df: DataFrame, by: list[str], n: int, *, order: str = "row_index", within: list[str] | None = None) -> DataFrame:
    """Counts of ``by``, largest first, ties as first seen; the first n, or the first n of each ``within``."""
    counted = df.groupBy(*(within or []), *by).agg(F.count("*").alias("n"), F.min(order).alias("first_row"))
    if not within:
        return counted.orderBy(F.desc("n"), "first_row", *by).limit(n)
    rank = W.partitionBy(*within).orderBy(F.desc("n"), "first_row", *by)
    return counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
