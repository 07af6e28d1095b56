"""Validation of loosely typed documents and of record ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def mark_repeats(df: DataFrame, key: str, valid: Column, *, into: str, order: str = "row_index") -> DataFrame:
    """``df`` with whether an earlier row that is valid in itself has the same key: the state of a sequential check.

    That is so if the first valid row of the key comes before. The firsts are a
    minimum that combines on the map side, so a key with very many rows is none of one task's. Rows that aren't valid
    go into it as nulls: a filter would go below what computes their columns, and compute them once for each condition.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(valid, F.col(order))).alias("_first"))
    return df.join(first, F.col(key) == F.col("_key"), "left").withColumn(into, F.coalesce(F.col("_first") < F.col(order), F.lit(False))).drop("_key", "_first")


def _text(value: Column) -> Column:
    """The text of a variant: of a text, itself; of null, false, zero, an empty list or object, blank; of anything else, what it reads as."""
    kind, read = F.coalesce(F.schema_of_variant(value), F.lit("VOID")), F.try_variant_get(value, "$", "string")
    nothing = read.isin("[]", "{}") | F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False))
    return T.strip(F.coalesce(F.when(kind == "STRING", read).when(kind == "BOOLEAN", F.when(read == "true", "True")).when(~nothing, read), F.lit("")))


def parse_documents(raw: DataFrame, *, column: str = "raw", order: str = "row_index") -> DataFrame:
    """Rows of JSON text as typed parts, with what each part is: an array, an object, an integer."""
    of = lambda path: F.try_variant_get("v", path, "variant")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    names = ("keyword", "category", "subcategory", "base_image_id")
    parts = raw.select(F.col(order).alias("row_index"), F.try_parse_json(F.col(column)).alias("v")).select(
        "row_index", *(of(f"$.{c}").alias(c) for c in ("doc_id", "content", "schema_version", "metadata")), *(of(f"$.metadata.{c}").alias(c) for c in (*names, "source_image_ids", "source_count"))
    )
    return parts.select(
        "row_index", *(_text(F.col(c)).alias(c) for c in ("doc_id", "content", "schema_version")),
        F.startswith(kind(F.col("metadata")), F.lit("OBJECT")).alias("has_metadata"),
        *(_text(F.col(c)).alias(c) for c in names),
        F.startswith(kind(F.col("source_image_ids")), F.lit("ARRAY")).alias("ids_listed"),
        F.filter(F.transform(F.coalesce(F.try_variant_get("source_image_ids", "$", "array<variant>"), F.array().cast("array<variant>")), _text), lambda x: x != "").alias("source_image_ids"),
        kind(F.col("source_count")).isin("BIGINT", "BOOLEAN").alias("count_whole"),
        F.coalesce(F.try_variant_get("source_count", "$", "bigint"), F.try_variant_get("source_count", "$", "boolean").cast("bigint")).alias("source_count"),
    )


#: The checks in their order: level, field and name of the message. A check's number is its place, from 1.
CHECKS = (
    ("error", "doc_id", "no_id"), ("error", "doc_id", "duplicate"), ("error", "content", "no_content"), ("warning", "content", "short"),
    ("error", "metadata", "no_metadata"), ("error", "metadata.keyword", "no_keyword"), ("error", "metadata.category", "no_category"),
    ("error", "metadata.category", "bad_category"), ("warning", "metadata.category", "bad_category"),
    ("warning", "metadata.subcategory", "no_subcategory"), ("warning", "metadata.base_image_id", "no_base_image"), ("warning", "metadata.source_image_ids", "ids_not_list"),
    ("warning", "metadata.source_image_ids", "ids_empty"), ("warning", "metadata.source_count", "count_not_int"), ("warning", "metadata.source_count", "count_differs"),
    ("warning", "content", "keyword_absent"), ("warning", "doc_id", "id_format"), ("warning", "doc_id", "id_category"), ("warning", "doc_id", "id_subcategory"),
)
_ERRORS = [k for k, (level, _, _) in enumerate(CHECKS, 1) if level == "error"]


def check_documents(docs: DataFrame, *, strict: bool = True) -> DataFrame:
    """Parsed documents with ``failed`` (the numbers of the ``CHECKS`` that fail, in order) and ``valid``."""
    blank = lambda c: F.col(c) == ""
    parts = F.split("doc_id", r"\|")
    formed = F.size(parts) >= 3
    count = F.when(F.col("count_whole"), F.col("source_count")).otherwise(F.size("source_image_ids").cast("bigint"))
    odd = ~blank("category") & ~F.col("category").isin(fixed.CATEGORIES)
    own_errors = blank("doc_id") | blank("content") | ~F.col("has_metadata") | blank("keyword") | blank("category") | (F.lit(strict) & odd)
    listed, some = F.col("ids_listed"), F.size("source_image_ids") > 0
    checks = [
        blank("doc_id"), None, blank("content"), ~blank("content") & (F.char_length("content") < 20),
        ~F.col("has_metadata"), blank("keyword"), blank("category"),
        F.lit(strict) & odd, F.lit(not strict) & odd,
        blank("subcategory"), blank("base_image_id"), ~listed,
        listed & ~some, ~F.col("count_whole"), listed & some & (count != F.size("source_image_ids")),
        ~blank("keyword") & ~blank("content") & ~F.contains(F.lower("content"), F.lower("keyword")), ~blank("doc_id") & ~formed,
        formed & ~blank("category") & (parts[0] != F.col("category")), formed & ~blank("subcategory") & (F.get(parts, F.lit(1)) != F.col("subcategory")),
    ]
    again = next(k for k, c in enumerate(checks, 1) if c is None)
    # A row's own checks come before rows are told from others of their id, so that contents needn't be shuffled to be counted.
    own = docs.withColumns({"_own": F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(checks, 1) if c is not None))), "_fine": ~own_errors, "source_count": count})
    seen = mark_repeats(own, "doc_id", F.col("_fine"), into="_seen")
    failed = F.when(F.col("_seen"), F.array_sort(F.array_append("_own", F.lit(again)))).otherwise(F.col("_own"))
    # One condition on both: a filter on the row's own part would go below its parsing.
    return seen.withColumns({"failed": failed, "valid": F.when(F.col("_seen"), False).otherwise(F.col("_fine"))}).drop("_seen", "_own", "_fine")


def valid_documents(checked: DataFrame) -> DataFrame:
    """The valid documents, with the metadata that the contract keeps."""
    meta = F.struct("keyword", "category", "subcategory", "base_image_id", "source_image_ids", F.col("source_count").cast("int").alias("source_count"))
    return checked.where("valid").select("row_index", F.coalesce(F.nullif("schema_version", F.lit("")), F.lit("1.0")).alias("schema_version"), "doc_id", "content", meta.alias("metadata"))


def issue_table(checked: DataFrame) -> DataFrame:
    """One row per issue: row_index, pos, level, doc_id, field, message."""
    each = checked.select("row_index", "doc_id", "category", F.posexplode("failed").alias("pos", "k"))
    of = lambda texts: F.element_at(F.array(*map(F.lit, texts)), F.col("k"))
    names = [name for _, _, name in CHECKS]
    message = of([fixed.ISSUES[n] for n in names])
    for name, value in (("duplicate", "doc_id"), ("bad_category", "category")):
        message = F.when(F.col("k").isin([k for k, n in enumerate(names, 1) if n == name]), F.format_string(fixed.ISSUES[name], value)).otherwise(message)
    return each.select("row_index", "pos", of([c[0] for c in CHECKS]).alias("level"), F.nullif("doc_id", F.lit("")).alias("doc_id"), of([c[1] for c in CHECKS]).alias("field"), message.alias("message"))


def first_issues(checked: DataFrame, n: int = 30) -> DataFrame:
    """The first n issues, in order of rows and checks."""
    return issue_table(checked).orderBy("row_index", "pos").limit(n)


def validation_stats(checked: DataFrame) -> DataFrame:
    """One row: total_raw_docs, valid_docs, invalid_docs, error_count, warning_count, unique_keyword_count."""
    errors = F.size(F.array_intersect("failed", F.array(*map(F.lit, _ERRORS))))
    return checked.agg(
        F.count("*").alias("total_raw_docs"), F.count_if("valid").alias("valid_docs"), F.count_if(~F.col("valid")).alias("invalid_docs"),
        F.coalesce(F.sum(errors), F.lit(0)).alias("error_count"), F.coalesce(F.sum(F.size("failed") - errors), F.lit(0)).alias("warning_count"),
        F.count_distinct(F.when(F.col("valid") & (F.col("keyword") != ""), F.col("keyword"))).alias("unique_keyword_count"),
    )


def counter(df: DataFrame, by: str, *, into: str, most: int | None = None, order: str = "row_index") -> DataFrame:
    """One row with a map: how often each value that isn't blank occurs; of the ``most`` most frequent ones, ties as first seen.

    The values must be few (categories, say), or ``most`` given: the map is one row's.
    """
    counted = df.where(T.text_or_empty(by) != "").groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    kept = counted if most is None else counted.orderBy(F.desc("n"), "first", "key").limit(most)
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "key", "n")))
    return kept.agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["n"]))).alias(into))


def full_stats(checked: DataFrame, *, top: int = 30) -> DataFrame:
    """``validation_stats`` with ``categories`` and ``top_keywords`` of the valid documents, as maps, and ``issues`` by level and field.

    One row for each thing to count goes into one aggregation by kind and name, and all figures come from its
    result: the checks run once, not once for each figure. Categories must be few, as their map is one row's.
    """
    thing = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    named = lambda kind, c: F.when(F.col("valid") & (T.text_or_empty(c) != ""), thing(kind, F.col(c)))
    issues = F.transform("failed", lambda k: F.struct(F.lit("issue").alias("kind"), F.element_at(F.array(*(F.lit(f"{level}:{field}") for level, field, _ in CHECKS)), k).alias("name")))
    each = F.concat(F.array(thing("document", F.col("valid").cast("string"))), F.array_compact(F.array(named("category", "category"), named("keyword", "keyword"))), issues)
    counted = checked.select("row_index", F.explode(each).alias("e")).groupBy("e.kind", "e.name").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
    is_a = lambda kind: F.col("kind") == kind
    total = lambda what: F.coalesce(F.sum(F.when(what, F.col("n"))), F.lit(0))
    entries = lambda kind: F.array_sort(F.collect_list(F.when(is_a(kind), F.struct((-F.col("n")).alias("less"), "first", "name", "n"))))
    as_map = lambda found: F.map_from_entries(F.transform(found, lambda e: F.struct(e["name"], e["n"])))
    counts = counted.agg(
        total(is_a("document")).alias("total_raw_docs"), total(is_a("document") & (F.col("name") == "true")).alias("valid_docs"), total(is_a("document") & (F.col("name") == "false")).alias("invalid_docs"),
        total(is_a("issue") & F.col("name").startswith("error")).alias("error_count"), total(is_a("issue") & F.col("name").startswith("warning")).alias("warning_count"),
        F.count_if(is_a("keyword")).alias("unique_keyword_count"), as_map(entries("category")).alias("categories"), as_map(F.array_sort(entries("issue"), lambda x, y: F.when(x["name"] < y["name"], -1).otherwise(1))).alias("issues"),
    )
    # Keywords are ordered before others rather than filtered, so that both figures share what was counted.
    first = counted.orderBy(is_a("keyword").desc(), F.desc("n"), "first", "name").limit(top)
    return beside(counts, first.agg(as_map(entries("keyword")).alias("top_keywords"))).select(*[c for c in counts.columns if c != "issues"], "top_keywords", "issues")


def beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    return reduce(lambda a, b: a.join(b, "_one"), (df.withColumn("_one", F.lit(1)) for df in rows)).drop("_one")


def issue_histogram(checked: DataFrame) -> DataFrame:
    """level_field, n."""
    return issue_table(checked).groupBy(F.concat_ws(":", "level", "field").alias("level_field")).agg(F.count("*").alias("n"))


def check_record_ids(records: DataFrame, *, order: str = "row_index") -> DataFrame:
    """Records with base_image_id and question_id filled in from image_id, and ``problem`` (null if none).

    A problem is a missing, badly formed or repeated image_id, the last only after
    an earlier well formed one.
    """
    image = T.text_or_empty("image_id")
    formed = image.rlike(r"(?s)^(.+)_q(\d+)$")
    fill = lambda c, value: F.coalesce(F.nullif(T.text_or_empty(c), F.lit("")), value) if c in records.columns else value
    known = mark_repeats(records.withColumn("_image", image).withColumn("_formed", formed), "_image", F.col("_formed"), into="_again", order=order)
    problem = F.when(F.col("_image") == "", "missing").when(~F.col("_formed"), "format").when(F.col("_again"), "duplicate")
    return known.withColumns({
        "problem": problem,
        "base_image_id": fill("base_image_id", F.regexp_extract("_image", r"(?s)^(.+)_q(\d+)$", 1)),
        "question_id": fill("question_id", F.concat(F.lit("q"), F.regexp_extract("_image", r"(?s)^(.+)_q(\d+)$", 2))),
    }).drop("_image", "_formed", "_again")


def require_valid_ids(records: DataFrame, *, order: str = "row_index") -> DataFrame:
    """The checked records, or an error that names the first problem."""
    checked = check_record_ids(records, order=order)
    first = checked.where("problem IS NOT NULL").orderBy(order).select(order, "image_id", "problem").first()
    if first:
        raise ValueError(f"row {first[0]}: image_id {first[1]!r} is {first[2]}")
    return checked.drop("problem")


def require_counts(found: int, least: int, what: str) -> None:
    if found < least:
        raise ValueError(f"{what}: {found} rows, at least {least} are needed")
