"""Retrieval evaluation: per-query hits, summary, misses, error analysis, gated report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .keywords import most_common

MIN_KEYWORD, MIN_CATEGORY = 0.8, 0.9


def evaluate(queries: DataFrame, hits: DataFrame, *, k: int) -> DataFrame:
    """One row per query (id, expected_keyword, expected_category, ...): hit flags, reciprocal ranks, best hit, retrieved.

    hits: id, rank, doc_id, keyword, category, subcategory, score, distance. A query
    without hits stays, with no hit at any rank.
    """
    expected = queries.select("id", "expected_keyword", "expected_category")
    marked = hits.where(F.col("rank") <= k).join(expected, "id").withColumn("_kw", T.keyword_matches("keyword", "expected_keyword")).withColumn("_cat", T.category_matches("category", "expected_category"))
    item = F.struct("rank", "doc_id", "keyword", "category", "subcategory", "score", "distance")

    def reciprocal(hit: str) -> Column:
        return F.coalesce(1.0 / F.min(F.when(F.col(hit), F.col("rank"))), F.lit(0.0))

    each = marked.groupBy("id").agg(
        F.max((F.col("rank") == 1) & F.col("_kw")).alias("hit_keyword_at_1"), F.max("_kw").alias("hit_keyword_at_k"),
        F.max((F.col("rank") == 1) & F.col("_cat")).alias("hit_category_at_1"), F.max("_cat").alias("hit_category_at_k"),
        reciprocal("_kw").alias("rr_keyword"), reciprocal("_cat").alias("rr_category"),
        F.array_sort(F.collect_list(item)).alias("retrieved"),
    )
    top = F.try_element_at("retrieved", F.lit(1))
    found = queries.join(each, "id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("hit_keyword_at_1", "hit_keyword_at_k", "hit_category_at_1", "hit_category_at_k")}
    empty = F.array().cast(each.schema["retrieved"].dataType)
    return found.withColumns(flags | {c: F.coalesce(c, F.lit(0.0)) for c in ("rr_keyword", "rr_category")} | {"retrieved": F.coalesce("retrieved", empty)}).withColumns(
        {"top1_keyword": F.coalesce(top["keyword"], F.lit("")), "top1_category": F.coalesce(top["category"], F.lit("")), "top1_score": top["score"], "top1_distance": top["distance"]}
    )


def require_expectations(queries: DataFrame) -> DataFrame:
    """Eval queries with their retrieval query, or an error for the first without one or without an expectation."""
    known = queries.withColumn("retrieval_query", T.first_text(*(c for c in ("normalized_question", "question", "query") if c in queries.columns)))
    bad = (F.col("retrieval_query") == "") | ((T.text_or_empty("expected_keyword") == "") & (T.text_or_empty("expected_category") == ""))
    first = known.where(bad).limit(1).collect()
    if first:
        raise ValueError(f"eval query without a question or an expectation: {first[0].asDict()}")
    return known


def summarize(results: DataFrame, *, k: int) -> DataFrame:
    """One row of rates; no rows give zeros, and nulls for the means of scores."""
    n = F.count("*")
    rate = lambda c: F.when(n == 0, 0.0).otherwise(F.round(c / n, 4))
    hit = lambda c: rate(F.count_if(c))
    none = F.count_if(F.size("retrieved") == 0)
    return results.agg(
        n.alias("total"), F.lit(k).alias("top_k"), none.alias("no_result_count"), rate(none).alias("no_result_rate"),
        hit(F.col("hit_keyword_at_1")).alias("top1_keyword_accuracy"), hit(F.col("hit_keyword_at_k")).alias("topk_keyword_accuracy"),
        hit(F.col("hit_category_at_1")).alias("top1_category_accuracy"), hit(F.col("hit_category_at_k")).alias("topk_category_accuracy"),
        rate(F.sum("rr_keyword")).alias("mrr_keyword"), rate(F.sum("rr_category")).alias("mrr_category"),
        F.round(F.avg("top1_score"), 6).alias("avg_top1_score"), F.round(F.avg("top1_distance"), 6).alias("avg_top1_distance"),
    )


def misses(results: DataFrame) -> DataFrame:
    """Results whose keyword was not found at any rank, with slim hits; unknown isn't missed."""
    slim = F.transform("retrieved", lambda x: F.struct(x["rank"].alias("rank"), x["doc_id"].alias("doc_id"), x["keyword"].alias("keyword"), x["score"].alias("score")))
    return results.where(F.col("hit_keyword_at_k") == F.lit(False)).withColumn("retrieved", slim)


def distribution(df: DataFrame, by: str) -> DataFrame:
    """by, n, share: how often each value occurs, in the order of values; a null or blank one as <missing>."""
    value = F.coalesce(F.nullif(T.text_or_empty(by), F.lit("")), F.lit("<missing>"))
    counted = df.groupBy(value.alias(by)).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.join(total).select(by, "n", F.round(F.col("n") / F.col("_all"), 4).alias("share")).orderBy(by)


def wrong_keywords(missed: DataFrame, n: int = 20) -> DataFrame:
    """expected_keyword, keyword, n, rank: for each expected keyword the keywords found instead, a blank one as <missing>."""
    each = missed.select("row_index", "expected_keyword", F.posexplode("retrieved").alias("pos", "hit")).select(
        F.struct("row_index", "pos").alias("row_index"), "expected_keyword", F.coalesce(F.nullif(T.text_or_empty(F.col("hit.keyword")), F.lit("")), F.lit("<missing>")).alias("keyword")
    )
    return most_common(each, ["keyword"], n, within=["expected_keyword"]).select("expected_keyword", "keyword", "n", "rank")


def wrong_pairs(missed: DataFrame, n: int = 20) -> DataFrame:
    """expected_keyword, keyword, n: pairs of expected and found keywords, most frequent first."""
    each = missed.select("row_index", "expected_keyword", F.posexplode("retrieved").alias("pos", "hit")).select(
        F.struct("row_index", "pos").alias("row_index"), "expected_keyword", T.text_or_empty(F.col("hit.keyword")).alias("keyword")
    ).where("keyword <> ''")
    return most_common(each, ["expected_keyword", "keyword"], n).select("expected_keyword", "keyword", "n")


def with_error_type(missed: DataFrame) -> DataFrame:
    top = F.try_element_at("retrieved", F.lit(1))
    return missed.withColumns({"error_type": T.error_type(F.col("expected_keyword"), top["keyword"]), "top_keyword": F.coalesce(top["keyword"], F.lit("")), "top_doc_id": top["doc_id"], "top_score": top["score"]})


def representative_cases(missed: DataFrame, n: int = 30) -> DataFrame:
    """At most n cases: the best scored of each expected keyword, by how frequent the keyword is, then the best scored of the rest.

    Blank ids count as one id, which is chosen once.
    """
    known = with_error_type(missed).withColumn("_score", F.coalesce("top_score", F.lit(0.0))).withColumn("_id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    keyword = W.partitionBy("expected_keyword")
    ranked = known.withColumn("_n", F.row_number().over(keyword.orderBy(F.desc("_score"), "row_index"))).withColumn("_size", F.count("*").over(keyword)).withColumn("_first", F.min("row_index").over(keyword))
    first = ranked.where("_n = 1").select("*", F.struct(F.lit(0).alias("a"), (-F.col("_size")).cast("double").alias("b"), F.col("_first").alias("c")).alias("_order"))
    rest = ranked.select("*", F.struct(F.lit(1).alias("a"), (-F.col("_score")).alias("b"), F.col("row_index").alias("c")).alias("_order"))
    once = first.unionByName(rest).withColumn("_k", F.row_number().over(W.partitionBy("_id").orderBy("_order"))).where("_k = 1")
    chosen = once.orderBy("_order").limit(n)
    return chosen.withColumn("position", F.row_number().over(W.orderBy("_order"))).drop("_n", "_size", "_first", "_order", "_k", "_score", "_id")


def gated_report(validation: DataFrame, build: DataFrame, retrieval: DataFrame, filtered: DataFrame, *, min_keyword: float = MIN_KEYWORD, min_category: float = MIN_CATEGORY) -> DataFrame:
    """One row: status of four sections and overall (without the filtered one), and recommendations.

    Each input has one row, or none where its file is missing: then its section fails.
    validation: error_count, invalid_docs, warning_count; build: dry_run, total_documents,
    count_after; retrieval and filtered: as ``summarize`` returns them.
    """
    one = validation.sparkSession.range(1).select(F.lit(1).alias("_one"))

    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(1).alias("_one"), F.struct(*df.columns).alias(name))

    all_ = one
    for df, name in ((validation, "v"), (build, "b"), (retrieval, "r"), (filtered, "f")):
        all_ = all_.join(section(df, name), "_one", "left")
    pass_ = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")
    good = lambda s: (F.col(f"{s}.no_result_count") == 0) & (F.col(f"{s}.topk_keyword_accuracy") >= min_keyword) & (F.col(f"{s}.topk_category_accuracy") >= min_category)
    out = all_.select(
        pass_((F.col("v.error_count") == 0) & (F.col("v.invalid_docs") == 0)).alias("validation_status"),
        pass_(~F.col("b.dry_run") & (F.col("b.total_documents") > 0) & (F.col("b.count_after") == F.col("b.total_documents"))).alias("build_status"),
        pass_(good("r")).alias("retrieval_status"), pass_(good("f")).alias("filtered_status"),
        F.coalesce(F.col("v.warning_count") > 0, F.lit(False)).alias("_warned"), F.coalesce(F.col("r.top1_keyword_accuracy") < F.col("r.topk_keyword_accuracy"), F.lit(False)).alias("_deeper"),
    )
    tell = lambda when, name: F.when(when, F.lit(fixed.RECOMMENDATIONS[name]))
    overall = F.when((F.col("validation_status") == "PASS") & (F.col("build_status") == "PASS") & (F.col("retrieval_status") == "PASS"), "PASS").otherwise("FAIL")
    advice = F.array_compact(F.array(tell(F.col("validation_status") != "PASS", "validation"), tell(F.col("_warned"), "warnings"), tell(F.col("build_status") != "PASS", "build"), tell(F.col("retrieval_status") != "PASS", "retrieval"), tell(F.col("_deeper"), "top_k")))
    return out.select(overall.alias("overall_status"), "validation_status", "build_status", "retrieval_status", "filtered_status", advice.alias("recommendations"))


def markdown_table(headers: list[str], rows: list[list]) -> str:
    """Rows of a small report as a table; bars are escaped and line breaks become spaces."""
    line = lambda cells: "| " + " | ".join(str(c).replace("\n", " ").replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


def render_error_report(missed: DataFrame, *, n: int = 20, cases: int = 30) -> str:
    """The error analysis as Markdown; only counts and chosen cases come to the driver."""
    known = with_error_type(missed)
    parts = ["# Keyword misses", f"\nMisses: {missed.count()}\n"]
    for title, by in (("Expected keywords", "expected_keyword"), ("Categories", "expected_category")):
        found = most_common(known, [by], n).collect()
        parts += [f"## {title}\n", markdown_table([by, "n"], [[r[by], r["n"]] for r in found]), ""]
    parts += ["## Error types\n", markdown_table(["error_type", "n", "share"], [[r[0], r[1], f"{r[2]:.2%}"] for r in distribution(known, "error_type").collect()]), ""]
    parts += ["## Wrong pairs\n", markdown_table(["expected", "found", "n"], [[r[0], r[1], r[2]] for r in wrong_pairs(missed, n).collect()]), ""]
    chosen = representative_cases(missed, cases).orderBy("position").select("id", "expected_keyword", "top_keyword", "top_score", "error_type").collect()
    parts += ["## Cases\n", markdown_table(["id", "expected", "found", "score", "type"], [list(r) for r in chosen])]
    return "\n".join(parts) + "\n"


def render_gated_report(report: DataFrame) -> str:
    """The one row of ``gated_report`` as Markdown."""
    row = report.first()
    sections = [("Validation", "validation_status"), ("Index build", "build_status"), ("Retrieval", "retrieval_status"), ("Retrieval with category filter", "filtered_status")]
    parts = ["# Retrieval report", f"\nOverall: **{row['overall_status']}**\n", markdown_table(["Section", "Status"], [[name, row[c]] for name, c in sections]), ""]
    return "\n".join([*parts, "## Recommendations\n", *(f"- {r}" for r in row["recommendations"] or ["None."])]) + "\n"
