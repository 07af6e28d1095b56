"""The jobs from a shell: ``python -m tesserine.plans.command JOB ...``; the exit code is 0, or 1 where a check fails.

Inputs and outputs are paths that Spark reads and writes. Statistics, counts and reports are one row or a bounded number
of rows; tables never come to the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evalset, evaluation, keywords, preparation, rewriting, validation
from ..plugins import Embedder, HashEmbedder
from ..session import session
from ..sources import readers, sinks, versions
from . import jobs


#: Changes of an index after which it is compacted.
CHANGES = 8


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON lines file with their line numbers and texts in composed form, in the given schema or, after a scan for it, the one that the file has."""
    if schema is None:
        found = [f for f in spark.read.json(path).schema.fields if f.name != "row_index"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)
    return readers.read_jsonl_numbered(spark, path, schema, compose=True)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a stored index."""
    return versions.read(spark, path)


def _listed(df: DataFrame, name: str, n: int, order: str = "row_index") -> DataFrame:
    """One row with the first n rows as a list."""
    some = df.orderBy(order).limit(n)
    return some.agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in df.columns if c != order)))).alias(name))


def _ranked(counts: DataFrame, name: str, n: int) -> DataFrame:
    """One row with the n most frequent of a table of counts as a list, most frequent first, ties as first seen."""
    some = counts.orderBy(F.desc("n"), "first_row").limit(n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first_row", "keyword_raw", "n")))
    return some.agg(F.transform(listed, lambda x: F.struct(x["keyword_raw"].alias("keyword_raw"), x["n"].alias("n"))).alias(name))


def validate(spark: SparkSession, documents: str, *, stats: str | None = None, lenient: bool = False) -> int:
    """1 if a document has an error."""
    checked = validation.check_documents(validation.parse_documents(readers.read_lines(spark, documents)), strict=not lenient)
    outcome = checked.select("row_index", "doc_id", "category", "keyword", "failed", "valid").persist()  # without contents; parsed once
    try:
        if stats:
            sinks.write_stats(validation.beside(validation.full_stats(outcome), _listed(validation.first_issues(outcome), "first_issues", 30)), stats)
        return int(bool(outcome.where("NOT valid").take(1)))
    finally:
        outcome.unpersist()


def build(spark: SparkSession, documents: str, index: str, *, stats: str | None = None, limit: int | None = None, recreate: bool = False, dry_run: bool = False, buckets: int = 16, embedder: Embedder | None = None) -> int:
    """1, with nothing written, if a document has an error. A dry run writes statistics only."""
    valid, _, counts = jobs.validate_knowledge_base(readers.read_lines(spark, documents))
    if counts.select("error_count").first()[0]:
        return 1
    valid = readers.first_rows(valid, limit)
    flat = valid.select("row_index", "doc_id", "content", "metadata.*")
    there = versions.state(spark, index) is not None
    before = open_index(spark, index).count() if there else 0
    after = before
    if not dry_run:
        new = jobs.embedded_documents(valid, embedder or HashEmbedder())
        if there and not recreate:
            versions.upsert(new, index, order="row_index")
            if len(versions.state(spark, index)["changes"]) >= CHANGES:
                versions.compact(spark, index)
        else:
            versions.create(new, index, key="doc_id", buckets=buckets, order="row_index")
        after = open_index(spark, index).count()
        validation.require_counts(after, flat.select("doc_id").distinct().count(), "the stored index")
    if stats:
        told = preparation.index_stats(preparation.embedding_documents(flat)).withColumns({"dry_run": F.lit(dry_run), "count_before": F.lit(before), "count_after": F.lit(after)})
        maps = [validation.counter(flat, "category", into="categories"), validation.counter(flat, "keyword", into="top_keywords", most=30)]
        sinks.write_stats(validation.beside(told, *maps, _listed(flat.select("row_index", "doc_id", "keyword", "category"), "examples", 10)), stats)
    return 0


def clean(spark: SparkSession, source: str, mapping: str, out: str, *, mode: str = "processed", report: str | None = None, dry_run: bool = False, schema: str | None = None) -> int:
    """Records or documents with normalized keywords; the report has the most frequent keywords that no rule knows."""
    known = readers.mapping_table(spark, readers.read_yaml(mapping, spark))
    rows = records(spark, source, schema)
    if mode == "knowledge":
        rows = rows.select("row_index", "doc_id", "content", *(F.col(f"metadata.{c}").alias(c) for c in ("keyword", "category", "subcategory")))
    done = jobs.clean_keywords(rows, known, mode=mode)
    if report:
        changed = done.where("changed").select("row_index", "keyword_raw", "keyword")
        sinks.write_stats(validation.beside(keywords.cleaning_summary(done), _ranked(keywords.unmapped(done), "unmapped_keywords", 100), _listed(changed, "changed_examples", 20)), report)
    if not dry_run:
        sinks.write_jsonl(done, out)
    return 0


def eval_queries(spark: SparkSession, splits: dict[str, str], documents: str, out: str, *, stats: str | None = None, max_per_split: int | None = None, max_per_category: int | None = None, seed: int = 42) -> int:
    """Eval queries of all splits, and statistics of each as <split>.json in the folder ``stats``."""
    parts = {name: records(spark, path) for name, path in splits.items()}
    known = records(spark, documents).select(F.col("metadata.keyword").alias("keyword"))
    made = jobs.build_eval_queries(parts, known, max_per_split=max_per_split, max_per_category=max_per_category, seed=seed)
    sinks.write_jsonl(made, out)
    for name, rows in parts.items() if stats else ():
        valid = evalset.build_records(rows, name)
        covered = evalset.covered(valid, known)
        stages = {"raw": rows, "valid": valid, "covered": covered, "deduplicated": evalset.deduplicate(covered), "sampled": spark.read.json(out).where(F.col("source_split") == name)}
        sinks.write_stats(evalset.split_stats(stages), f"{stats}/{name}.json")
    return 0


def evaluate(spark: SparkSession, queries: str, index: str, out: str, *, stats: str, k: int = 5, threshold: float | None = None, use_category_filter: bool = False, schema: str | None = None, embedder: Embedder | None = None) -> int:
    """Results as a table at ``out``, their summary as JSON."""
    asked = records(spark, queries, schema)
    results, _ = jobs.evaluate_retrieval(asked, open_index(spark, index), embedder or HashEmbedder(), k=k, threshold=threshold, use_category_filter=use_category_filter)
    sinks.replace_table(results, out)
    sinks.write_stats(evaluation.summarize(spark.read.parquet(out), k=k), stats)
    return 0


def misses(spark: SparkSession, results: str, out: str, *, wrong: str | None = None) -> int:
    """Missed queries as JSON lines; ``wrong``: for each expected keyword, those found instead, as JSON lines."""
    table = spark.read.parquet(results)
    lacking = {"hit_keyword_at_k", "retrieved", "expected_keyword"} - set(table.columns)
    if lacking:
        raise ValueError(f"{results} has no {', '.join(sorted(lacking))}")
    missed = evaluation.misses(table)
    sinks.write_jsonl(missed, out)
    if wrong:
        sinks.write_jsonl(evaluation.wrong_keywords(missed).orderBy("expected_keyword", "rank"), wrong)
    return 0


def errors(spark: SparkSession, results: str, out: str, *, n: int = 20, cases: int = 30) -> int:
    """The error analysis of stored results as Markdown."""
    if n < 1 or cases < 1:
        raise ValueError("n and cases must be positive")
    sinks.write_text(spark, evaluation.render_error_report(evaluation.misses(spark.read.parquet(results)), n=n, cases=cases), out)
    return 0


#: What ``report`` reads of each file.
_SUMMARY = "no_result_count long, topk_keyword_accuracy double, topk_category_accuracy double, top1_keyword_accuracy double"
_REPORT = {"validation": "error_count long, invalid_docs long, warning_count long", "build": "dry_run boolean, total_documents long, count_after long", "retrieval": f"{_SUMMARY}, summary struct<{_SUMMARY}>"}


def report(spark: SparkSession, validated: str, built: str, retrieved: str, filtered: str, out: str, *, fail_on_error: bool = False) -> int:
    """The gated report as Markdown. A file that is missing fails its section; 1 if the whole fails and that counts."""

    def stats(path: str, kind: str) -> DataFrame:
        row = readers.read_json_or_missing(spark, path, _REPORT[kind]).where("NOT input_missing").drop("input_missing")
        return row.select(*(F.coalesce(f"summary.{c}", c).alias(c) for c in row.columns if c != "summary")) if "summary" in row.columns else row

    row = evaluation.gated_report(stats(validated, "validation"), stats(built, "build"), stats(retrieved, "retrieval"), stats(filtered, "retrieval"))
    sinks.write_text(spark, evaluation.render_gated_report(row), out)
    return int(fail_on_error and row.first()["overall_status"] != "PASS")


def questions(spark: SparkSession, source: str, out: str, *, stats: str | None = None, schema: str | None = None) -> int:
    """Standalone questions by rules and earlier output at ``out``; what only a model can rewrite stays as it is."""
    known = records(spark, source, schema)
    before = spark.read.parquet(out) if readers.exists(spark, out) else None
    done, _ = jobs.build_standalone_questions(known, existing=before)
    sinks.replace_table(done, out)
    stored = spark.read.parquet(out)
    validation.require_counts(stored.count(), known.count(), "the stored questions")
    if stats:
        shown = rewriting.examples(stored)
        sinks.write_stats(validation.beside(rewriting.rewrite_stats(stored), _listed(shown, "examples", 10)), stats)
    return 0


def top_contexts(spark: SparkSession, source: str, index: str, out: str, *, use_category_filter: bool = True, use_keyword_filter: bool = False, threshold: float | None = None, schema: str | None = None, embedder: Embedder | None = None) -> int:
    """Records with the content of the nearest document."""
    rows = records(spark, source, schema).withColumn("query_id", F.col("row_index"))
    done = jobs.top_contexts(rows, open_index(spark, index), embedder or HashEmbedder(), use_category_filter=use_category_filter, use_keyword_filter=use_keyword_filter, threshold=threshold)
    written = sinks.write_jsonl(done.drop("query_id"), out)
    validation.require_counts(written, rows.count(), "the records with contexts")
    return 0


JOBS = {f.__name__.replace("_", "-"): f for f in (validate, build, clean, eval_queries, evaluate, misses, errors, report, questions, top_contexts)}


def _value(text: str) -> str | int | float | bool:
    """An option's value: a number or true or false where it reads as one."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text == "true" if text in ("true", "false") else text


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """JOB, its paths in order, and options as ``--name=value`` (``--name`` alone is true); splits as name=path,name=path."""
    parser = argparse.ArgumentParser(prog="tesserine")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("paths", nargs="*")
    given, extra = parser.parse_known_args(argv)
    options = {}
    for option in extra:
        name, given_value, text = option.removeprefix("--").partition("=")
        options[name.replace("-", "_")] = _value(text) if given_value else True
    paths = [dict(x.split("=", 1) for x in p.split(",")) if given.job == "eval-queries" and i == 0 else p for i, p in enumerate(given.paths)]
    try:
        return JOBS[given.job](spark or session(), *paths, **options)
    except TypeError as e:
        parser.error(str(e))


if __name__ == "__main__":
    sys.exit(main())
