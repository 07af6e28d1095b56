"""Queries of the jobs over files, as a shell runs them, and of text in decomposed form, with their SQL; registered beside those of ``catalog``.

Nations are the documents and every customer asks for its own; each seventh customer expects a keyword that no document has.
"""

from __future__ import annotations

import importlib.util
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import evaluation, metrics
from ..plugins import HashEmbedder
from ..session import scratch_dir
from ..sources import readers, sinks
from . import command, jobs
from .catalog import _CHECKED_SQL, _n, _raw_documents, query, table

_CATEGORY = fixed.CATEGORIES[0]
#: Registers a query where a YAML parser is installed.
_with_yaml = query if importlib.util.find_spec("yaml") else lambda sql: lambda f: f


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the knowledge base, kb, and the customers' questions, asked, as JSON lines."""
    folder = scratch_dir(spark)
    nation, name = table(spark, sf_dir, "nation"), F.col("n_name")
    meta = F.struct(name.alias("keyword"), F.lit(_CATEGORY).alias("category"), F.lit("s").alias("subcategory"), F.lit("b").alias("base_image_id"), F.array(F.lit("a")).alias("source_image_ids"), F.lit(1).alias("source_count"))
    kb = nation.select(F.concat_ws("|", F.lit(_CATEGORY), F.lit("s"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.concat(F.lit("about "), name, F.lit(" and its people")).alias("content"), meta.alias("metadata"))
    sinks.write_jsonl(kb, f"{folder}/kb")
    asked = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("about "), name, F.lit(" and its people")).alias("question"),
        F.when(F.col("c_custkey") % 7 == 0, "không có").otherwise(name).alias("expected_keyword"), F.lit(_CATEGORY).alias("expected_category"),
    )
    sinks.write_jsonl(asked, f"{folder}/asked")
    return folder


def _run(spark: SparkSession, *argv: str) -> int:
    return command.main(list(argv), spark)


def _evaluated(spark: SparkSession, sf_dir: str) -> str:
    """The folder after validation, two builds of the index and an evaluation."""
    f = _written(spark, sf_dir)
    codes = [
        _run(spark, "validate", f"{f}/kb", f"--stats={f}/valid.json"), _run(spark, "build", f"{f}/kb", f"{f}/index", "--limit=10"),
        _run(spark, "build", f"{f}/kb", f"{f}/index", f"--stats={f}/build.json"), _run(spark, "evaluate", f"{f}/asked", f"{f}/index", f"{f}/results", f"--stats={f}/retrieval.json", "--k=1"),
    ]
    if any(codes):
        raise RuntimeError(f"a job failed: {codes}")
    return f


@query(_CHECKED_SQL + ", g AS (SELECT *, len(list_filter(issues, lambda x: starts_with(x, 'error'))) AS errors FROM e) SELECT count(*) AS total_raw_docs, count(*) FILTER (errors = 0) AS valid_docs, CAST(sum(errors) AS BIGINT) AS error_count, CAST(sum(len(issues) - errors) AS BIGINT) AS warning_count, count(DISTINCT CASE WHEN errors = 0 THEN keyword END) AS unique_keyword_count, 1 AS exit_code FROM g")
def job_validate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation job over a file of faulty documents: statistics that it wrote, and its exit code."""
    folder = scratch_dir(spark)
    _raw_documents(spark, sf_dir).orderBy("row_index").select("raw").write.text(f"{folder}/kb")
    code = _run(spark, "validate", f"{folder}/kb", f"--stats={folder}/valid.json")
    told = readers.read_json_document(spark, f"{folder}/valid.json", "total_raw_docs long, valid_docs long, error_count long, warning_count long, unique_keyword_count long")
    return told.withColumn("exit_code", F.lit(code))


@query(f"SELECT '{_CATEGORY}|s|' || n_nationkey AS doc_id, n_name AS keyword, 'about ' || n_name || ' and its people' AS content, 10 AS before, count(*) OVER () AS after FROM nation")
def job_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of ten documents, built on with all of them."""
    f = _written(spark, sf_dir)
    _run(spark, "build", f"{f}/kb", f"{f}/index", "--limit=10")
    _run(spark, "build", f"{f}/kb", f"{f}/index", f"--stats={f}/build.json")
    told = readers.read_json_document(spark, f"{f}/build.json", "count_before int, count_after long").select(F.col("count_before").alias("before"), F.col("count_after").alias("after"))
    return command.open_index(spark, f"{f}/index").select("doc_id", "keyword", "content").join(told)


_ASKED = "a AS (SELECT 'c' || c_custkey AS id, c_custkey % 7 = 0 AS missed, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {_ASKED} SELECT count(*) AS total, 0 AS no_result_count, round(count(*) FILTER (NOT missed) / count(*), 4) AS topk_keyword_accuracy, 1.0 AS topk_category_accuracy FROM a")
def job_evaluate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _evaluated(spark, sf_dir)
    return readers.read_json_document(spark, f"{f}/retrieval.json", "total long, no_result_count int, topk_keyword_accuracy double, topk_category_accuracy double")


@query(f"WITH {_ASKED} SELECT id, 'không có' AS expected_keyword, n_name AS found, 1 AS rank FROM a WHERE missed")
def job_misses_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed queries as the job writes them, with their slim hits."""
    f = _evaluated(spark, sf_dir)
    _run(spark, "misses", f"{f}/results", f"{f}/missed", f"--wrong={f}/wrong")
    rows = readers.read_jsonl(spark, f"{f}/missed", "id string, expected_keyword string, retrieved array<struct<rank: int, keyword: string>>")
    return rows.select("id", "expected_keyword", F.explode("retrieved").alias("hit")).select("id", "expected_keyword", F.col("hit.keyword").alias("found"), "hit.rank")


@query(f"""WITH {_ASKED}, m AS (SELECT * FROM a WHERE missed) SELECT 'Misses: ' || count(*) AS line FROM m
UNION ALL SELECT '| không có | ' || count(*) || ' |' FROM m UNION ALL SELECT '| {_CATEGORY} | ' || count(*) || ' |' FROM m""")
def job_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the error analysis that count all misses."""
    f = _evaluated(spark, sf_dir)
    _run(spark, "errors", f"{f}/results", f"{f}/errors.md")
    lines = spark.read.text(f"{f}/errors.md").select(F.col("value").alias("line"))
    return lines.where(F.col("line").startswith("Misses: ") | F.col("line").startswith("| không có | ") & ~F.col("line").rlike(r"\|.*\|.*\|.*\|") | F.col("line").startswith(f"| {_CATEGORY} |"))


@query("SELECT 'Overall: **PASS**' AS line UNION ALL SELECT '| ' || s || ' | PASS |' FROM (SELECT unnest(['Validation', 'Index build', 'Retrieval', 'Retrieval with category filter']) AS s)")
def job_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gated report over the files of the other jobs, filtered evaluation included."""
    f = _evaluated(spark, sf_dir)
    _run(spark, "evaluate", f"{f}/asked", f"{f}/index", f"{f}/filtered", f"--stats={f}/filtered.json", "--k=1", "--use-category-filter")
    _run(spark, "report", f"{f}/valid.json", f"{f}/build.json", f"{f}/retrieval.json", f"{f}/filtered.json", f"{f}/report.md")
    lines = spark.read.text(f"{f}/report.md").select(F.regexp_replace("value", r"^# .*|^\| (Section|---).*|^## .*|^- .*", "").alias("line"))
    return lines.where("line <> ''")


@query("SELECT c_custkey AS id, 'about ' || n_name || ' and its people' AS retrieve_context FROM customer JOIN nation ON c_nationkey = n_nationkey")
def job_top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the content of the nearest document, as the job writes them."""
    f = _written(spark, sf_dir)
    _run(spark, "build", f"{f}/kb", f"{f}/index")
    records = readers.read_jsonl(spark, f"{f}/asked", "id string, question string").select("id", "question", F.lit("").alias("standalone_question"), F.lit(_CATEGORY).alias("category"), F.lit("").alias("keyword"))
    sinks.write_jsonl(records, f"{f}/records")
    _run(spark, "top-contexts", f"{f}/records", f"{f}/index", f"{f}/contexts")
    return readers.read_jsonl(spark, f"{f}/contexts", "id string, retrieve_context string").select(F.substring("id", 2, 20).cast("long").alias("id"), "retrieve_context")


@_with_yaml("SELECT c_custkey AS id, CASE WHEN n_regionkey = 3 THEN 'phở ' || n_name ELSE n_name END AS keyword, n_regionkey = 3 AS changed FROM customer JOIN nation ON c_nationkey = n_nationkey")
def job_clean_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cleaned by the job, by a mapping in YAML."""
    f = scratch_dir(spark)
    nation = table(spark, sf_dir, "nation")
    rules = [r["n_name"] for r in nation.where("n_regionkey = 3").orderBy("n_name").collect()]
    sinks.write_text(spark, "keyword_normalization:\n" + "".join(f"  {n}: phở {n}\n" for n in rules), f"{f}/rules.yaml")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("image_id"), F.lit("what is it").alias("question"), F.lit("").alias("standalone_question"), F.col("n_name").alias("keyword"))
    sinks.write_jsonl(rows, f"{f}/records")
    _run(spark, "clean", f"{f}/records", f"{f}/rules.yaml", f"{f}/cleaned", f"--report={f}/cleaned.json")
    return readers.read_jsonl(spark, f"{f}/cleaned", "image_id string, keyword string, changed boolean").select(F.substring("image_id", 2, 20).cast("long").alias("id"), "keyword", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM (SELECT doc_id, 'Phở ' || text || ' é' AS text FROM documents)")
def composed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in decomposed form, written as JSON lines; the jobs' reader composes them."""
    path = scratch_dir(spark)
    text = F.concat(F.lit("Phở "), F.col("text"), F.lit(" é"))
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), path)
    return command.records(spark, path, "doc_id long, text string").select("doc_id", "text")


@query("SELECT n_nationkey AS query_id, 1 AS rank, 'about ' || n_name AS content FROM nation WHERE n_nationkey % 4 <> 0")
def search_contents_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents alone of what a search finds."""
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("about "), "n_name").alias("content"))
    asked = named.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("content")).alias("query"))
    embedder = HashEmbedder()
    return jobs.search_contents(asked, embedder.embed(named, "content"), embedder, k=1)


@query("WITH d AS (SELECT coalesce(nullif(trim(source), ''), '<missing>') AS source, count(*) AS n FROM documents GROUP BY ALL) SELECT source, n, round(n / sum(n) OVER (), 4) AS share, row_number() OVER (ORDER BY source) AS place FROM d")
def sorted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source occurs, in the order of sources; place is that in the result."""
    return evaluation.distribution(table(spark, sf_dir, "documents"), "source").withColumn("place", F.monotonically_increasing_id() + 1)


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE printf('%.2f%%', p_size / 50.0 * 100) END AS share FROM part")
def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.percent(F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0)).alias("share"))


def _grams(side: str, n: int) -> str:
    words = f"list_filter(string_split({_n(side)}, ' '), lambda x: x <> '')"
    return f"SELECT i, array_to_string(list_slice(w, k, k + {n - 1}), ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w) - {n - 2})) AS k FROM (SELECT i, {words} AS w FROM b))"


_BLEU_N = [f"(SELECT coalesce(sum(least(p.c, r.c)), 0) FROM (SELECT i, g, count(*) AS c FROM ({_grams('prediction', n)}) GROUP BY ALL) p JOIN (SELECT i, g, count(*) AS c FROM ({_grams('reference', n)}) GROUP BY ALL) r ON p.i = r.i AND p.g = r.g) AS h{n}, (SELECT count(*) FROM ({_grams('prediction', n)})) AS f{n}, (SELECT count(*) FROM ({_grams('reference', n)})) AS w{n}" for n in range(1, 5)]
_BLEU_SQL = f"""WITH b AS (SELECT item_id AS i, substr(text, 5) AS prediction, text AS reference FROM benchmark), s AS (SELECT {", ".join(_BLEU_N)})
SELECT round(CASE WHEN least(h1, h2, h3, h4) > 0 THEN CASE WHEN f1 >= w1 THEN 1.0 ELSE exp(1 - w1 / f1) END * exp((ln(h1 / f1) + ln(h2 / f2) + ln(h3 / f3) + ln(h4 / f4)) / 4) ELSE 0.0 END, 4) AS bleu FROM s"""


@query(_BLEU_SQL)
def corpus_bleu_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of benchmark texts that lack their first four letters against whole ones."""
    pairs = table(spark, sf_dir, "benchmark").select(F.expr("substr(text, 5)").alias("prediction"), F.col("text").alias("reference"))
    return metrics.corpus_bleu(pairs, "prediction", "reference")


@query("SELECT conv_id, turn, trim(text) = '' OR turn % 3 = 0 AS refused FROM conversations")
def query_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluation queries the guard refuses: those without a question or without an expectation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("turn") % 3 != 0, "kw").alias("expected_keyword"), F.lit("").alias("expected_category"))
    good = evaluation.require_expectations(c.where("trim(question) <> '' AND turn % 3 <> 0")).select("conv_id", "turn", F.lit(False).alias("refused"))
    bad = c.where("trim(question) = '' OR turn % 3 = 0")
    try:
        evaluation.require_expectations(bad)
        refused = bad.limit(0)
    except ValueError:
        refused = bad
    return reduce(DataFrame.unionByName, [good, refused.select("conv_id", "turn", F.lit(True).alias("refused"))])
